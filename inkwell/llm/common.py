"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.shared import hinted, remove, shared_dir, written

__all__ = ["ascii_lower", "hinted", "literal_table", "remove", "set_batches", "shared_dir", "small_batches", "table", "words", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Space and U+0009 to U+000D separate words, in every operator here.
SEPARATORS = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table held in the plan, without an RDD. ``schema``: ``name type, ...``."""
    names = [x.split()[0] for x in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def set_batches(spark: SparkSession, limit: int = BATCH) -> str | None:
    """Let Arrow batches hold ``limit`` bytes at most; returns the old setting."""
    before = spark.conf.get(BATCH_KEY, None)
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before or "64m")) > limit:
        spark.conf.set(BATCH_KEY, str(limit))
    return before


@contextmanager
def small_batches(spark: SparkSession, limit: int = BATCH):
    """Let Arrow batches hold ``limit`` bytes at most in what runs inside. The
    default of 64 MB, doubled while a batch grows and held twice, in the JVM and
    in Python, is much for an executor with many cores."""
    before = set_batches(spark, limit)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_KEY)
        else:
            spark.conf.set(BATCH_KEY, before)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, ``[^\\x20\\x09-\\x0D]+``; a null text has none."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D]", " ")
    return F.array_remove(F.split(spaced, " "), "")
