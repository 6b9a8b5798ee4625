"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that the driver and every executor can reach.

    It lies under ``spark.checkpoint.dir``. Only in local mode, where driver
    and executors are one machine, a temporary folder takes its place if the
    session has none; on a cluster that is an error.
    """
    base = spark.conf.get(KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{KEY} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set(KEY, base)
    folder = f"{base.rstrip('/')}/inkwell-{uuid.uuid4().hex}"
    _made.append(folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later jobs don't
    repeat the work, and a lost executor takes nothing with it."""
    path = f"{shared_dir(df.sparkSession)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of ids, digests or short phrases (under 150 bytes each) that are sent
#: to all executors rather than joined by a shuffle of the texts: 15 MB at most.
BROADCAST_ROWS = 100_000


def hinted(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """``df`` marked for broadcast if it is counted and found small, else as it
    is, for a join by shuffle. ``weight`` counts a row as several. The count
    runs ``df``'s plan, so that should be a written table or close to one."""
    size = df.agg(F.coalesce(F.sum(F.lit(1) if weight is None else weight), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_ROWS else df


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def remove(*tables: DataFrame) -> None:
    """Delete the files of tables from ``written`` that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def clean(spark: SparkSession) -> None:
    """Delete every folder that this process took from ``shared_dir``. Call it
    when the results of the queries so far have been read or written."""
    while _made:
        _delete(spark, _made.pop())
