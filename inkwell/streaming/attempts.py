"""Attempts of document generation as a streaming aggregate.

Events come late, twice and in any order. What is kept for an attempt is a
merge of its events: the first start and the first terminal one by time and
number, so an event that is merged again, or later than others, changes
nothing that it shouldn't. Each micro-batch is reduced to one row for each
attempt and merged into the table; only the buckets that it touches are
written anew, and one commit with the batch's number publishes them, so a
batch that is run again after a failure isn't applied twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.usage import TERMINAL
from inkwell.sources.commits import CommitLog

BUCKETS = 64
#: Of each attempt: its first start and its first end.
ROWS = "attempt_id bigint, started struct<at:bigint,seq:bigint,model:string>, ended struct<at:bigint,seq:bigint,outcome:string,cost_nanos:bigint>"


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("attempt_id").agg(F.min("started").alias("started"), F.min("ended").alias("ended"))


def reduced(events: DataFrame) -> DataFrame:
    """ROWS of events (attempt_id, outcome, at, seq, model, cost_nanos)."""
    started = F.when(F.col("outcome") == "started", F.struct("at", "seq", "model"))
    ended = F.when(F.col("outcome").isin(*TERMINAL), F.struct("at", "seq", "outcome", "cost_nanos"))
    return _merged(events.select("attempt_id", started.alias("started"), ended.alias("ended")))


class AttemptTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = CommitLog(spark, f"{self.folder}/log")

    def _read(self, buckets: dict[str, str]) -> DataFrame:
        paths = [f"{self.folder}/data/{name}/bucket={b}" for b, name in buckets.items()]
        return self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)

    def upsert(self, events: DataFrame, number: int) -> None:
        """Merge a micro-batch into the table; at most BUCKETS numbers reach the driver."""
        version, state = self.log.read()
        if number <= state.get("batch", -1):
            return
        bucket = F.pmod(F.xxhash64("attempt_id"), F.lit(BUCKETS)).cast("string")
        rows = reduced(events).persist()
        touched = [r[0] for r in rows.select(bucket).distinct().collect()]
        known, name = state.get("buckets", {}), uuid.uuid4().hex
        if touched:
            merged = _merged(self._read({b: known[b] for b in touched if b in known}).unionByName(rows))
            merged.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{self.folder}/data/{name}")
        rows.unpersist()
        self.log.publish(version, state | {"buckets": known | dict.fromkeys(touched, name), "batch": number})

    def attempts(self) -> DataFrame:
        """(attempt_id, model, attempted_at, outcome, cost_nanos) as of the last commit."""
        rows = self._read(self.log.read()[1].get("buckets", {}))
        return rows.select("attempt_id", "started.model", F.col("started.at").alias("attempted_at"), F.coalesce("ended.outcome", F.lit("started")).alias("outcome"), "ended.cost_nanos", F.col("ended.at").alias("ended_at"))


def follow(events: DataFrame, table: AttemptTable, checkpoint: str, late: str = "1 day", time: str = "event_time", key: str = "event_id") -> None:
    """Merge a stream of events into ``table`` until what is there is read.
    Repeats of a ``key`` within ``late`` are dropped by the stream, later ones
    by the merge; what is later than ``late`` behind the newest event is dropped."""
    once = events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    query = once.writeStream.foreachBatch(table.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
