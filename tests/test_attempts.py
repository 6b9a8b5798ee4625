"""The streamed attempt table against the batch operator."""

import random

from inkwell.operators import usage
from inkwell.streaming.attempts import AttemptTable, follow
from pyspark.sql import functions as F

SCHEMA = "attempt_id long, outcome string, at long, seq long, model string, cost_nanos long"


def events(seed, n=400):
    rng = random.Random(seed)
    kinds = ["started", "started", "completed", "failed", "cancelled", "note"]
    return [(rng.randrange(60), rng.choice(kinds), rng.randrange(1000), i, f"m{i % 3}", rng.choice([None, i])) for i in range(n)]


def seen(df):
    return {r.attempt_id: (r.model, r.attempted_at, r.outcome, r.cost_nanos) for r in df.collect()}


def test_batches_in_any_order_and_again_give_the_batch_result(spark, tmp_path):
    rows = events(1)
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    want = seen(usage.lifecycle(df(rows)))
    shuffled = random.Random(2).sample(rows, len(rows))
    table = AttemptTable(spark, f"{tmp_path}/t")
    for k in range(4):
        # Each batch repeats a few events of the others; batch 1 is run twice.
        table.upsert(df(shuffled[k::4] + shuffled[:20]), k)
        table.upsert(df(rows[:50]), min(k, 1))
    assert seen(table.attempts()) == want and table.log.version() == 4
    table.upsert(df(rows).limit(0), 4)
    assert seen(table.attempts()) == want


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    rows = events(3, 200)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("event_id", F.col("seq")).withColumn("event_time", F.timestamp_seconds(F.col("at")))
    table = AttemptTable(spark, f"{tmp_path}/t")
    for part in ("seq % 2 = 0", "seq % 2 = 1 or seq < 20"):
        df.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        follow(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), table, f"{tmp_path}/ck")
    assert seen(table.attempts()) == seen(usage.lifecycle(spark.createDataFrame(rows, SCHEMA)))
    assert AttemptTable(spark, f"{tmp_path}/none").attempts().count() == 0
