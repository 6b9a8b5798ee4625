"""The sweep against comparing all pairs."""

import random
import time

import pytest
from inkwell.operators import evaluate, intervals
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start int, end int, name string"


def rows(rng, n, tag):
    out = []
    for i in range(n):
        a = rng.randrange(0, 120)
        out.append((rng.choice([1, 2, 3, None]), a, a + rng.choice([0, 1, 3, 10, 60]), f"{tag}{i}"))
    return out


@pytest.mark.parametrize("bin_size", [1, 7, 1 << 16])
def test_sweep_equals_all_pairs(spark, bin_size):
    rng = random.Random(bin_size)
    sets = {t: rows(rng, 120, t) for t in "abc"}
    sets["a"] += sets["a"][:5] + sets["b"][:5]
    frames = {t: spark.createDataFrame(r, SCHEMA) for t, r in sets.items()}
    asks = {"a": {"overlap": ("b", "c"), "within": ("b",)}, "c": {"overlap": ("b",)}}
    got = sorted((r.side, r.doc_id or 0, r.start, r.end, r.name, r.overlap_b, r.overlap_c, r.within_b) for r in _merged(intervals.swept(frames, asks, bin_size=bin_size)).collect())
    want = []
    for side in "ac":
        for doc, s, e, name in sets[side]:
            over = {t: any(d == doc is not None and x < e and s < y for d, x, y, _ in sets[t]) for t in "bc"}
            inside = any(d == doc is not None and x <= s and e <= y for d, x, y, _ in sets["b"])
            want.append((side, doc or 0, s, e, name, over["b"], over["c"] if side == "a" else None, inside if side == "a" else None))
    assert got == sorted(set(want), key=str) or sorted(got, key=str) == sorted(set(want), key=str)


def _merged(df):
    """Who asks for both has a row for each question."""
    flags = [c for c in df.columns if c.startswith(("overlap", "within"))]
    return df.groupBy("side", "doc_id", "start", "end", "name").agg(*[F.max(f).alias(f) for f in flags])


def test_one_long_document_with_many_spans(spark):
    """Half a million spans on each side of one document."""
    n = 500_000
    gold = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 3).cast("int").alias("start"), (F.col("id") * 3 + 2).cast("int").alias("end"), F.lit("A").alias("category"))
    found = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 3 + F.when(F.col("id") % 2 == 0, 0).otherwise(2)).cast("int").alias("start"), (F.col("id") * 3 + 3).cast("int").alias("end"), F.lit("A").alias("category"))
    began = time.time()
    row = evaluate.by_category(gold, found).first()
    assert (row.gold, row.covered, row.exact, row.proposals, row.unexpected) == (n, n // 2, 0, n, n // 2)
    assert time.time() - began < 60


def test_no_spans(spark):
    none = spark.createDataFrame([], "doc_id long, start int, end int, category string, stage string")
    assert evaluate.by_category(none, none).count() == 0 and evaluate.stage_contribution(none, none).count() == 0


def test_a_long_note_of_entities_is_decoded_in_linear_time(spark):
    """Every word of a note of 240,000 characters is an entity of its own."""
    from inkwell.operators import ner

    took = {}
    for n in (10_000, 40_000, 80_000):
        text = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("ab "), n).alias("text"))
        logits = F.array(*[F.lit(5.0 if j == 3 else 0.0) for j in range(9)])
        tokens = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("window"), F.col("id").cast("int").alias("position"), (F.col("id") * 3).cast("int").alias("start"), (F.col("id") * 3 + 1).cast("int").alias("end"), logits.alias("logits"))
        began = time.time()
        row = ner.decode(tokens, text).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("end") - F.col("start")).alias("short"), F.max("end").alias("last")).first()
        took[n] = time.time() - began
        # Each is widened to its word.
        assert tuple(row) == (n, 2, 3 * n - 1)
    print(took)
    assert took[80_000] < 8 * max(took[10_000], took[40_000] / 3, 2)


def test_rescan_until_nothing_is_found(spark):
    from inkwell.operators import detect, review

    notes = spark.createDataFrame([(1, "Call 07700 900123 or write to a@b.example."), (2, "nothing here"), (3, "((()))")], "doc_id long, text string")
    items, done = review.settle(notes, review.label(review.merge(detect.detect(notes)), notes))
    assert {tuple(r) for r in done.collect()} == {(1, 0, True), (2, 0, True), (3, 0, True)}
    assert {r.decision for r in items.collect()} == {"accept"} and items.count() == 2

    def found(texts):
        at = F.instr("text", "()") - 1
        return texts.where("text like '%()%'").select("doc_id", F.lit(0).cast("long").alias("seq"), F.lit("MISC").alias("category"), at.cast("int").alias("start"), (at + 2).cast("int").alias("end"), F.lit("()").alias("phrase"), F.lit(1.0).alias("confidence"), F.lit("rules").alias("stage"))

    remove = lambda x: x.withColumn("decision", F.lit("remove"))
    first = review.label(review.merge(found(notes)), notes)
    items, done = review.settle(notes, first.withColumn("decision", F.lit("pending")), find=found, decide=remove)
    assert {tuple(r) for r in done.collect()} == {(1, 0, True), (2, 0, True), (3, 2, True)}
    assert [(r.doc_id, r.start, r.end) for r in items.collect()] == [(3, 0, 6)]
    # The bound ends it; the note is known to be unsettled.
    _, done = review.settle(notes, first.withColumn("decision", F.lit("pending")), find=found, decide=remove, rounds=1)
    assert {tuple(r) for r in done.where("doc_id = 3").collect()} == {(3, 1, False)}
