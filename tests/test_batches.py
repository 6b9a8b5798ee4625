"""What is found by batches of texts equals the native expressions."""

from __future__ import annotations

import random
import string

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.operators import batches, detect, generation, review
from tests.test_rows import plan_of, same

PARTS = [
    "a.b@example.org", "a@b@c.com", "x" * 70 + "@a.bc", "._@a.co", "@", "+44 7700 900123", "+44 (0) 7700-900123", "07700900123", "SW1A 1AA", "gir 0aa", "943 476 5919", "9434765919", "1111111111",
    "NHS number: 943 476 5919", "nhs no. 943-476-5919", "AB123456C", "NK 12 34 56 D", "https://x.example/1?a@b.example).", "www.x.y!!", "3/4/2026", "2026-01-02", "3 June 2026", "21st  dec",
    "Patient ID: SYN-000007", "case reference A/-/-", "case id " + "a-" * 25 + "b", "SYN-000007", "Flat 2B, 12 Fictional Row", "house 7,  12 O'Neil close", "0", "+", "_", "\n", "\x1c", "\x0b", "😀é", "ſ",
]


def texts(spark, n=800):
    r = random.Random(11)
    kinds = [lambda: r.choice([" ", "", ", "]).join(r.choices(PARTS, k=r.randrange(14))), lambda: "".join(r.choices(string.printable, k=80)), lambda: "".join(r.choices("aA0 19@.-/+4(,)", k=120))]
    rows = [(i, r.choice(kinds)()) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "3/4/2026 a.b@example.org " * 3000), (n + 3, "é 3/4/2026 " * 300), (None, "3/4/2026")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").cache()


def test_evidence_by_batches(spark):
    notes = texts(spark)
    native = notes.select("doc_id", F.posexplode(detect.rule_evidence(F.col("text"))).alias("seq", "e")).select("doc_id", "seq", "e.*")
    found = detect.detect(notes).drop("stage")
    assert same(found, native)
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()


def test_items_by_batches(spark, monkeypatch):
    notes = texts(spark).where("doc_id is not null")
    items = review.labelled(notes)
    native = notes.select("doc_id", F.posexplode(detect.rule_evidence(F.col("text"))).alias("seq", "e")).select("doc_id", F.col("seq").cast("bigint").alias("seq"), "e.*", F.lit("rules").alias("stage"))
    assert same(items, review.label(review.merge(native), notes))
    # One pass over the notes, whatever their length: no second branch, and each text is searched once.
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Window" not in plan and plan.count("ArrowEvalPython") == 1
    few = review.labelled(notes, fields=("item", "phrase"))
    assert set(few.columns) == {"doc_id", "item", "phrase", "stages"} and same(few, items.select(*few.columns))
    # Small buffers hold a text each.
    assert [low for low, _, _ in batches._buffers(pa.array(["a" * (batches.SIZE + 1), "b", None]))] == [0, 1]


def test_review_in_rows(spark):
    """Decisions, rendering, places and records of arrays equal those of rows."""
    notes = texts(spark, 200).where("doc_id is not null and text is not null")
    kinds = F.split(F.lit("pending,accept,keep,remove,edit"), ",")
    ask, name = (lambda g: F.get(kinds, (g % 5).cast("int"))), (lambda g: F.when(g != 9, F.concat(F.lit("[E_"), g.cast("string"), F.lit("]"))))
    items = review.decided(review.labelled(notes), ask(F.col("group")), name(F.col("group")))
    rows = review.with_items(notes).withColumn("items", review.decided_in(F.col("items"), lambda x: ask(x["group"]), lambda x: name(x["group"])))
    assert same(review.rows_of(rows).select("doc_id", "item", "decision", "replacement"), items.select("doc_id", "item", "decision", "replacement"))
    assert same(rows.select("doc_id", review.rendered_in(F.col("text"), F.col("items")).alias("output")), review.render(notes, items).select("doc_id", "output"))
    left = rows.select("doc_id", review.egress_in(F.col("items")).alias("items"))
    columns = ["doc_id", "item", "output_start", "output_end"]
    assert same(review.rows_of(left).select(*columns), review.egress(items).select(*columns))
    saved = rows.select("doc_id", "text", review.snapshot_in(F.col("items")).alias("snapshot"))
    back = review.rows_of(saved.select("doc_id", review.restored_in(F.col("snapshot"), F.col("text")).alias("items")))
    assert same(back, review.restore(review.snapshot(items), notes))


def test_tokens_in_rows(spark):
    """Tokens of notes' own rows equal those of items' rows."""
    spread = F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b").alias(generation.KEY)
    notes = texts(spark, 40).where("doc_id is not null and text is not null and length(text) < 4000").select(spread, "doc_id", "text", (-F.col("doc_id")).alias("at"))
    items = review.labelled(notes).withColumn("decision", F.when(F.col("group") % 3 == 0, "keep").otherwise("accept"))
    ordinal = F.row_number().over(Window.partitionBy(generation.KEY).orderBy("at")).alias("ordinal")
    by_items = generation.token_items(review.egress(items), notes.select(generation.KEY, "doc_id", ordinal))
    rows = review.with_items(notes).withColumn("items", review.decided_in(F.col("items"), lambda x: F.when(x["group"] % 3 == 0, "keep").otherwise("accept"), lambda x: F.lit(None).cast("string")))
    rows = generation.token_lists(rows.select(generation.KEY, "doc_id", "at", review.egress_in(F.col("items")).alias("items")), ("at",))
    columns = [generation.KEY, "doc_id", "ordinal", "item", "number", "token", "phrase"]
    assert same(rows.select(generation.KEY, "doc_id", "ordinal", F.inline("tokens")).select(*columns), by_items.select(*columns))
    known = generation.with_known(notes.select(generation.KEY).distinct(), by_items)
    assert {r[0]: r["tokens"] for r in known.collect()} == {r[0]: r["known"] for r in rows.collect()}
