"""What is done in a text's own row equals what goes by rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from inkwell.operators import detect, evaluate, library, review

PARTS = ["a.b@example.org", "+44 7700 900123", "SW1A 1AA", "943 476 5919", "NHS number: 943 476 5919", "AB123456C", "https://x.example/1?a@b.example).", "3/4/2026", "3 June 2026", "Patient ID: SYN-000007", "SYN-000007", "Flat 2B, 12 Fictional Row", "no change", "Kiosk", "kiosk", "", "\n", "😀é"]
PHRASES = [(None, "no change", "MISC", "[SAME]", 0), (None, "kiosk", "LOCATION", "[K]", 0), (None, "SYN-000007", "CASE_REFERENCE", "[ALL]", 0), (1, "SYN-000007", "CASE_REFERENCE", "[OWN]", 1)]


def texts(spark):
    r = random.Random(5)
    rows = [(i, i % 3, " ".join(r.choices(PARTS, k=i % 14))) for i in range(120)] + [(500, 1, ""), (501, 1, None)]
    return spark.createDataFrame(rows, "doc_id bigint, patient_id bigint, text string").cache()


def same(a, b):
    key = lambda df: sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    return key(a) == key(b)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_items_in_rows(spark, monkeypatch):
    notes = texts(spark)
    by_rows = review.label(review.merge(detect.detect(notes)), notes)
    assert same(review.labelled(notes), by_rows)
    assert "Window" not in plan_of(review.labelled(notes).where("true")).split("Union")[0]
    # Texts above the limit give the same.
    monkeypatch.setattr(review, "SHORT", 60)
    assert same(review.labelled(notes), by_rows)


def saved(spark):
    columns = "patient_id bigint, phrase string, category string, replacement string, level int"
    every = spark.createDataFrame(PHRASES, columns).withColumn("normalized_phrase", F.lower("phrase"))
    return every.where("level = 0"), every.where("level = 1")


def test_saved_phrases_in_rows(spark, monkeypatch):
    notes = texts(spark)
    found = library.library_evidence(notes, *saved(spark))
    # Few first words: texts aren't taken apart into rows of words.
    assert "posexplode" not in plan_of(found) and "_anchor" not in plan_of(found)
    rows = found.collect()
    assert {r["replacement"] for r in rows} == {"[SAME]", "[K]", "[ALL]", "[OWN]"}
    items = library.reviewed(notes, found)
    monkeypatch.setattr(library, "FEW_WORDS", 0)
    assert same(library.library_evidence(notes, *saved(spark)), spark.createDataFrame(rows, found.schema))
    monkeypatch.setattr(review, "SHORT", -1)
    assert same(library.reviewed(notes, found), items)


def test_evaluation_in_rows(spark):
    pair = lambda c, v: F.struct(F.lit(c).alias("category"), F.lit(v).alias("phrase"))
    gold = F.array(pair("CASE_REFERENCE", "SYN-000007"), pair("EMAIL", "b@example"), pair("MANUAL", "no change"), pair("MANUAL", "change"))
    notes = texts(spark).where("text is not null").withColumn("entities", gold)
    rows = notes.select("text", evaluate.places_in(F.col("text"), F.col("entities")).alias("gold"), review.found_in(F.col("text")).alias("evidence"))
    rows = rows.withColumn("items", review.items_in(F.col("evidence"), F.col("text")))
    places, items = evaluate.places_of(notes), review.labelled(notes)
    assert same(evaluate.by_category_in(rows), evaluate.by_category(places, items))
    assert same(evaluate.with_rate(evaluate.token_fpr_in(rows)), evaluate.token_fpr(notes, places, items))
    assert same(evaluate.stage_contribution_in(rows), evaluate.stage_contribution(places, detect.detect(notes)))
    assert "Window" not in plan_of(evaluate.token_fpr_in(rows))


def test_split_by_condition(spark):
    items = review.labelled(texts(spark)).withColumn("decision", F.lit("accept"))
    assert same(review.split_item(items, F.col("item") == 2), review.split_item(items, items.where("item = 2").select("doc_id", "item")))
