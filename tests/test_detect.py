"""Detection, merging, labels, rendering and rescan."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from inkwell.functions.spans import find_spans
from inkwell.operators import detect, evaluate, review
from inkwell.sources.notes import source_valid

# Notes of the gold corpus that rules find something in, and what.
GOLD = [
    ("Alex Morgan attended a review in Bristol on 12 March 2026. Alex Morgan reported improved sleep and no change to the prescribed 10 mg dose.", [("DATE", 44, "12 March 2026")]),
    ("Contact maya.chen@example.invalid or 07700 900123. No change to treatment.", [("EMAIL", 8, "maya.chen@example.invalid"), ("PHONE", 37, "07700 900123")]),
    ("NHS number: 943 476 5919. NI number: AB123456C. Review arranged.", [("NHS_NUMBER", 12, "943 476 5919"), ("NI_NUMBER", 37, "AB123456C")]),
    ("Postal district SW1A 1AA. Telephone +44 7700 900456. Please call after lunch.", [("POSTCODE", 16, "SW1A 1AA"), ("PHONE", 36, "+44 7700 900456")]),
    ("Patient ID: SYN-2048. Record number: DEMO/1024. Appointment on 2026-04-15.", [("CASE_REFERENCE", 12, "SYN-2048"), ("CASE_REFERENCE", 37, "DEMO/1024"), ("DATE", 63, "2026-04-15")]),
    ("From: ellis@example.invalid. Sent: 14/03/2026. To: jordan@example.invalid. Subject: appointment.", [("EMAIL", 6, "ellis@example.invalid"), ("DATE", 35, "14/03/2026"), ("EMAIL", 51, "jordan@example.invalid")]),
    ("The appointment is listed at https://example.invalid/client/demo. Please confirm.", [("URL", 29, "https://example.invalid/client/demo")]),
    ("Report by Dr Nadia Patel for Northbridge Clinic, London. Case reference: DEMO-555. Dated 1 September 2026.", [("CASE_REFERENCE", 73, "DEMO-555"), ("DATE", 89, "1 September 2026")]),
    ("No suicidal ideation. Continue sertraline 50 mg daily. Blood pressure 120/80. Follow up in 2 weeks.", []),
    ("Age 47. Denies chest pain. Oxygen saturation 98%. Reports 6 hours of sleep. No medication changes.", []),
    ("QQ123456C, 10 mg, 47.", []),
    ("Flat 2B, 47 Fictional Row", [("LOCATION", 0, "Flat 2B, 47 Fictional Row")]),
    ("NHS no. 123 456 7890", [("NHS_NUMBER", 8, "123 456 7890")]),
    ("GB123456C AB123456C", [("NI_NUMBER", 10, "AB123456C")]),
    ("1111111111 9434765919", [("NHS_NUMBER", 11, "9434765919")]),
    ("see www.example.invalid/a). Next", [("URL", 4, "www.example.invalid/a")]),
    ("Café é12/03/2026x 🩺 a@b.org", [("EMAIL", 20, "a@b.org")]),
]


def notes_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_gold_rules(spark):
    got = {}
    for r in detect.detect(notes_of(spark, *[t for t, _ in GOLD])).collect():
        got.setdefault(r.doc_id, []).append((r.category, r.start, r.phrase))
        assert r.end == r.start + len(r.phrase)
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, (_, v) in enumerate(GOLD) if v}


def test_hard_texts(spark):
    assert detect.detect(notes_of(spark, None, "", " ")).count() == 0


def test_validity(spark):
    texts = [None, "", "  \n", "x", "😀" * 100_000, "😀" * 100_001]
    assert [r[0] for r in notes_of(spark, *texts).orderBy("doc_id").select(source_valid(F.col("text"))).collect()] == [False, False, False, True, True, False]


@pytest.mark.parametrize("text", ["a" * 100_000, "a@" * 50_000, "1" * 100_000, "0 1" * 33_000, "a." * 50_000, "flat " * 20_000])
def test_adversarial(spark, text):
    detect.detect(notes_of(spark, "x")).count()
    began = time.time()
    detect.detect(notes_of(spark, text)).count()
    assert time.time() - began < 20


def test_spans_against_re(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1 é😀") for _ in range(rng.randint(0, n))) for n in (5, 50, 3000) for _ in range(20)]
    df = notes_of(spark, *texts)
    for pattern in ("[0-9]+", "a|ab", "b ?b"):
        got = {r.doc_id: [(x.start, x.end, x.value) for x in r.s] for r in df.select("doc_id", find_spans(F.col("text"), pattern).alias("s")).collect()}
        assert got == {i: [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t)] for i, t in enumerate(texts)}


def evidence(spark, rows):
    full = [(d, i, c, s, e, st, 1.0) for i, (d, c, s, e, st) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, seq long, category string, start int, end int, stage string, confidence double")


def named(text, *pairs):
    return [(0, c, m.start(), m.end(), "ner") for p, c in pairs for m in re.finditer(re.escape(p), text)]


def built(spark, text, rows):
    notes = notes_of(spark, text)
    return notes, review.label(review.merge(evidence(spark, rows)), notes)


def accepted(items):
    return items.withColumn("decision", F.lit("accept"))


def output(notes, items):
    return review.render(notes, items).first().output


def test_grouping(spark):
    text = "Alex Morgan called Alex Morgan about 10 mg; no change."
    notes, items = built(spark, text, named(text, ("Alex Morgan", "PERSON")))
    assert output(notes, accepted(items)) == "[PERSON_1] called [PERSON_1] about 10 mg; no change."
    assert items.select("group").distinct().count() == 1


def test_split_and_keep(spark):
    text = "Sam met Sam."
    notes, items = built(spark, text, named(text, ("Sam", "PERSON")))
    second = items.where("item = 2").select("doc_id", "item")
    parted = review.split_item(accepted(items), second)
    assert output(notes, parted) == "[PERSON_1] met [PERSON_2]."
    kept = parted.withColumn("decision", F.when(F.col("item") == 2, "keep").otherwise("accept"))
    assert output(notes, kept) == "[PERSON_1] met Sam."


def test_label_collision(spark):
    text = "Sam met Sam."
    notes, items = built(spark, text, named(text, ("Sam", "PERSON")))
    edited = items.withColumn("replacement", F.lit("[PERSON_2]")).withColumn("decision", F.lit("edit"))
    parted = review.split_item(edited, items.where("item = 2").select("doc_id", "item"))
    assert output(notes, parted) == "[PERSON_2] met [PERSON_3]."


def test_overlap_takes_rule_category(spark):
    text = "alex@example.invalid"
    _, items = built(spark, text, [(0, "PERSON", 0, 4, "ner"), (0, "EMAIL", 0, 20, "rules")])
    row = items.first()
    assert (row.category, row.stages, row.replacement, row.start, row.end) == ("EMAIL", ["ner", "rules"], "[EMAIL_1]", 0, 20)


def test_touching_stay_apart(spark):
    _, items = built(spark, "abcd", [(0, "PERSON", 0, 2, "ner"), (0, "PERSON", 2, 4, "ner")])
    assert items.count() == 2


def test_unicode_offsets(spark):
    text = "🩺 Éva called Morgan."
    notes, items = built(spark, text, named(text, ("Éva", "PERSON"), ("Morgan", "PERSON")))
    assert output(notes, accepted(items)) == "🩺 [PERSON_1] called [PERSON_2]."
    first = detect.output_offsets(items.select("doc_id", "start", "end"), notes).orderBy("start").first()
    assert (first.start, first.start_utf16, first.start_byte) == (2, 3, 5)


def test_decisions(spark):
    text = "Ann met Bob and Cy."
    notes, items = built(spark, text, named(text, ("Ann", "PERSON"), ("Bob", "PERSON"), ("Cy", "PERSON")))
    rows = [(0, 1, "edit", "[X_1]"), (0, 2, "edit", "bad label"), (0, 3, "remove", None)]
    decided = review.decide(items, spark.createDataFrame(rows, "doc_id long, group long, decision string, label string"))
    assert [r.decision for r in decided.orderBy("start").collect()] == ["edit", "pending", "remove"]
    shown = review.render(notes, decided).first()
    assert (shown.output, shown.pending, shown.scan_text) == ("[X_1] met [PERSON_2] and .", 1, None)


def test_reopen(spark):
    text = "Sam met Sam."
    _, items = built(spark, text, named(text, ("Sam", "PERSON")))
    half = items.withColumn("decision", F.when(F.col("item") == 1, "accept").otherwise("pending"))
    assert {r.decision for r in review.reopen(half).collect()} == {"pending"}


def test_rescan(spark):
    text = "mail a@b.orgX now and c@d.org"
    rows = [(0, "MISC", text.index("X"), text.index("X") + 1, "manual")]
    notes, items = built(spark, text, rows)
    removed = items.withColumn("decision", F.lit("remove"))
    found = {(r.category, r.start, r.end) for r in review.rescan(notes, removed).collect()}
    assert found == {("EMAIL", 5, 12), ("EMAIL", 22, 29)}
    gate = review.gate(notes, removed).first()
    assert (gate.found_again, gate.may_copy) == (2, False)
    notes2, items2 = built(spark, text, [(0, "EMAIL", 5, 13, "rules"), (0, "EMAIL", 22, 29, "rules")])
    assert review.gate(notes2, accepted(items2)).first().may_copy
    kept = items2.withColumn("decision", F.lit("keep"))
    assert review.rescan(notes2, kept).count() == 0


def evidence_of(spark, rows):
    return spark.createDataFrame([(0, i, c, a, b, 1.0, s) for i, (c, a, b, s) in enumerate(rows)], "doc_id long, seq long, category string, start int, end int, confidence double, stage string")


def test_another_occurrence_reopens_its_group(spark):
    notes, items = built(spark, "Sam met Sam.", [(0, "PERSON", 0, 3, "ner")])
    items = accepted(items)
    find = lambda t: evidence_of(spark, [("PERSON", 8, 11, "ner")])
    # The rendered text has "[PERSON_1] met Sam.", masked: Sam stands at 15.
    shown = review.finish_scan(notes, items, find=lambda t: evidence_of(spark, [("PERSON", 15, 18, "ner")]))
    assert {(r.start, r.group, r.replacement, r.decision) for r in shown.collect()} == {(0, 1, "[PERSON_1]", "pending"), (8, 1, "[PERSON_1]", "pending")}
    again = review.finish_scan(notes, accepted(review.add_evidence(items, find(None), notes)), find=lambda t: evidence_of(spark, [("X", 0, 5, "ner")]).limit(0))
    assert {r.decision for r in again.collect()} == {"accept"}


def test_an_occurrence_that_grows_leaves_its_group(spark):
    text = "Sam Smith met Sam."
    notes, items = built(spark, text, [(0, "PERSON", 0, 3, "ner"), (0, "PERSON", 14, 17, "ner")])
    grown = review.add_evidence(accepted(items), evidence_of(spark, [("PERSON", 0, 9, "manual")]), notes).collect()
    first, second = sorted(grown, key=lambda r: r.start)
    assert (first.start, first.end, first.decision, first.phrase) == (0, 9, "pending", "Sam Smith") and second.decision == "accept"
    assert first.group != second.group and first.replacement == "[PERSON_2]" and second.replacement == "[PERSON_1]" and first.stages == ["manual", "ner"]


def test_rules_decide_the_category_on_entry(spark):
    notes, items = built(spark, "ab cdefgh", [(0, "PERSON", 3, 9, "ner")])
    out = review.add_evidence(accepted(items), evidence_of(spark, [("POSTCODE", 3, 9, "rules"), ("MISC", 0, 2, "ner")]), notes).collect()
    assert {(r.start, r.category, r.replacement, r.decision) for r in out} == {(3, "POSTCODE", "[POSTCODE_1]", "pending"), (0, "MISC", "[MISC_1]", "pending")}


def test_random_islands(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcde ") for _ in range(200))
    rows = [(d, rng.choice(["PERSON", "EMAIL"]), s, s + rng.randint(1, 12), rng.choice(["ner", "rules"])) for d in range(8) for s in (rng.randint(0, 180) for _ in range(25))]
    notes = notes_of(spark, *[text] * 8)
    items = review.label(review.merge(evidence(spark, rows)), notes)
    by = {}
    for r in items.orderBy("start").collect():
        by.setdefault(r.doc_id, []).append(r)
    for d, found in by.items():
        covered = {i for dd, _, s, e, _ in rows if dd == d for i in range(s, e)}
        assert {i for r in found for i in range(r.start, r.end)} == covered
        assert all(a.end <= b.start for a, b in zip(found, found[1:]))
        for r in found:
            own = sorted((st != "rules", s, e, i, c) for i, (dd, c, s, e, st) in enumerate(rows) if dd == d and r.start <= s and e <= r.end)
            assert r.category == own[0][4]
    kept = items.withColumn("decision", F.lit("keep"))
    assert {r.output for r in review.render(notes, kept).collect()} == {text}


def test_snapshot(spark):
    text = "Sam met Sam."
    notes, items = built(spark, text, named(text, ("Sam", "PERSON")))
    items = accepted(items)
    cols = ["doc_id", "item", "start", "end", "replacement", "decision"]
    back = review.restore(review.snapshot(items), notes)
    assert sorted(map(tuple, back.select(cols).collect())) == sorted(map(tuple, items.select(cols).collect()))
    broken = spark.createDataFrame([(0, "not json")], "doc_id long, snapshot string")
    assert review.restore(broken, notes).count() == 0


def test_evaluation(spark):
    text = "Ann and Ann saw Bob at a@b.org"
    notes = notes_of(spark, text)
    entities = spark.createDataFrame([(0, "PERSON", "Ann"), (0, "EMAIL", "a@b.org"), (0, "PERSON", "Bob")], "doc_id long, category string, phrase string")
    gold = evaluate.occurrences(notes, entities)
    assert sorted((r.start, r.end) for r in gold.collect()) == [(0, 3), (8, 11), (16, 19), (23, 30)]
    proposals = spark.createDataFrame([(0, "PERSON", 0, 3), (0, "MISC", 8, 12), (0, "EMAIL", 23, 30), (0, "MISC", 4, 7)], "doc_id long, category string, start int, end int")
    got = {r.category: tuple(r)[1:] for r in evaluate.by_category(gold, proposals).collect()}
    assert got == {"PERSON": (3, 2, 1, 1, 0), "EMAIL": (1, 1, 1, 1, 0), "MISC": (0, 0, 0, 2, 1)}
    rate = evaluate.token_fpr(notes, gold, proposals).first()
    assert (rate.negative_tokens, rate.false_positive_tokens) == (3, 1)
