"""Exact deduplication by streams, against plain Python."""

import hashlib
import random
import re

import pytest
from inkwell.llm import exact_dedup as D
from inkwell.llm import queries as Q
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, digest string, size int, path string"
SPACE = re.compile("[\x20\x09-\x0d]+")


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) for (doc_id, text) rows, sorted."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(SPACE.sub("", text or ""), []).append((doc, len(text or "")))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        out += [(doc, keep, len(members), norm) for doc, _ in members]
    return sorted(((d, k, n, d == k, hashlib.sha256(t.encode()).hexdigest()) for d, k, n, t in out), key=str)


def seen(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()], key=str)


def put(spark, folder, rows, parts=1):
    made = [(d, t, "x", 1, "y") for d, t in rows]
    spark.createDataFrame(made, SCHEMA).repartition(parts).write.mode("append").parquet(folder)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["aa", "b", "😀é", "long" * 9]
    few = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    out = [(i, rng.choice(few).replace(" ", rng.choice([" ", "", "\t", "\n\n", "\x0b \r"]))) for i in range(700)]
    out += [(i, "hot copy" + " " * (i % 3)) for i in range(700, 1400)]
    # Other kinds of space are text; nothing, null and white space are equal.
    out += [(1400, None), (1401, ""), (1402, " \t\n"), (1403, " "), (1404, "a b"), (1405, "x" * 200_000), (1406, "x " * 200_000)]
    return out


def test_two_runs_read_new_files_only(spark, tmp_path, texts):
    source, folder = f"{tmp_path}/docs", f"{tmp_path}/state"
    put(spark, source, texts[:900], 3)
    assert seen(D.deduplicate(spark, source, folder, files=1)) == brute(texts[:900])
    # Later files have longer originals, so that other rows stay.
    put(spark, source, texts[900:], 2)
    assert seen(D.deduplicate(spark, source, folder)) == brute(texts)
    assert spark.read.parquet(f"{folder}/fingerprints").groupBy("run").count().orderBy("run").collect() == [(0, 900), (1, len(texts) - 900)]
    assert seen(D.deduplicate(spark, source, folder)) == brute(texts)


@pytest.mark.parametrize("runs", [1, 2])
def test_rows_with_one_digest_and_other_bytes_are_told_apart(spark, tmp_path, texts, runs):
    source, folder = f"{tmp_path}/docs", f"{tmp_path}/state"
    weak = lambda sha: F.substring(sha, 1, 1)
    cut = len(texts) // 2 if runs == 2 else len(texts)
    put(spark, source, texts[:cut])
    assert seen(D.deduplicate(spark, source, folder, group=weak)) == brute(texts[:cut])
    if runs == 2:
        put(spark, source, texts[cut:])
        assert seen(D.deduplicate(spark, source, folder, group=weak)) == brute(texts)


def test_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, "a b"), (1, "a b"), (1, "other"), (None, "a  b  "), (2, "ab"), (None, "z"), (None, "z")]
    source = f"{tmp_path}/docs"
    put(spark, source, rows)
    got = D.deduplicate(spark, source, f"{tmp_path}/state")
    # One row of each class stays; the longest has no id.
    assert got.where("stays").count() == 3
    assert sorted((r.doc_id, r.group_size) for r in got.collect() if r.doc_id) == [(1, 1), (1, 4), (1, 4), (2, 4)]


def test_no_rows(spark, tmp_path):
    put(spark, f"{tmp_path}/docs", [])
    assert seen(D.deduplicate(spark, f"{tmp_path}/docs", f"{tmp_path}/state")) == []


def test_query_over_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert seen(Q.op13_exact_dedup(spark, sf)) == brute(rows)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
