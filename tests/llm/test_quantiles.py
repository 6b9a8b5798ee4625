"""Quantile summaries against sorted lists."""

import bisect
import math
import random

import pytest
from inkwell.llm import quantiles as Q
from pyspark.sql import functions as F

KEYS = ["g", "b"]


def rows_for(seed):
    rng = random.Random(seed)
    rows = [("hot", rng.randrange(3), rng.randrange(-(10**6), 10**6)) for _ in range(6000)]
    rows += [("ties", 0, 7)] * 3000 + [("ties", 0, rng.randrange(40)) for _ in range(60)]
    rows += [("tail", 0, x) for x in range(300)] + [("tail", 0, 150)] * 20_000
    rows += [("one", 0, -5), (None, 0, 3), (None, None, 4), ("same", 1, 9), ("same", 1, 9)]
    return rows + [("mid", rng.randrange(2), int(rng.gauss(0, 50))) for _ in range(3000)] + [("null", 0, None)]


@pytest.fixture(scope="module", params=[100, 8192])
def case(request, spark):
    """Groups in many blocks and groups in one."""
    rows = rows_for(1)
    df = spark.createDataFrame(rows, "g string, b int, x long")
    blocks = Q.blocks_of(Q.counted(df, KEYS).cache(), KEYS, block=request.param)
    groups = {}
    for g, b, x in rows:
        if x is not None:
            groups.setdefault((g, b), []).append(x)
    return blocks, {k: sorted(v) for k, v in groups.items()}


def test_cut_points_have_exact_ranks(case):
    blocks, groups = case
    got = {(r.g, r.b): r for r in Q.summarise(blocks, KEYS).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        n, points, values = len(xs), got[k].points, sorted(set(xs))
        assert got[k].n == n and min(20, len(values)) <= len(points) <= min(n, 2000)
        at = [p.x for p in points]
        assert at == sorted(set(at))
        for p in points:
            assert (p.below_lo, p.upto_lo) == (p.below_hi, p.upto_hi) == (bisect.bisect_left(xs, p.x), bisect.bisect_right(xs, p.x))
        want = {xs[max(1, math.ceil(j * n / 100)) - 1] for j in range(101)} | {values[math.ceil(j * len(values) / 20) - 1] for j in range(1, 21)}
        assert set(at) == (want if len(values) > 120 else set(values))


def test_merge_keeps_bounds_and_answers_within_one_percent(case):
    blocks, groups = case
    merged = Q.merge(Q.summarise(blocks, KEYS).drop("b"), ["g"])
    whole = {}
    for (g, _), xs in groups.items():
        whole.setdefault(g, []).extend(xs)
    rows = {r.g: r for r in merged.collect()}
    assert set(rows) == set(whole)
    for g, xs in whole.items():
        xs.sort()
        assert rows[g].n == len(xs)
        for p in rows[g].points:
            assert p.below_lo <= bisect.bisect_left(xs, p.x) <= p.below_hi
            assert p.upto_lo <= bisect.bisect_right(xs, p.x) <= p.upto_hi
    # A merge of merges is a summary as well.
    again = Q.merge(merged.withColumn("g", F.lit("all")), ["g"], limit=150)
    everything = sorted(x for xs in whole.values() for x in xs)
    assert len(again.first().points) <= 150
    for summary, of in ((merged, whole), (again, {"all": everything})):
        last = {}
        for r in Q.answers(summary, ["g"], 20, 20).select("g", F.inline("found")).orderBy("g", "i").collect():
            xs = of[r.g]
            assert r.target == math.ceil(r.i * len(xs) / 20) and xs[0] <= r.answer <= xs[-1] and r.answer >= last.get(r.g, r.answer)
            last[r.g] = r.answer
            off = max(0, bisect.bisect_left(xs, r.answer) + 1 - r.target, r.target - bisect.bisect_right(xs, r.answer))
            assert off <= len(xs) * (0.01 if summary is merged else 0.05)


def test_exact_check_counts_rows(case, spark):
    blocks, groups = case
    got = Q.with_exact(Q.answers(Q.summarise(blocks, KEYS), KEYS, 20, 20), blocks, KEYS, 20).collect()
    same = Q.exact_of_points(Q.answers(Q.summarise(blocks, KEYS), KEYS, 20, 20), KEYS).collect()
    assert {(r.g, r.b) for r in got} == {(r.g, r.b) for r in same} == {k for k, v in groups.items() if len(v) >= 20}
    for r in [*got, *same]:
        xs = groups[r.g, r.b]
        assert r.exact_x == r.answer == xs[r.target - 1]
        assert (r.n_below, r.n_upto) == (bisect.bisect_left(xs, r.answer), bisect.bisect_right(xs, r.answer))


def test_no_rows_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "g string, b int, x long, n int, points string")
    summaries = Q.summarise(Q.blocks_of(Q.counted(empty, KEYS), KEYS), KEYS)
    assert summaries.count() == 0 and Q.merge(summaries.drop("b"), ["g"]).count() == 0
    assert Q.answers(summaries, KEYS, 20, 20).count() == 0
