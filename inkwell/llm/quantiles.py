"""Mergeable quantile summaries by simultaneous bisection multiselect.

A summary of a group of whole numbers keeps cut points with bounds on their
ranks. Nothing is sorted to find them: for every group all cut values are
searched at once, each by bisection between the group's least and greatest
value, and every pass counts exactly how many rows lie at or below each probe.
A probe that serves one target narrows all others of its group as well.

Rows are first counted by group and value, then packed into blocks of bounded
size. A group that fits into one block is searched to the end in the task that
holds the block; for larger ones each pass is a job over all their blocks, whose
counts are added up before and after the shuffle, so a group with a third of
all rows is many blocks' work. A group with no more values than a summary has
cut points anyway keeps all of them.

Summaries merge by adding up, at each cut point of any of them, the bounds that
each gives for the rows at or below and below that value. No row is read again.

Bounds. With p parts a summary has the ranks ceil(j*n/p) exactly, so less than
n/p rows lie strictly between neighbours, in it and in a merge of any number of
such summaries: an answer is off by at most n/p ranks, and by none for a single
summary if the asked rank is among its own. Each summary also has ``distinct``
evenly spaced values of the group, so it is not poorer than its values allow
where most rows are ties.

Null keys are a group like others. No rows give no summaries. Repeated rows and
ties count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Parts of a summary by rank and by value, and the most points after a merge.
PARTS, DISTINCT, POINTS = 100, 20, 2000
#: Distinct values in a block, about (4 MB), and steps of bisection in one pass.
BLOCK, STEPS = 1 << 18, 3
CUT = "x bigint, below_lo bigint, below_hi bigint, upto_lo bigint, upto_hi bigint"
POINT_LIST = f"array<struct<{CUT.replace(' ', ':').replace(',:', ',')}>>"
_CUTS = pa.list_(pa.struct([(c.split()[0], pa.int64()) for c in CUT.split(", ")]))
_LONGS = pa.list_(pa.int64())


# ---- counting -----------------------------------------------------------


def counts_upto(xs: np.ndarray, weights: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Weight of the values at or below each of the ascending probes."""
    slot = np.searchsorted(probes, xs, side="left")
    per = np.bincount(slot, weights, len(probes) + 1)
    return np.cumsum(per.astype(np.int64))[:-1]


def probes_between(low: np.ndarray, high: np.ndarray, steps: int) -> np.ndarray:
    """What ``steps`` bisections of every (low, high] can ask for, ascending."""
    edges = [low, high]
    for _ in range(steps):
        edges = [m for a, b in zip(edges, edges[1:], strict=False) for m in (a, a + (b - a) // 2)] + [edges[-1]]
    inner = np.concatenate(edges[1:-1])
    # With the greatest value there is always something to count.
    return np.unique(np.append(inner[inner > np.tile(low, len(edges) - 2)], high.max()))


def narrowed(low: np.ndarray, high: np.ndarray, ranks: np.ndarray, probes: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high] after the counts at ``probes``: the least value with at
    least ``rank`` rows at or below it stays inside."""
    first = np.searchsorted(upto, ranks, side="left")
    low = np.maximum(low, np.where(first > 0, probes[np.maximum(first, 1) - 1], low))
    high = np.minimum(high, np.where(first < len(probes), probes[np.minimum(first, len(probes) - 1)], high))
    return low, high


def ranks_of(n: int, d: int, parts: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Target ranks among rows and among distinct values; the least value is one."""
    by_row = np.unique(np.maximum(1, -(-np.arange(parts + 1) * n // parts)))
    return by_row, np.unique(-(-np.arange(1, distinct + 1) * d // distinct)) if distinct else np.empty(0, np.int64)


def select_in_block(xs: np.ndarray, weights: np.ndarray, ranks: np.ndarray, dranks: np.ndarray) -> np.ndarray:
    """Values at the ranks, for a group in one block: (row ranks, then value ranks)."""
    low = np.full(len(ranks) + len(dranks), xs.min() - 1)
    high = np.full_like(low, xs.max())
    k = len(ranks)
    while (high - low > 1).any():
        probes = np.unique((low + (high - low) // 2)[high - low > 1])
        low[:k], high[:k] = narrowed(low[:k], high[:k], ranks, probes, counts_upto(xs, weights, probes))
        if len(dranks):
            low[k:], high[k:] = narrowed(low[k:], high[k:], dranks, probes, counts_upto(xs, None, probes))
    return high


# ---- blocks -------------------------------------------------------------


def counted(rows: DataFrame, keys: list[str], x: str = "x", count: str | None = None) -> DataFrame:
    """(keys, x, c): how often each group has each value. Null values don't count."""
    return rows.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("bigint").alias("x")).agg((F.count(F.lit(1)) if count is None else F.sum(count)).alias("c"))


@dataclass
class Blocks:
    """(keys, xs, cs) of groups in one block each, and (keys, n, d, least, most,
    xs, cs) of the blocks of larger groups, or None if there are none."""

    local: DataFrame
    wide: DataFrame | None


def blocks_of(cells: DataFrame, keys: list[str], block: int = BLOCK) -> Blocks:
    """Pack written ``counted`` rows. What groups exceed a block is known from
    a count; only their rows are dealt by hash."""
    arrays = [F.col("z.x").alias("xs"), F.col("z.c").alias("cs")]
    packed = F.collect_list(F.struct("x", "c")).alias("z")
    sizes = cells.groupBy(*keys).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"), F.min("x").alias("least"), F.max("x").alias("most"))
    large = written(sizes.where(F.col("d") > block), "large")
    if large.limit(1).count() == 0:
        return Blocks(written(cells.groupBy(*keys).agg(packed).select(*keys, *arrays), "blocks"), None)
    few = _joined(cells, large.select(*keys), keys, "left_anti")
    salted = _joined(cells, large, keys).withColumn("_salt", F.pmod(F.xxhash64("x"), F.ceil(F.col("d") / block)))
    own = [*keys, "n", "d", "least", "most"]
    # An exchange of its own, so that the join's skewed keys may be split.
    dealt = salted.repartition(*keys, "_salt").groupBy(*own, "_salt").agg(packed).select(*own, *arrays)
    return Blocks(written(few.groupBy(*keys).agg(packed).select(*keys, *arrays), "blocks"), written(dealt, "wide"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match; ``right`` has one row for each key and
    is never broadcast, for it grows with the data."""
    names = {k: f"_r_{k}" for k in keys}
    right = right.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in right.columns if c not in names])
    on = None
    for k, n in names.items():
        same = F.col(k).eqNullSafe(F.col(n))
        on = same if on is None else on & same
    return left.join(right.hint("shuffle_hash"), on, how).drop(*names.values())


def _passed(df: DataFrame, keys: list[str], run, added: list[tuple[str, str]], kept: list[str]) -> DataFrame:
    """``df`` through ``run``, which makes the columns ``added`` of an Arrow
    batch; keys and ``kept`` go through."""
    through = [*keys, *kept]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in through] + [f"{a} {t}" for a, t in added])
    names = [*through, *[a for a, _ in added]]

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in through], *run(batch)], names=names)

    return df.mapInArrow(work, schema)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _as_lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else [], pa.int64()))


def _cut_lists(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Array:
    """Exact cut points: both bounds of a rank are the same."""
    offsets = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts]))).astype(np.int32)
    x, below, upto = (pa.array(np.concatenate([p[i] for p in parts]), pa.int64()) for i in range(3))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([x, below, below, upto, upto], fields=list(_CUTS.value_type)))


def count_at(blocks: DataFrame, keys: list[str], asked: DataFrame) -> DataFrame:
    """(keys, probes, rows, values): rows and distinct values at or below each
    of a group's ascending ``probes`` (column of ``asked``), by one pass."""

    def run(batch):
        probes, at = _lists(batch["probes"])
        xs, ends = _lists(batch["xs"])
        cs, _ = _lists(batch["cs"])
        rows, values = [], []
        for i in range(batch.num_rows):
            x, p = xs[ends[i] : ends[i + 1]], probes[at[i] : at[i + 1]]
            rows.append(counts_upto(x, cs[ends[i] : ends[i + 1]], p))
            values.append(counts_upto(x, None, p))
        return _as_lists(rows), _as_lists(values)

    with small_batches(blocks.sparkSession):
        per = _passed(_joined(blocks, asked, keys), keys, run, [("rows", "array<bigint>"), ("values", "array<bigint>")], ["probes"])
        each = per.select(*keys, F.posexplode(F.arrays_zip("probes", "rows", "values")).alias("at", "z"))
        summed = each.groupBy(*keys, "at", F.col("z.probes").alias("probe")).agg(F.sum("z.rows").alias("rows"), F.sum("z.values").alias("values"))
        whole = summed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "probe", "rows", "values"))).alias("z"))
        return written(whole.select(*keys, F.col("z.probe").alias("probes"), F.col("z.rows").alias("rows"), F.col("z.values").alias("values")), "counts")


# ---- summaries ----------------------------------------------------------


def summarise(blocks: Blocks, keys: list[str], parts: int = PARTS, distinct: int = DISTINCT, steps: int = STEPS) -> DataFrame:
    """(keys, n, points): one summary for each group of ``blocks_of``."""

    def in_block(batch):
        xs, ends = _lists(batch["xs"])
        cs, _ = _lists(batch["cs"])
        ns, cuts = [], []
        for a, b in zip(ends, ends[1:], strict=False):
            x, c = xs[a:b], cs[a:b]
            n, d = int(c.sum()), len(x)
            if d > parts + distinct:
                at = np.unique(select_in_block(x, c, *ranks_of(n, d, parts, distinct)))
                upto, below = counts_upto(x, c, at), counts_upto(x, c, at - 1)
            else:
                # Every value is a cut point.
                order = np.argsort(x)
                at, upto = x[order], np.cumsum(c[order])
                below = upto - c[order]
            ns.append(n)
            cuts.append((at, below, upto))
        return pa.array(ns, pa.int64()), _cut_lists(cuts)

    with small_batches(blocks.local.sparkSession):
        found = written(_passed(blocks.local, keys, in_block, [("n", "bigint"), ("points", POINT_LIST)], []), "summaries")
    if blocks.wide is None:
        return found
    return found.unionByName(select_ranks(blocks.wide, keys, parts, distinct, steps))


def select_ranks(wide: DataFrame, keys: list[str], parts: int, distinct: int, steps: int = STEPS) -> DataFrame:
    """``summarise`` for groups of several blocks: each pass over them asks for
    ``steps`` halvings of every interval of every group."""
    own = [*keys, "n", "d", "least", "most"]
    span = wide.agg(F.max(F.col("most").cast("decimal(20)") - F.col("least"))).first()[0] or 0
    arrays = [("low", "array<bigint>"), ("high", "array<bigint>")]
    state = written(_passed(wide.select(*own).distinct(), keys, _first_state(parts, distinct), arrays, ["n", "d"]), "state")
    for _ in range(-(-(int(span) + 1).bit_length() // steps)):
        asked = _passed(state, keys, _ask(steps), [("probes", "array<bigint>")], [])
        state = written(_passed(_joined(state, count_at(wide, keys, asked), keys), keys, _update(parts, distinct), arrays, ["n", "d"]), "state")
    at = state.select(*keys, F.array_sort(F.array_distinct("high")).alias("at"))
    counts = count_at(wide, keys, _with_before(at, keys))
    ends = _joined(_joined(state.select(*keys, "n"), at, keys), counts, keys)
    return written(_passed(ends, keys, _cuts_from_counts, [("points", POINT_LIST)], ["n"]), "summaries")


def _with_before(at: DataFrame, keys: list[str]) -> DataFrame:
    """Probes that count what is below and up to each value of ``at``."""
    return at.select(*keys, F.array_sort(F.array_distinct(F.concat("at", F.transform("at", lambda x: x - 1)))).alias("probes"))


def _first_state(parts: int, distinct: int):
    def run(batch):
        low, high = [], []
        for n, d, least, most in zip(*(batch[c].to_pylist() for c in ("n", "d", "least", "most")), strict=True):
            k = sum(map(len, ranks_of(n, d, parts, distinct)))
            low.append(np.full(k, least - 1, np.int64))
            high.append(np.full(k, most, np.int64))
        return _as_lists(low), _as_lists(high)

    return run


def _ask(steps: int):
    def run(batch):
        low, ends = _lists(batch["low"])
        high, _ = _lists(batch["high"])
        return (_as_lists([probes_between(low[a:b], high[a:b], steps) for a, b in zip(ends, ends[1:], strict=False)]),)

    return run


def _update(parts: int, distinct: int):
    def run(batch):
        low, ends = _lists(batch["low"])
        high, _ = _lists(batch["high"])
        probes, at = _lists(batch["probes"])
        rows, _ = _lists(batch["rows"])
        values, _ = _lists(batch["values"])
        lows, highs = [], []
        for i, (n, d) in enumerate(zip(batch["n"].to_pylist(), batch["d"].to_pylist(), strict=True)):
            ranks, dranks = ranks_of(n, d, parts, distinct)
            a, b, own = low[ends[i] : ends[i + 1]], high[ends[i] : ends[i + 1]], slice(at[i], at[i + 1])
            k = len(ranks)
            by_row = narrowed(a[:k], b[:k], ranks, probes[own], rows[own])
            by_value = narrowed(a[k:], b[k:], dranks, probes[own], values[own])
            lows.append(np.concatenate((by_row[0], by_value[0])))
            highs.append(np.concatenate((by_row[1], by_value[1])))
        return _as_lists(lows), _as_lists(highs)

    return run


def _cuts_from_counts(batch):
    cut, ends = _lists(batch["at"])
    probes, at = _lists(batch["probes"])
    rows, _ = _lists(batch["rows"])
    cuts = []
    for i in range(batch.num_rows):
        x, p, r = cut[ends[i] : ends[i + 1]], probes[at[i] : at[i + 1]], rows[at[i] : at[i + 1]]
        cuts.append((x, r[np.searchsorted(p, x - 1)], r[np.searchsorted(p, x)]))
    return (_cut_lists(cuts),)


def merge(summaries: DataFrame, keys: list[str], limit: int = POINTS) -> DataFrame:
    """(keys, n, points): the summaries of a key merged into one, from their
    points alone. It is a summary like others and can be merged again. Beyond
    ``limit`` points half of that number is kept by rank and half by place, the
    first and the last among them; bounds stay right and grow by the step in rank."""
    each = summaries.select(
        *keys,
        F.inline(
            F.transform(
                "points",
                lambda p, i: F.struct(
                    p["x"].alias("x"),
                    (p["upto_lo"] - F.coalesce(F.get("points", i - 1)["upto_lo"], F.lit(0))).alias("d_lo"),
                    (F.coalesce(F.get("points", i + 1)["below_hi"], F.col("n")) - p["below_hi"]).alias("d_hi"),
                    (p["below_lo"] - F.coalesce(F.get("points", i - 1)["upto_lo"], F.lit(0))).alias("d_below"),
                    (p["upto_hi"] - p["below_hi"]).alias("d_upto"),
                ),
            )
        ),
    )
    steps = each.groupBy(*keys, "x").agg(*[F.sum(c).alias(c) for c in ("d_lo", "d_hi", "d_below", "d_upto")])
    # Points of one key: at most those of its summaries, however many rows these have.
    packed = steps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "d_lo", "d_hi", "d_below", "d_upto"))).alias("z"), F.sum("d_lo").alias("_all"))

    def run(batch):
        z = batch["z"]
        offsets = z.offsets.to_numpy()
        flat = z.values
        x, d_lo, d_hi, d_below, d_upto = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
        parts = []
        for a, b in zip(offsets, offsets[1:], strict=False):
            lo, hi = np.cumsum(d_lo[a:b]), np.cumsum(d_hi[a:b])
            lo_before, hi_before = lo - d_lo[a:b], hi - d_hi[a:b]
            keep = np.arange(b - a)
            if b - a > limit:
                half = limit // 2
                by_rank = np.searchsorted(lo, -(-np.arange(half) * lo[-1] // (half - 1)))
                keep = np.union1d(by_rank, (b - a - 1) * np.arange(half) // (half - 1))
            parts.append([v[keep] for v in (x[a:b], lo_before + d_below[a:b], hi_before, lo, hi_before + d_upto[a:b])])
        ends = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts]))).astype(np.int32)
        fields = [pa.array(np.concatenate([p[i] for p in parts]), pa.int64()) for i in range(5)]
        return (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_CUTS.value_type))),)

    with small_batches(summaries.sparkSession):
        out = _passed(packed.withColumnRenamed("_all", "n"), keys, run, [("points", POINT_LIST)], ["n"])
        return written(out, "merged")


def estimates(points: tuple[np.ndarray, np.ndarray, np.ndarray], targets: np.ndarray) -> np.ndarray:
    """For each target the place of the point whose rank is off from it by
    least, at worst; of equals the first. It doesn't fall as the target rises.
    ``points``: x, below_hi, upto_lo."""
    _, below, upto = points
    # A point at or behind the first that surely reaches the target is never
    # better than it, so the search may stop there.
    stop = int(np.searchsorted(upto, targets[-1])) + 1
    off = np.maximum(np.maximum(below[None, :stop] + 1 - targets[:, None], targets[:, None] - upto[None, :stop]), 0)
    return off.argmin(axis=1)


def answers(summaries: DataFrame, keys: list[str], quantiles: int, least: int) -> DataFrame:
    """(keys, n, kept, found) of summaries of at least ``least`` rows; ``found``
    has for each i in 1..quantiles-1 the target ceil(i*n/quantiles), the answer,
    and the answer's rank bounds."""

    def run(batch):
        lists = batch["points"]
        ends = lists.offsets.to_numpy()
        x, below_lo, below_hi, upto_lo, upto_hi = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(5))
        i = np.arange(1, quantiles)
        columns = [[] for _ in range(6)]
        for n, a, b in zip(batch["n"].to_pylist(), ends, ends[1:], strict=False):
            targets = -(-i * n // quantiles)
            at = a + estimates((x[a:b], below_hi[a:b], upto_lo[a:b]), targets)
            for column, values in zip(columns, (i, targets, x[at], below_lo[at], upto_lo[at], np.maximum(below_hi[at] - below_lo[at], upto_hi[at] - upto_lo[at])), strict=True):
                column.append(values)
        flat = [pa.array(np.concatenate(c), pa.int64()) for c in columns]
        rows = pa.StructArray.from_arrays(flat, fields=[pa.field(n, pa.int64()) for n in ANSWER])
        return pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (quantiles - 1), pa.int32()), rows)

    kind = f"array<struct<{','.join(f'{n}:bigint' for n in ANSWER)}>>"
    return _passed(summaries.where(F.col("n") >= least), keys, run, [("kept", "bigint"), ("found", kind)], ["n"])


#: i, target, answer, its least rank bounds, and how far apart bounds are.
ANSWER = ("i", "target", "answer", "n_below", "n_upto", "open")
EXACT = ("i", "target", "answer", "exact_x", "n_below", "n_upto")


def exact_of_points(answered: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, kept, EXACT) of single summaries, whose ranks were counted.
    Their own ranks hold the targets, so the answer is the exact value; where
    that isn't so (other ranks were asked for) exact_x is null."""
    rows = answered.select(*keys, "n", "kept", F.inline("found"))
    hit = (F.col("n_below") < F.col("target")) & (F.col("target") <= F.col("n_upto")) & (F.col("open") == 0)
    return rows.select(*keys, "n", "kept", "i", "target", "answer", F.when(hit, F.col("answer")).alias("exact_x"), "n_below", "n_upto")


def with_exact(answered: DataFrame, blocks: Blocks, keys: list[str], quantiles: int) -> DataFrame:
    """(keys, n, kept, EXACT): ``answers`` with exact_x, the least value with
    ``target`` rows at or below it, and the rows below and up to each answer,
    counted anew over all rows."""
    answered = written(answered, "answers")

    def in_block(batch):
        xs, ends = _lists(batch["xs"])
        cs, _ = _lists(batch["cs"])
        found = batch["found"]
        at = found.offsets.to_numpy()
        i, target, answer = (found.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        exact, below, upto = (np.zeros(len(i), np.int64) for _ in range(3))
        for k in range(batch.num_rows):
            order = np.argsort(xs[ends[k] : ends[k + 1]])
            x, c, own = xs[ends[k] : ends[k + 1]][order], cs[ends[k] : ends[k + 1]][order], slice(at[k], at[k + 1])
            total = np.cumsum(c)
            exact[own] = x[np.searchsorted(total, target[own])]
            place = np.searchsorted(x, answer[own])
            upto[own], below[own] = total[place], total[place] - c[place]
        own = slice(at[0], at[-1])
        flat = [pa.array(v[own], pa.int64()) for v in (i, target, answer, exact, below, upto)]
        rows = pa.StructArray.from_arrays(flat, fields=[pa.field(n, pa.int64()) for n in EXACT])
        return (pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32), pa.int32()), rows),)

    kind = f"array<struct<{','.join(f'{n}:bigint' for n in EXACT)}>>"
    with small_batches(blocks.local.sparkSession):
        got = _passed(_joined(blocks.local, answered, keys), keys, in_block, [("exact", kind)], ["n", "kept"])
        local = written(got.select(*keys, "n", "kept", F.inline("exact")), "exact")
    if blocks.wide is None:
        return local
    own = _joined(blocks.wide, answered.select(*keys), keys)
    exact = select_ranks(own, keys, quantiles, 0).select(*keys, F.col("points").alias("exact"))
    asked = _joined(answered, blocks.wide.select(*keys).distinct(), keys)
    counts = count_at(own, keys, _with_before(asked.select(*keys, F.array_distinct("found.answer").alias("at")), keys))
    rows = _joined(_joined(asked, exact, keys), counts, keys).select(*keys, "n", "kept", "exact", F.map_from_arrays("probes", "rows").alias("seen"), F.inline("found"))
    hit = F.filter("exact", lambda p: p["upto_lo"] >= F.col("target"))
    counted_rows = [F.get(hit, F.lit(0))["x"].alias("exact_x"), F.element_at("seen", F.col("answer") - 1).alias("n_below"), F.element_at("seen", F.col("answer")).alias("n_upto")]
    return local.unionByName(rows.select(*keys, "n", "kept", "i", "target", "answer", *counted_rows))
