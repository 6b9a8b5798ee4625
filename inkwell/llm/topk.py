"""Exact top-k inner products without random access (NRA).

The vectors are dealt into parts that fit in memory; every query visits every
part once, and a part's best k for it go on. In a part each component's values
form a sorted list. For a query the lists are read one after another from the
end that favours it, in rounds of a common depth. What was read adds up to
partial scores; what wasn't lies between the reading's frontier and the list's
far end, which gives every vector a lower and an upper bound. A query is done
with a block when the vectors that can still be among its k best are read
whole: their scores are then sums of what was read, and nothing is looked up.
The k-th score of the blocks so far is a bound for the next block, so that most
are left early.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K, SCALE, EVERY = 10, 1024, 100
#: Bytes of vectors in a part; vectors whose lists are read together; queries
#: that read side by side.
PART_BYTES, VECTORS, QUERIES = 64 << 20, 2048, 64
#: Share of the lists that is read after each round.
DEPTHS = (0.125, 0.25, 0.5, 0.75, 1.0)
EXACT = 1 << 53
LONG = (1 << 63) - 1
DIGIT = 50
FOUND = ("query_id", "vec_id", "score", "s2", "s1", "s0")


class Lists:
    """The sorted lists of a block of vectors (whole numbers)."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.ids, self.whole = ids, vectors
        x = vectors.astype(np.float64)
        #: A row for each list, from its smallest value on.
        self.order = np.argsort(x.T, axis=1, kind="stable")
        self.values = np.take_along_axis(x.T, self.order, axis=1)
        self.rank = np.empty(x.shape, np.int32)
        np.put_along_axis(self.rank, self.order.T, np.arange(len(x), dtype=np.int32)[:, None], axis=0)
        #: The largest size of a value in each list.
        self.most = np.abs(x).max(axis=0, initial=0.0)


def _scores(lists: Lists, near: np.ndarray, partial: np.ndarray, query: np.ndarray, exact: bool) -> list[int]:
    """Final scores of vectors that were read whole. Beyond what doubles hold
    exactly, the values that were read are added up as whole numbers."""
    if exact:
        return [int(s) for s in partial[near]]
    numbers = [int(v) for v in query]
    return [sum(a * int(b) for a, b in zip(numbers, lists.whole[i], strict=True)) for i in near]


def read_lists(lists: Lists, queries: np.ndarray, query_ids: np.ndarray, k: int, floors: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each query (score, id) of every vector of the block that can be among
    its k best, its own id left out. ``floors``: scores that k vectors of other
    blocks reach already."""
    dims, n = lists.values.shape
    q = queries.astype(np.float64)
    size = np.abs(q) @ lists.most
    exact = bool((2 * size < EXACT).all()) and int(np.abs(queries).max(initial=0)) < EXACT and float(lists.most.max(initial=0)) < EXACT
    # How far sums of doubles may be off.
    off = np.zeros(len(q)) if exact else size * (dims + 4) * 2.0**-50
    found: list[list[tuple[int, int]]] = [[] for _ in q]
    # A row for each vector: what is read of a list is added to whole rows.
    partial, live, read = np.zeros((n, len(q))), np.arange(len(q)), 0
    up, down = np.maximum(q, 0).T.copy(), np.minimum(q, 0).T.copy()
    for share in DEPTHS:
        depth = n if share >= 1 else min(n, max(k, int(share * n)))
        for j in range(dims if depth > read else 0):
            # From the top for positive weights, from the bottom for negative ones.
            for weights, part in ((up[j], slice(n - depth, n - read)), (down[j], slice(read, depth))):
                if weights.any():
                    partial[lists.order[j, part]] += lists.values[j, part][:, None] * weights
        read = depth
        if depth < n:
            rest_up, rest_down = (lists.rank < n - depth).astype(np.float64), (lists.rank >= depth).astype(np.float64)
            upper = partial + rest_up @ (up * lists.values[:, n - depth][:, None]) + rest_down @ (down * lists.values[:, depth - 1][:, None])
            lower = partial + rest_up @ (up * lists.values[:, :1]) + rest_down @ (down * lists.values[:, -1:])
            unread = rest_up @ (up > 0).astype(np.float64) + rest_down @ (down < 0).astype(np.float64)
        else:
            upper, lower, unread = partial.copy(), partial.copy(), np.zeros(partial.shape)
        upper, lower = upper + off[live], lower - off[live]
        itself = lists.ids[:, None] == query_ids[live]
        lower[itself] = -np.inf
        kth = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(live), -np.inf)
        may = (upper >= np.maximum(kth, floors[live])) & ~itself
        done = ~(may & (unread > 0)).any(axis=0)
        for i in np.flatnonzero(done):
            near = np.flatnonzero(may[:, i])
            scores = _scores(lists, near, partial[:, i], queries[live[i]], exact)
            found[live[i]] = [(s, int(lists.ids[v])) for s, v in zip(scores, near, strict=True)]
        if done.all():
            break
        if done.any():
            live = live[~done]
            partial, up, down = (np.compress(~done, a, axis=1) for a in (partial, up, down))
    return found


def best_of(blocks: list[Lists], queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score): each query's k best of all blocks, by (score,
    smaller id)."""
    best: list[list[tuple[int, int]]] = [[] for _ in queries]
    floors = np.full(len(queries), -np.inf)
    for lists in blocks:
        for i, got in enumerate(read_lists(lists, queries, query_ids, k, floors)):
            if got:
                best[i] = sorted(best[i] + got, key=lambda x: (-x[0], x[1]))[:k]
                if len(best[i]) == k:
                    # A double below the score, where it can't be held.
                    floors[i] = math.nextafter(float(best[i][-1][0]), -math.inf) if abs(best[i][-1][0]) >= EXACT else best[i][-1][0]
    return [(int(query), v, s) for query, own in zip(query_ids, best, strict=True) for s, v in own]


def nra_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int = K) -> list[tuple[int, int, int]]:
    """(query, vector, score): each query's k best of one block, but for
    vectors with the query's own id."""
    if not len(vectors) or not len(queries):
        return []
    return best_of([Lists(vectors, ids)], queries, query_ids, k)


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Whole components of a column of vectors, padded with zeros."""
    length = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims)[None, :] < length[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _work(k: int, dims: int):
    """Over partitions whose rows are ordered by part, the vectors of a part
    (kind 0) before the queries that visit it (kind 1)."""

    def answers(blocks: list[Lists], queries: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        got = [x for at in range(0, len(ids), QUERIES) for x in best_of(blocks, queries[at : at + QUERIES], ids[at : at + QUERIES], k)]
        # A score in three longs, in whose order scores order; as one long it
        # ends at the longs' ends.
        digits = (lambda s: max(-LONG - 1, min(LONG, s)), lambda s: s >> 2 * DIGIT, lambda s: s >> DIGIT & (1 << DIGIT) - 1, lambda s: s & (1 << DIGIT) - 1)
        columns = [[g[0] for g in got], [g[1] for g in got], *[[f(g[2]) for g in got] for f in digits]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(FOUND))

    def run(batches):
        part, blocks, held = None, None, []
        for batch in batches:
            parts, kinds = batch["part"].to_numpy(zero_copy_only=False), batch["kind"].to_numpy(zero_copy_only=False)
            ids = batch["id"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                x = _matrix(batch["v"].slice(a, b - a), dims)
                if parts[a] != part:
                    part, blocks, held = parts[a], None, []
                if kinds[a] == 0:
                    held.append((x, ids[a:b]))
                    continue
                if blocks is None:
                    every, names = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.empty((0, dims), np.int64), np.empty(0, np.int64))
                    held = []
                    blocks = [Lists(every[i : i + VECTORS], names[i : i + VECTORS]) for i in range(0, len(names), VECTORS)]
                yield answers(blocks, x, ids[a:b])

    return run


def top_k(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's k best.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows with another id. Vectors that are null or hold a null or a non-finite
    component take no part; a shorter one (an empty one too) is padded with
    zeros. Ties go to the smaller id. Rows that repeat an id are rows of their
    own, as candidates; as queries, equal ids are answered together: the
    repeated rows' scores compete. A null id is left out. No rows, no result.
    Components of any finite size rank exactly up to the ends of 64 bits, at
    which components and scores stop.

    A part takes ``PART_BYTES`` of vectors; what is shuffled is every vector
    once and every query once for each part.
    """
    spark = vectors.sparkSession
    x = F.col(embedding).cast("array<double>")
    usable = F.col(embedding).isNotNull() & F.col(key).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ints = F.transform(x, lambda c: F.floor(c * float(scale)))
    # Row numbers are the deal: repeated ids or vectors spread like others.
    rows = written(vectors.where(usable).select(F.col(key).cast("bigint").alias("id"), ints.alias("v")).withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "vectors")
    n, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    # Parts are as large as memory allows, but all cores get one.
    parts = max(1, -(-n * max(1, dims) * 8 // PART_BYTES), min(spark.sparkContext.defaultParallelism, -(-n // VECTORS)))
    left = rows.select(F.pmod("deal", F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "v")
    right = rows.where(F.col("id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "id", "v")
    met = left.unionByName(right).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")
    found = met.mapInArrow(_work(k, dims), ", ".join(f"{c} bigint" for c in FOUND))
    order = Window.partitionBy("query_id").orderBy(F.desc("s2"), F.desc("s1"), F.desc("s0"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
