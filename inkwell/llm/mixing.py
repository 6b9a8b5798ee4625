"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree (domain, language, source). At each node it is
divided by the children's weights; a child that hasn't enough gets all it has,
and what it leaves is divided among its siblings again. A node's capacity is
what lies below it, so a shortage reaches an ancestor's siblings only when the
whole subtree is short. Each leaf then takes a prefix, by tokens, of its
documents in the seeded order of an epoch; a leaf whose budget exceeds its
supply repeats, up to ``max_epochs`` times.

A leaf's prefix is found without sorting the leaf in one task: the order's
leading hex digits split it into small bins, sums of bins find the bin where
the budget ends, and only that bin is put in order. What is broadcast or comes
to the driver is one row for each leaf, of which at most ``MAX_LEAVES`` are
accepted.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words, written

MAX_LEAVES = 20_000
#: Documents of the largest leaf that share a bin, about.
BIN = 512


@dataclass(frozen=True)
class Mix:
    #: Column or SQL expression of each level, from the root.
    levels: tuple[str, ...] = ("lang", "source")
    #: Weight of a node by its path; one that isn't listed weighs 1.
    weights: dict[tuple[str, ...], str] = field(default_factory=dict)
    #: Budget as a share of all tokens, unless ``tokens`` says how many.
    share: str = "0.5"
    tokens: int | None = None
    max_epochs: int = 1
    seed: int = 7


def divide(budget: int, children: list[tuple[str, Fraction, int]]) -> dict[str, int]:
    """Shares of (name, weight, capacity), whole and within capacities.

    What can't be placed stays unplaced. Remainders of a token go to the
    largest fractions, ties to the smaller name.
    """
    got = {name: 0 for name, _, _ in children}
    active = sorted((c for c in children if c[1] > 0 and c[2] > 0))
    left = min(budget, sum(c[2] for c in active))
    while active:
        total = sum((c[1] for c in active), Fraction(0))
        full = [c for c in active if left * c[1] >= c[2] * total]
        if not full:
            break
        for name, _, capacity in full:
            got[name] = capacity
        left -= sum(c[2] for c in full)
        active = [c for c in active if c not in full]
    if active:
        total = sum((c[1] for c in active), Fraction(0))
        exact = {c[0]: left * c[1] / total for c in active}
        for name, x in exact.items():
            got[name] = int(x)
        spare = left - sum(int(x) for x in exact.values())
        for name in sorted(exact, key=lambda n: (int(exact[n]) - exact[n], n))[:spare]:
            got[name] += 1
    return got


def allocate(leaves: list[tuple[tuple[str, ...], int]], mix: Mix) -> dict[tuple[str, ...], int]:
    """Budget of each leaf (path, tokens of one epoch)."""
    supply = {path: n * mix.max_epochs for path, n in leaves}
    capacity: dict[tuple[str, ...], int] = {}
    kids: dict[tuple[str, ...], set[tuple[str, ...]]] = {}
    for path, n in supply.items():
        for i in range(len(path) + 1):
            capacity[path[:i]] = capacity.get(path[:i], 0) + n
            if i:
                kids.setdefault(path[: i - 1], set()).add(path[:i])
    budget = mix.tokens if mix.tokens is not None else int(Fraction(mix.share) * sum(n for _, n in leaves))
    out: dict[tuple[str, ...], int] = {}

    def down(node: tuple[str, ...], amount: int) -> None:
        if node not in kids:
            out[node] = amount
            return
        got = divide(amount, [(k[-1], Fraction(mix.weights.get(k, "1")), capacity[k]) for k in kids[node]])
        for k in kids[node]:
            down(k, got[k[-1]])

    if leaves:
        down((), min(budget, capacity[()]))
    return out


def _order(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string")))


def mix_sources(docs: DataFrame, mix: Mix, key: str = "doc_id", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """The selected rows of ``docs``, with ``epoch``, ``n_tokens`` and ``leaf``.

    A row appears once for each epoch that holds it. Tokens are words unless
    ``tokens`` says otherwise. A null level counts as ''; a null or empty text
    has no tokens: it goes with the prefix at no cost. Rows that repeat an id
    have one place in the order and go together. An empty table yields none;
    columns of ``docs`` named like the three are replaced.
    """
    spark = docs.sparkSession
    names = [f"_l{i}" for i in range(len(mix.levels))]
    levels = [F.coalesce(F.expr(e).cast("string"), F.lit("")).alias(n) for e, n in zip(mix.levels, names, strict=True)]
    count = F.size(words(F.col(text))) if tokens is None else tokens
    facts = written(docs.select(*levels, F.col(key).alias("_key"), F.coalesce(count, F.lit(0)).cast("long").alias("_tokens")), "mix")
    stats = facts.groupBy(*names).agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(stats) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    got = allocate([(tuple(r[n] for n in names), r["tokens"]) for r in stats], mix)
    plan = []
    for r in stats:
        path = tuple(r[n] for n in names)
        whole, rest = divmod(got[path], r["tokens"]) if r["tokens"] else (0, 0)
        plan.append((*path, whole, rest))
    # Digits that split the largest leaf into bins of about BIN documents.
    digits = next(d for d in range(1, 9) if max((r["n"] for r in stats), default=0) <= BIN * 16**d or d == 8)
    shape = ", ".join(f"{n} string" for n in names)
    leaf = spark.createDataFrame(plan, f"{shape}, _whole bigint, _rest bigint")
    placed = facts.join(F.broadcast(leaf), names).withColumn("_at", _order(mix.seed, F.col("_whole"), F.col("_key"))).withColumn("_bin", F.substring("_at", 1, digits)).where("_rest > 0")
    bins = placed.groupBy(*names, "_bin").agg(F.sum("_tokens").alias("sum"), F.max("_rest").alias("_rest"))
    until = Window.partitionBy(*names).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("through", F.sum("sum").over(until)).withColumn("before", F.col("through") - F.col("sum"))
    # The first bin that the budget doesn't cover; all before it go whole.
    ends = bins.where("through > _rest").groupBy(*names).agg(F.min_by(F.struct("_bin", "before"), "_bin").alias("e")).select(*names, "e._bin", "e.before")
    ends = ends.limit(MAX_LEAVES).collect()
    bounds = spark.createDataFrame([tuple(r) for r in ends], f"{shape}, _bin string, _before bigint")
    inside = placed.join(F.broadcast(bounds), [*names, "_bin"])
    running = Window.partitionBy(*names).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("through", F.col("_before") + F.sum("_tokens").over(running)).where("through <= _rest").groupBy(*names).agg(F.max("_at").alias("last"))
    found = {tuple(r[n] for n in names): r["last"] for r in last.limit(MAX_LEAVES).collect()}
    starts = {tuple(r[n] for n in names): r["_bin"] for r in ends}
    # The last place of the prefix: the order up to it goes. '' takes none, '~' all.
    cuts = [(*p[:-1], "" if not p[-1] else found.get(tuple(p[:-2]), starts.get(tuple(p[:-2]), "~"))) for p in plan]
    limit = F.broadcast(spark.createDataFrame(cuts, f"{shape}, _whole bigint, _last string"))
    kept = [c for c in docs.columns if c not in ("epoch", "n_tokens", "leaf")]
    rows = docs.select(*kept, *levels, F.coalesce(count, F.lit(0)).cast("long").alias("n_tokens")).join(limit, names)
    copies = F.col("_whole") + F.when((F.col("_last") != "") & (_order(mix.seed, F.col("_whole"), F.col(key)) <= F.col("_last")), 1).otherwise(0)
    rows = rows.withColumn("_copies", copies).where("_copies > 0")
    return rows.select(*kept, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)).alias("epoch"), "n_tokens", F.concat_ws("/", *names).alias("leaf"))
