"""Overlap and containment between sets of spans, by one sweep.

Whether a span meets, or lies within, any span of another set is a running
maximum: of all spans that begin before its end (or not behind its start) the
greatest end decides. End points of all sets are united and sorted once, so the
work is that of a sort, however many spans of a document overlap.

Documents are swept in bins of coordinates; what reaches into a bin from the
left is one number for each set, so a long document is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a bin.
BIN = 1 << 16
#: At one position: who asks for overlaps comes first, then spans that begin
#: there, then who asks for what contains it.
_OVERLAP, _BEGIN, _WITHIN = 0, 1, 2


def swept(sets: dict[str, DataFrame], asks: dict[str, dict[str, tuple[str, ...]]], key: str = "doc_id", bin_size: int = BIN, mixed: DataFrame | None = None) -> DataFrame:
    """Rows of all ``sets`` (key, start, end, other columns) that ask for
    something, with ``side`` (their set's name) and a flag for each question.

    ``asks`` has for a set the sets that its spans may ``overlap`` or lie
    ``within``; the flags are named ``overlap_<set>`` and ``within_<set>``, and
    null for sides that don't ask. Spans are half-open. Columns beyond the spans
    are those of any set, null where a set lacks them. ``mixed`` has rows of
    several sets, told apart by its column ``side``. A span without a document
    meets nothing; repeated rows are rows of their own.
    """
    frames = [df.withColumn("side", F.lit(side)) for side, df in sets.items()] + ([mixed] if mixed is not None else [])
    extra = sorted({(f.name, f.dataType.simpleString()) for df in frames for f in df.schema if f.name not in (key, "start", "end", "side")})
    rows = None
    for df in frames:
        own = F.struct(*[(F.col(c) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in extra]).alias("own")
        part = df.select(F.col(key), F.col("start"), F.col("end"), F.col("side"), own)
        rows = part if rows is None else rows.unionByName(part)
    # Every row is a span that begins, where others ask for it, and a question or two.
    asked_for = sorted({t for a in asks.values() for s in a.values() for t in s})
    roles = {_BEGIN: asked_for, _OVERLAP: [s for s, a in asks.items() if a.get("overlap")], _WITHIN: [s for s, a in asks.items() if a.get("within")]}
    each = [F.when(F.col("side").isin(*sides), F.struct(F.lit(k).alias("kind"), F.col("end" if k == _OVERLAP else "start").alias("pos"))) for k, sides in roles.items() if sides]
    events = rows.select(key, "start", "end", "side", "own", F.explode(F.array_compact(F.array(*each))).alias("event"))
    events = events.select(key, "start", "end", "side", "own", "event.kind", "event.pos", F.floor(F.col("event.pos") / bin_size).alias("bin"))
    targets = asked_for
    end_of = {t: F.when((F.col("kind") == _BEGIN) & (F.col("side") == t), F.col("end")) for t in targets}
    # What earlier bins of a document reach to: nothing for all but long ones.
    by_bin = events.groupBy(key, "bin").agg(*[F.max(e).alias(t) for t, e in end_of.items()])
    earlier = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = by_bin.select(key, "bin", *[F.max(t).over(earlier).alias(f"_from_{t}") for t in targets]).where(" or ".join(f"_from_{t} is not null" for t in targets))
    here = Window.partitionBy(key, "bin").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ran = events.select("*", *[F.max(e).over(here).alias(f"_here_{t}") for t, e in end_of.items()]).where(F.col("kind") != _BEGIN)
    ran = ran.join(reach, [key, "bin"], "left")
    flags = {}
    for what, kind, bound in (("overlap", _OVERLAP, "start"), ("within", _WITHIN, "end")):
        for t in sorted({t for a in asks.values() for t in a.get(what, ())}):
            top = F.greatest(F.col(f"_here_{t}"), F.col(f"_from_{t}"))
            hit = (top > F.col("start")) if what == "overlap" else (top >= F.col("end"))
            asking = [s for s, a in asks.items() if t in a.get(what, ())]
            flags[f"{what}_{t}"] = F.when((F.col("kind") == kind) & F.col("side").isin(*asking), F.coalesce(hit & F.col(key).isNotNull(), F.lit(False)))
    return ran.select(key, "start", "end", "side", *[F.col(f"own.{c}").alias(c) for c, _ in extra], *[f.alias(n) for n, f in flags.items()])


def last_run(positions: DataFrame, runs: DataFrame, at: str, inclusive: bool = False, key: str = "doc_id") -> DataFrame:
    """``positions`` with run_start and run_end of the last of the ``runs``
    (key, start, end: disjoint, ascending) that begins before the position in
    column ``at``, or at it if ``inclusive``; null where none does. Both sets
    are sorted together once."""
    own = F.struct(*positions.columns).alias("own")
    asks = positions.select(F.col(key), F.col(at).alias("pos"), F.lit(2 if inclusive else 0).alias("kind"), own, F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"))
    given = runs.select(F.col(key), F.col("start").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast(asks.schema["own"].dataType).alias("own"), F.col("start").alias("a"), F.col("end").alias("b"))
    here = Window.partitionBy(key).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ran = asks.unionByName(given).select("kind", "own", F.max("a").over(here).alias("run_start"), F.max("b").over(here).alias("run_end"))
    return ran.where("kind <> 1").select("own.*", "run_start", "run_end")
