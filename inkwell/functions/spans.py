"""Find all matches of a pattern with their offsets, in native expressions.

Spark can replace and extract matches but has no function that returns where
they are. Here one replacement puts a private-use character on both sides of
each match, one split by that character yields gaps and matches in turn, and
running sums of their lengths are the offsets. Offsets count code points.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, STAND_IN = "\ue000", "\ue001"
#: Pieces that one fold takes.
FEW = 16
SPAN = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, wherever it occurs."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column, op=operator.add) -> Column:
    """Running sums (or another fold of whole numbers, from 0) of a short array;
    a longer one costs its square in copies."""
    none = F.array().cast("array<int>")
    return F.aggregate(
        numbers,
        F.struct(F.lit(0).alias("total"), none.alias("ends")),
        lambda a, x: let(op(a["total"], x), lambda t: F.struct(t.alias("total"), F.concat(a["ends"], F.array(t)).alias("ends"))),
        lambda a: a["ends"],
    )


def running_sums(numbers: Column, op=operator.add) -> Column:
    """``running`` for an array of any length, in blocks.

    Sums within blocks cost the blocks' length squared, those over blocks their
    number squared: a block of the cube root of twice the length keeps both low.

    Every intermediate array is the argument of a function, never a captured
    variable of a lambda: Spark would evaluate it again for each element.
    """

    def by(block: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size(numbers) - 1).cast("int")), block)
        cut = F.transform(
            F.arrays_zip(at.alias("at"), F.array_repeat(numbers, F.size(at)).alias("all")),
            lambda z: F.slice(z["all"], z["at"] + 1, block),
        )
        return let(cut, shifted)

    def shifted(cut: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), running(F.transform(cut, lambda c: F.aggregate(c, F.lit(0), lambda a, x: op(a, x))), op))
        return F.flatten(
            F.transform(
                F.arrays_zip(F.transform(cut, lambda c: running(c, op)).alias("own"), F.slice(before, 1, F.size(before) - 1).alias("before")),
                lambda z: F.transform(z["own"], lambda x: op(z["before"], x)),
            )
        )

    return let(F.greatest(F.lit(8), F.cbrt(2 * F.size(numbers))).cast("int"), by)


CUT = 4096


def cut_out(text: Column, body) -> Column:
    """``body(piece)``, where ``piece(start, end)`` cuts code points out of
    ``text`` at the cost of what it cuts: Spark counts characters from a text's
    beginning, here from that of a block."""

    def inside(blocks: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            first = (start / CUT).cast("int")
            whole = F.array_join(F.slice(blocks, first + 1, F.greatest(F.lit(1), ((end - 1) / CUT).cast("int") - first + 1)), "")
            return F.when(end > start, F.substring(whole, start - first * CUT + 1, end - start)).otherwise("")

        return body(piece)

    return let(F.when(F.length(text) <= CUT, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))), inside)


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(STAND_IN))


def _pieces(safe: Column, pattern: str) -> Column:
    """Gaps and matches in turn, the first and the last a gap."""
    return F.split(F.regexp_replace(safe, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def _spans(pieces: Column, context: int) -> Column:
    ends = let(F.transform(pieces, F.length), lambda n: F.when(F.size(n) <= FEW, running(n)).otherwise(running_sums(n)))
    rows = F.arrays_zip(
        pieces.alias("value"),
        ends.alias("end"),
        F.slice(F.concat(F.array(F.lit("")), pieces), F.lit(1), F.size(pieces)).alias("left"),
        F.concat(F.slice(pieces, F.lit(2), F.size(pieces)), F.array(F.lit(""))).alias("right"),
    )
    return F.transform(
        F.filter(rows, lambda _, i: i % 2 == 1),
        lambda z: F.struct(
            (z["end"] - F.length(z["value"])).alias("start"),
            z["end"].alias("end"),
            z["value"].alias("value"),
            F.right(z["left"], F.lit(context)).alias("left"),
            F.left(z["right"], F.lit(context)).alias("right"),
        ),
    )


def _plain(pieces: Column) -> Column:
    """The same for few pieces and no context: a match begins where the pieces
    before it, joined, end."""
    span = lambda start, value: F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.lit("").alias("left"), F.lit("").alias("right"))
    one = lambda p: lambda i: span(F.length(F.array_join(F.slice(p, F.lit(1), i), "")), F.get(p, i))
    many = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2)), one(pieces))
    return F.when(F.size(pieces) > 1, many).otherwise(F.array().cast(SPAN))


def _marked(pieces: Column, context: int) -> Column:
    return _spans(pieces, context) if context else F.when(F.size(pieces) <= FEW, _plain(pieces)).otherwise(_spans(pieces, context))


def find_spans(text: Column, pattern: str, cue: Column | None = None, context: int = 40, probe: bool = True) -> Column:
    """All leftmost non-overlapping matches: start, end, value and up to
    ``context`` code points on either side (cut at the neighbouring match).

    ``pattern`` must match neither the empty string nor private-use
    characters. ``cue`` is a cheap condition that every text with a match
    meets; other texts are not searched. ``probe`` tests the pattern before it
    is marked: better where few texts match, a second pass where most do. A
    null text has no spans.
    """
    found = let(_pieces(_safe(text), pattern), lambda p: _marked(p, context))
    has = text.isNotNull() if cue is None else cue
    has = has & text.rlike(pattern) if probe else has
    return F.when(has, found).otherwise(F.array().cast(SPAN))


def find_each(text: Column, patterns: list[tuple[str, Column]]) -> Column:
    """``find_spans`` without context for each (pattern, cue), as an array in
    their order. What follows the search is one expression for all of them, so
    the plan stays small."""
    none = F.array().cast("array<string>")
    pieces = lambda safe: F.array(*[F.when(cue, _pieces(safe, pattern)).otherwise(none) for pattern, cue in patterns])
    return F.transform(let(_safe(text), pieces), lambda p: _marked(p, 0))


#: Characters of words, in a pattern's character class.
WORDCHAR = r"\p{IsAlphabetic}\p{N}_"


def find_words(text: Column) -> Column:
    """Runs of word characters, with their offsets."""
    return find_spans(text, f"[{WORDCHAR}]+", context=0)
