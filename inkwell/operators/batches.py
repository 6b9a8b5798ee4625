"""Detection and items of plain texts, a batch at a time.

``detect`` and ``review`` say what evidence and items are, in native
expressions; these cost hundreds of microseconds a text. In texts of ASCII
alone Java's and Python's patterns mean the same. There a batch's texts lie
behind one another in one buffer: numpy names the places where a rule's match
can begin (``Rule.begins``), the rule's own pattern is tried at these alone.
All work is linear in a text's length and its pieces. Other texts bring the
evidence of the native expression along.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators import detect

#: Lies between texts: no rule matches it, and it bounds words as a text's end does.
GAP = b"\n"
#: Gaps around a buffer, so that looking about a place stays inside it, and its
#: size: what is made of it should stay in a core's cache.
PAD, SIZE = 64, 1 << 18
EVIDENCE = "array<struct<category:string,start:int,end:int,phrase:string,confidence:double>>"
#: Columns of items and their types; ``stages`` aside, which are the rules alone.
ITEM = {"item": "bigint", "start": "int", "end": "int", "category": "string", "confidence": "double", "n_evidence": "bigint", "phrase": "string", "group": "bigint", "number": "int", "replacement": "string"}
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
RULES = (*detect.RULES, detect.NHS_CONTEXT, detect.ADDRESS_LEAD)
CATEGORIES = sorted({r.category for r in RULES})
_CATEGORY = np.array([CATEGORIES.index(r.category) for r in RULES])
_CONFIDENCE = np.array([r.confidence for r in RULES])


def is_plain(text: Column) -> Column:
    """ASCII alone: as many bytes as characters."""
    return F.octet_length(text) == F.length(text)


def _table(sign: str) -> np.ndarray:
    return np.array([i < 128 and bool(re.match(sign, chr(i), re.IGNORECASE | re.ASCII)) for i in range(256)])


_WORD = _table(r"\w")
_LOCAL = bytes(np.flatnonzero(_table("[a-z0-9._%+-]")).tolist())
_edge = re.compile(rb"\b").search


@functools.cache
def _compiled() -> tuple[list, list[np.ndarray], np.ndarray, list[int]]:
    """The rules' patterns, without what no ASCII text has; tables of bytes, one
    for each place in ``Rule.begins``, that have a bit for every alternative; the
    bytes other than words' at which one begins; the bits of each rule."""
    match, signs, own = [], [], []
    for r in RULES:
        pattern = r.pattern.replace("(?iu)", "(?i)").replace(r"\x{85}\p{Z}", "").replace("’", "")
        match.append(re.compile(pattern.encode("ascii")).match)
        own.append(((1 << len(r.begins)) - 1) << len(signs))
        signs += [[_table(x) for x in re.findall(r"\[[^]]*\]|.", b)] for b in r.begins]
    tables = [np.zeros(256, np.uint32) for _ in range(max(map(len, signs)))]
    for bit, x in enumerate(signs):
        for k, table in enumerate(tables):
            table[x[k] if k < len(x) else slice(None)] |= np.uint32(1 << bit)
    return match, tables, np.any([x[0] for x in signs], axis=0) & ~_WORD, own


def _matches(match, text: bytes, places: np.ndarray, tail: bool, odd: dict) -> tuple[list[int], list[int]]:
    """Starts and ends of leftmost matches that don't overlap; of a rule with a
    tail that alone, found in the match as ``detect`` finds it. ``odd`` takes, by
    their places, tails that are found shorter there than where the match has them."""
    end, starts, ends = 0, [], []
    for at in places.tolist():
        if at >= end:
            m = match(text, at)
            if m is not None:
                end = m.end()
                if tail:
                    own = match(m[0])
                    own = own[1] if own else b""
                    at = end - len(own)
                    if own != text[at:end]:
                        odd[at, end] = own
                starts.append(at)
                ends.append(end)
    return starts, ends


def _emails(match, text: bytes, ats: np.ndarray) -> tuple[list[int], list[int]]:
    """The same for addresses: the first boundary in the run of signs before an
    @ decides, as what follows the @ matches wherever the address begins."""
    end, starts, ends = 0, [], []
    for at in ats.tolist():
        low = max(at - 64, end)
        if low < at:
            first = _edge(text, low + len(text[low:at].rstrip(_LOCAL)))
            m = match(text, first.start()) if first and first.start() < at else None
            if m is not None:
                end = m.end()
                starts.append(m.start())
                ends.append(end)
    return starts, ends


def _valid_nhs(text: bytes, starts: list[int], ends: list[int]) -> list[bool]:
    d = np.frombuffer(b"".join(text[s:e].translate(None, b" -") for s, e in zip(starts, ends)), np.uint8).reshape(-1, 10).astype(np.int64) - 48
    due = (11 - (d[:, :9] * np.arange(10, 1, -1)).sum(axis=1) % 11) % 11
    return ((due < 10) & (due == d[:, 9]) & (d != d[:, :1]).any(axis=1)).tolist()


def _found(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """(rule, start, end) of all evidence in a buffer, by rule, then place, and
    the phrases of tails that aren't what stands there."""
    match, tables, others, bits = _compiled()
    b = np.frombuffer(text, np.uint8)
    word = _WORD[b]
    heads = np.flatnonzero((word[1:] & ~word[:-1]) | others[b[1:]]) + 1
    # Bits of the alternatives whose signs all stand at a place.
    hits = tables[0][b[heads]]
    for k, table in enumerate(tables[1:], 1):
        hits &= table[b[heads + k]]
    any_hit = hits != 0
    heads, hits = heads[any_hit], hits[any_hit]
    which, all_starts, all_ends, numbers, odd = [], [], [], set(), {}
    for i, rule in enumerate(RULES):
        if rule.begins:
            starts, ends = _matches(match[i], text, heads[hits & np.uint32(bits[i]) != 0], rule.tail, odd)
        else:
            starts, ends = _emails(match[i], text, np.flatnonzero(b == ord("@")))
        keep = None
        if rule.category == "NHS_NUMBER":
            keep = [x not in numbers for x in zip(starts, ends)] if rule.tail else _valid_nhs(text, starts, ends)
        elif rule.category == "NI_NUMBER":
            keep = [text[s : s + 2].upper().decode() not in detect.NI_DENIED for s in starts]
        elif rule.category == "URL":
            ends = [s + len(text[s:e].rstrip(detect.URL_TAIL.encode())) for s, e in zip(starts, ends)]
        if keep is not None:
            starts, ends = ([x for x, ok in zip(own, keep) if ok] for own in (starts, ends))
            numbers.update(zip(starts, ends) if rule.category == "NHS_NUMBER" else ())
        which.append(np.full(len(starts), i))
        all_starts += starts
        all_ends += ends
    return np.concatenate(which), np.array(all_starts, np.int64), np.array(all_ends, np.int64), odd


def _buffers(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Runs of texts (nulls as empty ones): the first row, where each begins, the buffer."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    upto, low = np.cumsum(size), 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + SIZE, "right")))
        joined = GAP.join(t or b"" for t in texts.slice(low, high - low).cast(pa.binary()).to_pylist())
        begins = PAD + np.concatenate(([0], np.cumsum(size[low : high - 1] + 1)))
        yield low, begins, GAP * PAD + joined + GAP * PAD
        low = high


def _strings(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary()).cast(pa.string())


def _named(codes: np.ndarray) -> pa.Array:
    return pa.array(CATEGORIES).take(pa.array(codes))


def _lists(rows: int, row: np.ndarray, values: pa.Array, mask: pa.Array | None = None) -> pa.Array:
    """``values``, of rows in order, as a list for each of ``rows``."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values, mask=mask)


def _evidence(texts: pa.Array) -> pa.Array:
    out = []
    for low, begins, text in _buffers(texts):
        rule, start, end, odd = _found(text)
        row = np.searchsorted(begins, start, "right") - 1
        order = np.argsort(row, kind="stable")
        rule, start, end, row = rule[order], start[order], end[order], row[order]
        phrases = [text[s:e] for s, e in zip(start.tolist(), end.tolist())]
        if odd:
            phrases = [odd.get(at, p) if RULES[r].tail else p for r, at, p in zip(rule, zip(start.tolist(), end.tolist()), phrases)]
        values = pa.StructArray.from_arrays([_named(_CATEGORY[rule]), pa.array((start - begins[row]).astype(np.int32)), pa.array((end - begins[row]).astype(np.int32)), _strings(phrases), pa.array(_CONFIDENCE[rule])], ["category", "start", "end", "phrase", "confidence"])
        out.append(_lists(len(begins), row, values, texts.slice(low, len(begins)).is_null()))
    return pa.concat_arrays(out)


def _labels(rows: Iterator[tuple]) -> tuple[list, list]:
    """(group, number) of items (document, category, phrase, item), in order."""
    groups, numbers, at = [], [], None
    for doc, category, phrase, item in rows:
        if doc != at:
            known, counts, at = {}, {}, doc
        own = known.get((category, phrase))
        if own is None:
            counts[category] = n = counts.get(category, 0) + 1
            own = known[category, phrase] = (item, n)
        groups.append(own[0])
        numbers.append(own[1])
    return groups, numbers


def _struct(fields: tuple[str, ...]) -> pa.DataType:
    return pa.struct([(f, _ARROW[ITEM[f]]) for f in fields])


def _plain_items(texts: pa.Array, fields: tuple[str, ...] = tuple(ITEM)) -> pa.Array:
    out = []
    for _, begins, text in _buffers(texts):
        rule, start, end, _ = _found(text)
        # Numbers of evidence are in the order of the rules, and so is a stable sort.
        order = np.argsort(start * (SIZE * 2) + (end - start), kind="stable")
        rule, start, end = rule[order], start[order], end[order]
        reach = np.maximum.accumulate(end)
        # An end lies before the next text: nothing is merged across texts.
        first = np.flatnonzero(np.concatenate(([True], start[1:] >= reach[:-1]))) if len(start) else start
        n = np.diff(np.append(first, len(start)))
        start, code = start[first], _CATEGORY[rule[first]]
        end = reach[np.append(first[1:], len(reach)) - 1] if len(first) else end
        confidence = np.maximum.reduceat(_CONFIDENCE[rule], first) if len(first) else _CONFIDENCE[:0]
        row = np.searchsorted(begins, start, "right") - 1
        item = np.arange(len(row)) - np.searchsorted(row, row) + 1
        phrases = [text[s:e] for s, e in zip(start.tolist(), end.tolist())]
        # The only item of its category is a group of its own, and its first.
        key = row * len(CATEGORIES) + code
        among = np.flatnonzero(np.bincount(key)[key] > 1)
        group, number = item.copy(), np.ones(len(row), np.int32)
        group[among], number[among] = _labels(zip(row[among].tolist(), code[among].tolist(), [phrases[i] for i in among.tolist()], item[among].tolist()))
        made = {
            "item": lambda: pa.array(item), "start": lambda: pa.array((start - begins[row]).astype(np.int32)), "end": lambda: pa.array((end - begins[row]).astype(np.int32)),
            "category": lambda: _named(code), "confidence": lambda: pa.array(confidence), "n_evidence": lambda: pa.array(n), "phrase": lambda: _strings(phrases),
            "group": lambda: pa.array(group), "number": lambda: pa.array(number),
            "replacement": lambda: pc.binary_join_element_wise("[", _named(code), "_", pa.array(number).cast(pa.string()), "]", ""),
        }
        out.append(_lists(len(begins), row, pa.StructArray.from_arrays([made[f]() for f in fields], fields=list(_struct(fields)))))
    return pa.concat_arrays(out)


def _given_items(text: str | None, evidence: list[dict]) -> list[dict]:
    """Items of one text from its evidence."""
    keys = ("start", "end", "seq", "category", "confidence", "stage")
    parts, reach = [], -1
    for x in sorted((tuple(e[k] for k in keys) for e in evidence), key=lambda x: x[:3]):
        if not parts or x[0] >= reach:
            parts.append([])
        parts[-1].append(x)
        reach = max(reach, x[1])
    items = []
    for k, part in enumerate(parts):
        start, end = part[0][0], max(x[1] for x in part)
        category = min(part, key=lambda x: (x[5] != "rules", *x[:3]))[3]
        items.append({"item": k + 1, "start": start, "end": end, "category": category, "confidence": max(x[4] for x in part), "n_evidence": len(part), "phrase": (text or "")[start:end]})
    group, number = _labels((0, x["category"], x["phrase"], x["item"]) for x in items)
    return [x | {"group": g, "number": n, "replacement": f"[{x['category']}_{n}]"} for x, g, n in zip(items, group, number)]


@functools.cache
def _evidence_udf():
    # The module's name, not its functions, goes to the workers.
    return F.arrow_udf(lambda texts: _evidence(texts), EVIDENCE)


@functools.cache
def _items_udf(fields: tuple[str, ...]):
    def items(plain: pa.Array, others: pa.Array, given: pa.Array) -> pa.Array:
        own = _plain_items(plain, fields)
        if given.null_count == len(given):
            return own
        rest = [None if e is None else [{f: x[f] for f in fields} for x in _given_items(t, e)] for t, e in zip(others.to_pylist(), given.to_pylist())]
        return pc.if_else(given.is_null(), own, pa.array(rest, pa.list_(_struct(fields))).cast(own.type))

    return F.arrow_udf(items, f"array<struct<{','.join(f'{f}:{ITEM[f]}' for f in fields)}>>")


def evidence_in(text: Column, other: Column) -> Column:
    """The rules' evidence of a plain text; of other texts it is ``other``."""
    return F.coalesce(_evidence_udf()(F.when(is_plain(text), text)), other)


def with_items(notes: DataFrame, text: str, other: Column, name: str, fields: tuple[str, ...] = tuple(ITEM)) -> DataFrame:
    """``notes`` with the items of their texts as an array: those of the rules
    in a plain text, in other texts those of the rules' evidence ``other``
    (start, end, seq, category, confidence, stage). ``fields`` are all that is made."""
    # A column of its own: Spark doesn't take a function out whose arguments hold lambdas.
    given = notes.withColumn("_given", F.when(~is_plain(F.col(text)), other))
    known = F.col("_given").isNotNull()
    return given.withColumn(name, _items_udf(fields)(F.when(~known, F.col(text)), F.when(known, F.col(text)), "_given")).drop("_given")
