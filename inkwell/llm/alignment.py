"""Cross-tokenizer alignment through bitsets of token ends.

Two tokenizers encode the same bytes. For each a bitset has a bit at the last
byte of every token; the AND of the two has the shared cuts, which divide a
text into groups. Selecting its set bits gives the cuts in bytes, and counting
the bits of one tokenizer's set up to a cut (sums of whole words and a masked
popcount) gives the token range that ends there. Whole batches of documents are
one bitset, for each document's end is a cut of both. All links of a group are
its pairs of tokens; they are expanded in runs of bounded size and counted by
document and pair of ids.

How many documents hold a pair is an aggregation with a combiner. Going back to
the documents, pairs in at least 1/HOT of all (document, pair) rows are few,
HOT at most whatever the data, and are broadcast; the rest is joined by
shuffle, where no pair has more than 1/HOT of the rows.

Texts that are null, empty, or that a tokenizer doesn't give back byte by byte
have no tokens. Repeated rows are documents of their own; so are rows whose id
is null. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .token_files import slices

#: Bytes of text that are aligned together, and links expanded at once.
AT_ONCE, LINKS = 1 << 18, 1 << 19
#: Pairs that are broadcast at most: 24 bytes each.
HOT = 100_000
#: What stands before every text.
LEAD = " "


# ---- tokenizers ---------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable
    ones for themselves, the others numbered from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


#: How a byte-level tokenizer takes a text apart, where its file says so.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class is the same for every library: texts with others go
#: through the file's own one.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f]*+")


class ByteLevel:
    """A byte-level tokenizer from a ``tokenizers`` file. Where its ids are the
    ranks of its merges, plain texts are encoded by those ranks, which gives the
    same ids in a quarter of the time and without an object for every token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The strings of special tokens in a text are ordinary text.
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.tokenizer.get_vocab()
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.pieces[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.ranks = self._by_rank(vocabulary)

    def _by_rank(self, vocabulary: dict[str, int]):
        made = json.loads(self.tokenizer.to_str())
        steps, model = made["pre_tokenizer"] or {}, made["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ())]
        plain = made["normalizer"] is None and (steps.get("type"), steps.get("add_prefix_space"), steps.get("use_regex", True)) == ("ByteLevel", False, True)
        if not (plain and model["type"] == "BPE" and not model["dropout"] and all(vocabulary["".join(m)] == 256 + k for k, m in enumerate(merges))):
            return None
        import tiktoken

        own = {self.pieces[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=own, special_tokens={}) if len(own) == 256 + len(merges) else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        texts = [LEAD + t for t in texts]
        if self.ranks is None:
            return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return [self.ranks.encode_ordinary(t) if PLAIN.fullmatch(t) else self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


class SentencePieces:
    """A SentencePiece model, which puts the space before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.pieces = [self._bytes(i) for i in range(size)]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def tokenizer_of(path: str):
    return SentencePieces(path) if path.endswith(".model") else ByteLevel(path)


# ---- bitsets ------------------------------------------------------------


def bitset(ends: np.ndarray, size: int) -> np.ndarray:
    """Words of 64 bits with a bit at each of ``ends``."""
    bits = np.zeros(-(-size // 64) * 64, bool)
    bits[ends] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def selected(words: np.ndarray) -> np.ndarray:
    """Places of the set bits, ascending."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def ranked(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Number of set bits up to each place, that place included."""
    upto = np.cumsum(np.bitwise_count(words), dtype=np.int64)
    word, bit = places >> 6, (places & 63).astype(np.uint64)
    above = words[word] & ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit))
    return upto[word] - np.bitwise_count(above)


@dataclass
class Aligned:
    """Documents of a batch, one behind the other. Group g of all has tokens
    a_ends[g-1]..a_ends[g] and b_ends[g-1]..b_ends[g]; document d has the
    groups group_ends[d-1]..group_ends[d]."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    cuts: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    group_ends: np.ndarray


def _kept_ids(texts: list[str], first, second) -> tuple[list[bool], list[list[int]], list[list[int]], list[int]]:
    """Which texts come back from both, with ids and sizes of these."""
    good, a_ids, b_ids, sizes = [], [], [], []
    for text, a, b in zip(texts, first.encode(texts), second.encode(texts), strict=True):
        raw = (LEAD + text).encode()
        same = bool(text) and b"".join(map(first.pieces.__getitem__, a)) == raw and b"".join(map(second.pieces.__getitem__, b)) == raw
        good.append(same)
        if same:
            a_ids.append(a)
            b_ids.append(b)
            sizes.append(len(raw))
    return good, a_ids, b_ids, sizes


def aligned(a_ids: list[list[int]], b_ids: list[list[int]], sizes: list[int], a_sizes: np.ndarray, b_sizes: np.ndarray) -> Aligned:
    """Groups of documents whose tokens have the given sizes in bytes."""
    a = np.concatenate([np.asarray(x, np.int64) for x in a_ids]) if a_ids else np.empty(0, np.int64)
    b = np.concatenate([np.asarray(x, np.int64) for x in b_ids]) if b_ids else np.empty(0, np.int64)
    total = int(sum(sizes))
    in_a, in_b = bitset(np.cumsum(a_sizes[a]) - 1, total), bitset(np.cumsum(b_sizes[b]) - 1, total)
    cuts = selected(in_a & in_b)
    return Aligned(a, b, cuts, ranked(in_a, cuts), ranked(in_b, cuts), np.searchsorted(cuts, np.cumsum(sizes)))


def _before(ends: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], ends))[: len(ends)].astype(np.int64)


def linked_pairs(x: Aligned, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair of ids, times) for all links, ascending. A pair is the
    A id shifted to the left, with the B id in the low bits."""
    doc = np.repeat(np.arange(len(x.group_ends)), np.diff(x.group_ends, prepend=0))
    a0, b0 = _before(x.a_ends), _before(x.b_ends)
    na, nb = x.a_ends - a0, x.b_ends - b0
    width = 2 * shift
    keys, times = [], []

    def add(key: np.ndarray, n: np.ndarray | None = None) -> None:
        got, inverse = np.unique(key, return_inverse=True)
        keys.append(got)
        times.append(np.bincount(inverse, n, len(got)).astype(np.int64))

    links = na * nb
    for g in np.flatnonzero(links > LINKS):
        # A long group: its distinct ids, times how often they stand in it.
        ua, ca = np.unique(x.a_ids[a0[g] : x.a_ends[g]], return_counts=True)
        ub, cb = np.unique(x.b_ids[b0[g] : x.b_ends[g]], return_counts=True)
        step = max(1, LINKS // len(ub))
        for i in range(0, len(ua), step):
            add(((doc[g] << width) | (ua[i : i + step, None] << shift) | ub[None, :]).ravel(), (ca[i : i + step, None] * cb[None, :]).ravel())
    links = np.where(links > LINKS, 0, links)
    upto = np.cumsum(links)
    begin = 0
    while begin < len(links):
        base = upto[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(upto, base + LINKS, side="right")))
        n = links[begin:stop]
        group = begin + np.repeat(np.arange(stop - begin), n)
        r = np.arange(int(n.sum())) - np.repeat(upto[begin:stop] - n - base, n)
        i, j = a0[group] + r // nb[group], b0[group] + r % nb[group]
        add((doc[group] << width) | (x.a_ids[i] << shift) | x.b_ids[j])
        begin = stop
    if not keys:
        return (np.empty(0, np.int64),) * 3
    key, n = (keys[0], times[0]) if len(keys) == 1 else (np.concatenate(keys), np.concatenate(times))
    if len(keys) > 1:
        key, inverse = np.unique(key, return_inverse=True)
        n = np.bincount(inverse, n, len(key)).astype(np.int64)
    return key >> width, key & ((1 << width) - 1), n


class GroupText:
    """``a1,a2|b1;a3|b2,b3`` of documents: each id's text with what follows it
    comes from one table, whatever the order asked for."""

    def __init__(self, a_count: int, b_count: int):
        rows = [f"{i}{end}".encode() for count, ends in ((a_count, ",|"), (b_count, ",;")) for end in ends for i in range(count)]
        self.table = np.array(rows, dtype=object)
        self.a_count, self.b_count = a_count, b_count

    def of(self, x: Aligned) -> list[bytes]:
        a0, b0 = _before(x.a_ends), _before(x.b_ends)
        at = np.empty(len(x.a_ids) + len(x.b_ids), np.int64)
        # B's tokens of a group stand behind A's, so each side moves by the other's count.
        at[np.arange(len(x.a_ids)) + np.repeat(b0, x.a_ends - a0)] = x.a_ids + self.a_count * np.isin(np.arange(len(x.a_ids)), x.a_ends - 1, assume_unique=True)
        at[np.arange(len(x.b_ids)) + np.repeat(x.a_ends, x.b_ends - b0)] = 2 * self.a_count + x.b_ids + self.b_count * np.isin(np.arange(len(x.b_ids)), x.b_ends - 1, assume_unique=True)
        ends = (x.a_ends + x.b_ends)[x.group_ends - 1] if len(x.group_ends) else np.empty(0, np.int64)
        return [b"".join(self.table[at[s:e]].tolist())[:-1] for s, e in zip(_before(ends), ends, strict=True)]


# ---- documents ----------------------------------------------------------

COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"
DETAIL = "a_ids array<int>, b_ids array<int>, cuts array<int>, a_ends array<int>, b_ends array<int>"


def _list(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32), pa.int32()), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def shift_for(*paths: str) -> int:
    """Bits that hold an id of any of the tokenizers."""
    return max(len(tokenizer_of(p).pieces) - 1 for p in paths).bit_length()


def align_documents(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", detail: bool = False) -> DataFrame:
    """For every row its key and COUNTS: the tokens of both tokenizers (paths of
    their files), groups, links, the hash of the groups' text, and the distinct
    linked pairs with how often each is linked. With ``detail`` also DETAIL:
    the ids, and each group's end in bytes of the text with its lead, in tokens
    of the first and in tokens of the second."""
    shift = shift_for(first, second)
    own = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", *[c.split()[0] for c in COUNTS.split(", ")], *([c.split()[0] for c in DETAIL.split(", ")] if detail else [])]

    def run(batches: Iterator[pa.RecordBatch]):
        one, two = tokenizer_of(first), tokenizer_of(second)
        a_sizes, b_sizes = (np.array([len(p) for p in t.pieces], np.int64) for t in (one, two))
        spelled = GroupText(len(a_sizes), len(b_sizes))
        for batch in batches:
            for begin, length in slices(batch["text"], AT_ONCE):
                rows = batch.slice(begin, length)
                good, a_ids, b_ids, sizes = _kept_ids([t or "" for t in rows["text"].to_pylist()], one, two)
                x = aligned(a_ids, b_ids, sizes, a_sizes, b_sizes)
                good = np.array(good)
                doc, pair, times = linked_pairs(x, shift)
                a0, b0 = _before(x.a_ends), _before(x.b_ends)
                links = np.concatenate(([0], np.cumsum((x.a_ends - a0) * (x.b_ends - b0))))

                def spread(values, good=good):
                    """Numbers for all rows, those of rows without tokens 0."""
                    out = np.zeros(len(good), np.int64)
                    out[good] = values
                    return out

                n_a, n_b = [len(i) for i in a_ids], [len(i) for i in b_ids]
                n_pairs = np.bincount(doc, minlength=len(sizes))
                hashes = np.full(len(good), "", object)
                hashes[good] = [hashlib.sha256(t).hexdigest() for t in spelled.of(x)]
                columns = [
                    rows["doc_id"],
                    *[pa.array(spread(v), pa.int64()) for v in (n_a, n_b, np.diff(x.group_ends, prepend=0), links[x.group_ends] - links[_before(x.group_ends)])],
                    pa.array(hashes, pa.string()),
                    _list(pair, np.cumsum(spread(n_pairs)), pa.int64()),
                    _list(times, np.cumsum(spread(n_pairs)), pa.int64()),
                ]
                if detail:
                    per_group = np.repeat(np.arange(len(sizes)), np.diff(x.group_ends, prepend=0))
                    groups = np.cumsum(spread(np.diff(x.group_ends, prepend=0)))
                    starts = [_before(np.cumsum(n))[per_group] if len(sizes) else np.empty(0, np.int64) for n in (sizes, n_a, n_b)]
                    columns += [_list(x.a_ids, np.cumsum(spread(n_a)), pa.int32()), _list(x.b_ids, np.cumsum(spread(n_b)), pa.int32())]
                    columns += [_list(v - s, groups, pa.int32()) for v, s in zip((x.cuts + 1, x.a_ends, x.b_ends), starts, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return own.mapInArrow(run, ", ".join(["doc_id bigint", COUNTS, *([DETAIL] if detail else [])]))


def pair_counts(rows: DataFrame, shift: int) -> DataFrame:
    """Written (pair, count, best): the documents that hold a pair linked, and
    whether that is the highest count of its A id."""
    counts = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count")), "pairs")
    # An A id has no more rows here than there are B ids.
    top = counts.groupBy(F.shiftright("pair", shift).alias("a")).agg(F.max("count").alias("top"))
    marked = counts.withColumn("a", F.shiftright("pair", shift)).join(top.hint("shuffle_hash"), "a")
    return written(marked.select("pair", "count", (F.col("count") == F.col("top")).alias("best")), "marked")


def link_documents(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """``align_documents`` with n_best and count_sum from the whole corpus, and
    without the pairs."""
    with small_batches(docs.sparkSession):
        encoded = align_documents(docs, first, second, key, text).withColumn("_row", F.monotonically_increasing_id())
        rows = written(encoded, "aligned")
    known = pair_counts(rows, shift_for(first, second))
    total = known.agg(F.sum("count")).first()[0] or 0
    often = F.col("count") * hot >= total
    each = rows.select("_row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    common = F.broadcast(known.where(often))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    near = each.join(common, "pair").groupBy("_row").agg(*sums)
    rare = each.join(common.select("pair"), "pair", "left_anti").join(known.where(~often).hint("shuffle_hash"), "pair").groupBy("_row").agg(*sums)
    both = near.unionByName(rare).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.drop("pairs", "times").join(both, "_row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
