"""MinHash near-duplicates with odd sketches.

A document is its set of distinct five-word shingles. Equal sets form one
class, of which one representative goes on. MinHash values in bands propose
pairs; the same values, folded into a parity bitmap (odd sketch), estimate a
pair's similarity from the population count of the bitmaps' XOR and drop pairs
far below the threshold; whatever passes is confirmed on the full sets.

Pairs of a band's bucket are not all compared. First every member is compared
with the bucket's head only (the member that meets most others over all bands).
Links found so far are joined into components, and only members of one bucket
in different components are looked at again: no pair that could still change a
component is left out, and a large group of near copies costs as many pairs as
it has members.

In a small bucket those members are compared with each other. In a large one,
as texts around one boilerplate make, they share most shingles and link with
nothing, so pairs come from what is rare among them: with shingles ordered from
the rarest on, two sets that link have one in common among the first
``n - threshold * n + 1`` of each. A rare one there proposes its few owners. A
pair without such a one consists, on both sides, of frequent shingles up to the
threshold at least; only those sets are still compared within their bucket.
Both steps lose no pair.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, remove, small_batches, written
from .components import connected_components

WORDS = 5
#: Links: 100 * intersection >= threshold * union. This one is op2's.
THRESHOLD = 85
ROWS, BANDS = 5, 24  # at a similarity of 0.85 all bands miss a pair with a chance below 1e-6
MISS = 1e-6
BITS = 256
#: Bits of the second bitmap, over all shingles of a set. Its XOR has no more
#: bits than the sets have differing shingles, so it never drops a link.
PARITY = 2048
#: An estimate this far below the threshold drops a pair: above five standard
#: errors at a threshold of 0.85 with 24 bands, and at 0.80 with 35.
SLACK = 0.27
CACHE = 200_000
#: Members up to which a bucket is compared within itself, and sets up to which
#: a shingle counts as rare. They move work from one step to the other; neither
#: drops a pair.
SMALL, RARE = 128, 32
KEYS = ("row", "doc_id", "text_hash")
SIGNATURE = "row bigint, doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch array<bigint>, parity array<bigint>"

_rng = np.random.Generator(np.random.PCG64(20240229))
_rng.integers(1, 1 << 32, ROWS * BANDS, dtype=np.uint64)
_rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64)
_WORD = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def bands_for(threshold: int) -> int:
    """Bands that all miss a pair at the threshold with a chance below ``MISS``:
    24 at 85, 35 at 80."""
    return math.ceil(math.log(MISS) / math.log1p(-((threshold / 100) ** ROWS)))


@lru_cache
def _hashing(bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Factors and summands of the MinHash values, factors of bands and sketch."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    mul = rng.integers(1, 1 << 32, ROWS * bands, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, ROWS * bands, dtype=np.uint64).astype(np.uint32)
    rng.integers(1, 1 << 63, WORDS, dtype=np.uint64)
    band = rng.integers(1, 1 << 63, (bands, ROWS), dtype=np.uint64) | np.uint64(1)
    return mul, add, band, rng.integers(1, 1 << 63, ROWS * bands, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes by word; emptied when it holds ``CACHE`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def shingle_set(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles. Fewer words than a
    shingle has are one shingle; no words are an empty set."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = len(h) - WORDS + 1
    if n < 1:
        whole = np.array([len(h)], np.uint64) * _WORD[0]
        for i in range(len(h)):
            whole = mix(whole ^ (h[i : i + 1] * _WORD[i]))
        return whole
    total = h[:n] * _WORD[0]
    for i in range(1, WORDS):
        total = total + mix(h[i : i + n] * _WORD[i])
    return np.unique(mix(total))


def folded(flips: np.ndarray, bits: int) -> list[int]:
    """The parity bitmap that has the given bits flipped, as 64-bit numbers."""
    odd = np.bincount(flips.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def signature(s: np.ndarray, bands: int = BANDS) -> tuple[list[int], list[int], list[int]]:
    """Band keys, odd sketch of the MinHash values, parity bitmap of the set."""
    mul, add, band, sketch = _hashing(bands)
    low = np.full(ROWS * bands, 0xFFFFFFFF, np.uint32)
    small = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(small), 1024):
        np.minimum(low, (small[at : at + 1024, None] * mul + add).min(axis=0), out=low)
    low = low.astype(np.uint64)
    keys = mix((mix(low.reshape(bands, ROWS) + np.uint64(1)) * band).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
    return keys.view(np.int64).tolist(), folded(mix(low * sketch + sketch) % np.uint64(BITS), BITS), folded(s % np.uint64(PARITY), PARITY)


def _sign(batches, bands: int):
    hashes = WordHashes()
    for batch in batches:
        rows: list[tuple] = []
        for text in batch["text"].cast(pa.binary()):
            s = shingle_set(text.as_py(), hashes)
            if len(s):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                rows.append((len(s), digest, *signature(s, bands)))
            else:
                rows.append((0, None, None, None, None))
        kinds = [pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3]
        made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*[batch[k] for k in KEYS], *made], [*KEYS, "n_shingles", "digest", "bands", "sketch", "parity"])


def _sets(batches):
    """Each text's set, as bytes for comparing."""
    hashes = WordHashes()
    for batch in batches:
        sets = [shingle_set(t.as_py(), hashes).tobytes() for t in batch["text"].cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sets, pa.large_binary()).cast(pa.binary())], ["id", "shingles"])


def _lists(batches):
    """Each text's set, as numbers for joining."""
    hashes = WordHashes()
    for batch in batches:
        sets = [shingle_set(t.as_py(), hashes).view(np.int64) for t in batch["text"].cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])


def _confirm(batches, threshold: int):
    for batch in batches:
        keep = []
        for a, b in zip(batch["a_set"], batch["b_set"], strict=True):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= threshold * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def most_bits(threshold: int = THRESHOLD) -> int:
    """The largest population count of an XOR that isn't ruled out."""
    differ = 2 * ROWS * bands_for(threshold) * (1 - (threshold / 100 - SLACK))
    return math.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** differ))


def _facts(classes: DataFrame) -> DataFrame:
    """The bitmaps as columns that are never null: a join condition over arrays
    of this length is too long a method for the JVM to compile."""
    words = [(f"{c[0]}{i}", F.get(c, F.lit(i))) for c, n in (("sketch", BITS), ("parity", PARITY)) for i in range(n // 64)]
    return classes.select("id", *[F.coalesce(v, F.lit(0)).alias(k) for k, v in [("n_shingles", F.col("n_shingles")), *words]])


def _near(x: str, y: str, threshold: int) -> Column:
    """Whether set sizes and bitmaps leave room for a link."""

    def differ(kind: str, bits: int) -> Column:
        return sum((F.bit_count(F.col(f"{x}{kind}{i}").bitwiseXOR(F.col(f"{y}{kind}{i}"))) for i in range(bits // 64)), F.lit(0))

    n, m = F.col(f"{x}n_shingles"), F.col(f"{y}n_shingles")
    sizes = 100 * F.least(n, m) >= threshold * F.greatest(n, m)
    return sizes & (differ("s", BITS) <= most_bits(threshold)) & ((100 + threshold) * differ("p", PARITY) <= (100 - threshold) * (n + m))


def _side(facts: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """``facts`` with every column's name behind ``name``, but for ``key``."""
    return facts.select(*[F.col(c).alias(key if key and c == "id" else f"{name}{c}") for c in facts.columns])


def _texts(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of classes' representatives. What finds a text is its row's
    id and hash: few as a rule, so that the texts needn't move."""
    keys = hinted(written(ids.join(classes, "id").select("id", "doc_id", "text_hash"), "keys"))
    return docs.join(keys, ["doc_id", "text_hash"]).dropDuplicates(["id"]).select("id", "text")


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose full sets link."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = written(_texts(ids, classes, docs).mapInArrow(_sets, "id bigint, shingles binary"), "sets")
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("a_set")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("b_set")), "b")
    found = written(two.select("a", "b", "a_set", "b_set").mapInArrow(lambda batches: _confirm(batches, threshold), "a bigint, b bigint"), "links")
    remove(sets)
    return found


def _rare(ids: DataFrame, classes: DataFrame, docs: DataFrame, threshold: int, rare: int) -> tuple[DataFrame, DataFrame]:
    """Of the sets ``ids``: (id, shingle) of rare shingles among the first that
    links need, and (id, frequent) of sets that could link without one."""
    lists = written(_texts(ids, classes, docs).mapInArrow(_lists, "id bigint, shingles array<bigint>"), "lists")
    rows = lists.select("id", F.explode("shingles").alias("shingle"))
    owners = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= rare)
    few = written(rows.join(owners, "shingle"), "few")
    first = F.row_number().over(Window.partitionBy("id").orderBy("n", "shingle"))
    size = lists.select("id", F.size("shingles").alias("size"))
    # size - ceil(threshold * size / 100) + 1, in whole numbers.
    reach = F.expr(f"size - (({threshold} * size + 99) div 100) + 1")
    prefix = few.withColumn("_at", first).join(size, "id").where(F.col("_at") <= reach).where("n > 1").select("id", "shingle")
    own = few.groupBy("id").agg(F.count(F.lit(1)).alias("_few"))
    frequent = size.join(own, "id", "left").withColumn("frequent", F.col("size") - F.coalesce("_few", F.lit(0)))
    return prefix, frequent.where(100 * F.col("frequent") >= threshold * F.col("size")).select("id", F.col("frequent").cast("bigint").alias("frequent"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, small: int = SMALL, rare: int = RARE) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``class_id``, ``component_id``, ``kept``,
    ``text_hash`` and ``first`` of every row.

    ``class_id`` is the smallest id with an equal set, ``component_id`` the
    smallest id that links reach; sets link from ``threshold`` percent on. Null, empty and blank texts have the empty
    set and are linked with nothing. Rows are told apart, also where they
    repeat an id: each belongs where its own text does. ``kept`` is true for
    rows whose id is their component's; ``first`` for exactly one of each
    component's rows, ``text_hash`` (xxhash64 of the text) tells rows of one id
    apart. A row without an id is compared through
    an equal set only: it has that class, or none, and is kept if it has none.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, key, text, threshold, small, rare)


def _near_duplicates(docs: DataFrame, key: str, text: str, threshold: int, small: int, rare: int) -> DataFrame:
    bands = bands_for(threshold)
    own = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    numbered = own.withColumn("row", F.monotonically_increasing_id())
    signed = written(numbered.mapInArrow(lambda batches: _sign(batches, bands), SIGNATURE), "signatures")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row", "text_hash"))).alias("m")
    made = signed.where("digest is not null").groupBy("digest").agg(least, *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch", "parity")])
    # A class is known by a row of its own: ids may repeat.
    classes = written(made.where("m is not null").select("digest", F.col("m.row").alias("id"), F.col("m.doc_id").alias("doc_id"), F.col("m.text_hash").alias("text_hash"), "n_shingles", "bands", "sketch", "parity"), "classes")
    facts = _facts(classes)
    banded = classes.select(F.explode("bands").alias("band"), "id")
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(banded.join(shared, "band"), "members")
    # A bucket's head is the member that meets most others over all bands: the
    # one that a group of near copies was made from, where there is one.
    degree = members.groupBy("id").agg(F.sum("n").alias("degree"))
    heads = members.join(degree, "id").groupBy("band").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("m")).select("band", (-F.col("m.minus")).alias("head"))
    buckets = written(members.select("band", "id").join(heads, "band"), "buckets")
    remove(members)

    def close(pairs: DataFrame) -> DataFrame:
        """(a, b) with a sketch that leaves room for a link."""
        return pairs.join(_side(facts, "x_", "a"), "a").join(_side(facts, "y_", "b"), "b").where(_near("x_", "y_", threshold)).select("a", "b")

    stars = written(close(buckets.where("id <> head").select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct()), "stars")
    first = _links(stars, classes, own, threshold)
    known = written(connected_components(first), "components")

    # What is left: members of one bucket in different components.
    placed = buckets.join(known.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    per = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"))
    open_bands = per.where("low < high and members > 2").select("band", "members")
    rest = written(placed.join(open_bands, "band"), "open")

    def within(side: DataFrame, extra: Column | None = None) -> DataFrame:
        """Pairs in one bucket and different components, but for those with its head."""
        x, y = _side(side, "x_"), _side(side, "y_")
        fresh = (F.col("x_id") < F.col("y_id")) & (F.col("x_component") != F.col("y_component")) & (F.col("x_id") != F.col("x_head")) & (F.col("y_id") != F.col("x_head"))
        fresh = fresh & _near("x_", "y_", threshold)
        met = x.join(y, (F.col("x_band") == F.col("y_band")) & (fresh if extra is None else fresh & extra))
        return met.select(F.col("x_id").alias("a"), F.col("y_id").alias("b"))

    pairs = within(rest.where(F.col("members") <= small).drop("members").join(facts, "id"))
    wide = rest.where(F.col("members") > small).drop("members")
    ids = written(wide.select("id").distinct(), "wide")
    if ids.limit(1).count():
        prefix, mostly = _rare(ids, classes, own, threshold, rare)
        prefix = written(prefix, "prefix")
        mine, yours = prefix.select(F.col("id").alias("a"), "shingle"), prefix.select(F.col("id").alias("b"), "shingle")
        pairs = pairs.unionByName(close(mine.join(yours, "shingle").where("a < b").select("a", "b").distinct()))
        n, m, f, g = (F.col(c) for c in ("x_n_shingles", "y_n_shingles", "x_frequent", "y_frequent"))
        enough = (100 + threshold) * F.least(f, g) >= threshold * (n + m)
        pairs = pairs.unionByName(within(wide.join(written(mostly, "mostly"), "id").join(facts, "id"), enough))
    second = _links(written(pairs.distinct(), "across"), classes, own, threshold)
    final = written(connected_components(first.unionByName(second)), "components")
    remove(buckets, stars, rest, known)

    named = final.select(F.col("node").alias("id"), "component").join(classes.select("id", "doc_id"), "id")
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    tops = named.join(lowest, "component").select("id", "component", "component_id")
    known_classes = classes.select("digest", "id", F.col("doc_id").alias("class_id")).join(tops, "id", "left")
    known_classes = known_classes.select("digest", "class_id", F.coalesce("component", "id").alias("component"), F.coalesce("component_id", "class_id").alias("component_id"))
    classed = signed.select("row", "doc_id", "text_hash", "n_shingles", "digest").join(known_classes, "digest", "left")
    classed = classed.withColumn("class_id", F.coalesce("class_id", "doc_id")).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    classed = classed.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = classed.where("kept and component is not null").groupBy("component").agg(F.min("row").alias("_first"))
    out = classed.join(chosen, "component", "left").withColumn("first", F.col("kept") & (F.col("component").isNull() | (F.col("row") == F.col("_first"))))
    return out.select("doc_id", "n_shingles", "class_id", "component_id", "kept", "text_hash", F.coalesce("first", F.lit(False)).alias("first"))
