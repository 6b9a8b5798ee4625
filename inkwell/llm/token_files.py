"""Token ids in length-delimited binary record files, with an offset index.

A record holds one document: ``doc_id`` (8 bytes, signed), then its ids. The
frame is: length of the record (8 bytes), masked checksum of those 8 bytes
(4), the record, masked checksum of the record (4); all little-endian. The
checksum is CRC-32, rotated by 15 bits plus a constant, so that a file that
holds checksums can itself be checksummed. Ids take 2 bytes where the
vocabulary has at most 65,536 of them, else 4. Beside each data file stands an
index file of (doc_id, offset, length) triples for reads in any order.

Files hold ascending ranges of ``doc_id``: range bounds come from quantiles of
the id column alone, and one exchange deals out the texts. A file is written
under a name of its own and renamed when whole, so a repeated task replaces
its file instead of adding to it.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import struct
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, written

MASK_ADD = 0xA282EAD8
#: Stands in a file for an id that is null; reading gives the null back.
NULL_ID = -(1 << 63)
HEADER = struct.Struct("<QI")
TRIPLE = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("length", "<i8")])
#: Characters for each file, about; words that a worker's cache holds.
FILE_CHARS, CACHE = 32_000_000, 300_000
READ = 4 << 20
#: Bytes of text that are encoded together.
AT_ONCE = 2 << 20
MANIFEST = "part int, path string, first bigint, n_docs bigint, n_tokens bigint"


def masked(data) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_ADD) & 0xFFFFFFFF


def frame(record: bytes) -> bytes:
    size = struct.pack("<Q", len(record))
    return b"".join((size, struct.pack("<I", masked(size)), record, struct.pack("<I", masked(record))))


def frames(file):
    """(offset, record) of every frame; raises on a broken or cut-off one."""
    at = 0
    while head := file.read(12):
        if len(head) < 12 or masked(head[:8]) != HEADER.unpack(head)[1]:
            raise ValueError("a record's length is damaged")
        size = HEADER.unpack(head)[0]
        record = file.read(size)
        check = file.read(4)
        if len(record) < size or len(check) < 4 or masked(record) != struct.unpack("<I", check)[0]:
            raise ValueError("a record is damaged")
        yield at, record
        at += size + 16


def read_at(path: str, offset: int) -> bytes:
    """One record through its offset in the index."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as file:
        file.seek(offset)
        return next(frames(file))[1]


def read_index(path: str) -> np.ndarray:
    system, name = fs.FileSystem.from_uri(path + ".index")
    with system.open_input_stream(name) as file:
        return np.frombuffer(file.read(), TRIPLE)


#: Marks that end a word. Where one follows another sign a run of signs could
#: be cut; marks that combine with a letter make it another one; and special
#: tokens begin with ``<|``. Such texts are left as they are.
_ENDS = ".,!?;:*%$&#|"
_TAIL = f"([{_ENDS}]+)([ \\n]|$)"
_UNSAFE = f"(?:_|[^\\pL\\pN \\n\\t\\r{_ENDS}])[{_ENDS}]|[\\x{{300}}-\\x{{36f}}\\x{{130}}]|<[|]"


#: The steps of a tokenizer for which texts may be taken apart: what it does to
#: a text before its merges, and how its merges mark a word's end.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}


def separable(tokenizer) -> bool:
    """Whether ``parts_of`` and ``WordCache`` hold for a tokenizer. Others
    encode whole texts."""
    made = json.loads(tokenizer.to_str())
    marks = all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in made["added_tokens"])
    model = made["model"]
    return marks and all(made[k] == v for k, v in STEPS.items()) and (model["type"], model["end_of_word_suffix"], model["continuing_subword_prefix"], model["dropout"]) == ("BPE", "</w>", None, None)


def parts_of(texts: pa.Array) -> pa.Array:
    """Texts in parts that the tokenizer encodes one by one as it would the
    whole: it drops white space and never joins what a space or a line feed
    separates, nor a letter and a sign. Where that is safe, A-Z is lowered and
    the signs behind a word stand apart, so that parts recur more often."""
    texts = pc.fill_null(texts, "")
    plain = pc.replace_substring_regex(pc.ascii_lower(texts), _TAIL, r" \1\2")
    texts = pc.if_else(pc.match_substring_regex(texts, _UNSAFE), texts, plain)
    return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")


def slices(texts: pa.Array, limit: int):
    """(begin, length) of runs of texts with about ``limit`` bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(ends):
        base = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield begin, stop - begin
        begin = stop


class WordCache:
    """Encodes texts part by part with a bounded cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.separable = separable(self.tokenizer)
        self.size = len(vocabulary)
        #: Ids that end a word.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        #: Words in order of their slots; how many batches held each one.
        self.index: dict[str, int] = {}
        self.flat, self.begin, self.count, self.uses = np.empty(0, np.uint32), *(np.empty(0, np.int64) for _ in range(3))

    def _trim(self) -> None:
        """Keep the words that came again, half of the cache at most: nearly
        all new words of a text are met once."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > CACHE // 2:
            keep = np.sort(keep[np.argpartition(-self.uses[keep], CACHE // 2)[: CACHE // 2]])
        words = list(self.index)
        begin, count, uses = self.begin[keep], self.count[keep], self.uses[keep]
        ends = np.cumsum(count)
        flat = self.flat[np.repeat(begin - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.index = {words[i]: k for k, i in enumerate(keep.tolist())}
        self.flat, self.begin, self.count, self.uses = flat, ends - count, count, uses >> 1

    def _store(self, parts: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        self.index.update(zip(parts, range(len(self.count), len(self.count) + len(parts)), strict=True))
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.flat = np.concatenate((self.flat, ids))
        self.uses = np.concatenate((self.uses, np.zeros(len(parts), np.int64)))

    def _add(self, fresh: list[str]) -> None:
        """Plain words are encoded side by side and told apart by the ids that
        end a word; all else goes through the library's own word numbers."""
        plain = [w for w in fresh if w.isalpha() and w.islower() and unicodedata.is_normalized("NFC", w)]
        if plain:
            texts = (" ".join(plain[i : i + 2000]) for i in range(0, len(plain), 2000))
            ids = np.concatenate([np.array(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.uint32) for t in texts])
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(plain):
                self._store(plain, ids, np.diff(ends, prepend=0))
                fresh = [w for w in fresh if w not in self.index]
        if fresh:
            got = self.tokenizer.encode(fresh, is_pretokenized=True, add_special_tokens=False)
            self._store(fresh, np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(fresh)))

    def encode(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """Ids of every text with ``end`` behind them."""
        if not self.separable:
            got = self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            return [np.array([*x.ids, end], np.uint32) for x in got]
        parts = parts_of(texts)
        coded = parts.flatten().dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.index) >= CACHE:
            self._trim()
        slots = np.fromiter(map(self.index.get, known, itertools.repeat(-1)), np.int64, len(known))
        if len(missing := np.flatnonzero(slots < 0)):
            fresh = [known[i] for i in missing.tolist()]
            self._add(fresh)
            slots[missing] = np.fromiter(map(self.index.__getitem__, fresh), np.int64, len(fresh))
        self.uses[slots] += 1
        which = slots[coded.indices.to_numpy()]
        count = self.count[which]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(self.begin[which] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        # Where each text's parts, and so its ids, end.
        upto = np.cumsum(parts.value_lengths().to_numpy())
        stops = np.concatenate(([0], ends))[upto]
        ids = np.insert(ids, stops, end)
        return np.split(ids, stops[:-1] + np.arange(1, len(stops)))


@functools.lru_cache(1)
def worker_cache(path: str, changed: float) -> WordCache:
    """One cache for all tasks that a Python worker runs one after another."""
    return WordCache(path)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end: int = 1, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Encode, frame and write; returns the manifest, one row for each file.

    Null and empty texts become a record with the end id alone; equal ids stand
    side by side, in no order among them; a null id stands as ``NULL_ID``, before
    all others. No rows, no files. ``parts`` follows from the characters unless given.
    """
    own = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).alias("text"))
    if parts is None:
        n, chars = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        parts = max(1, min(n, -(-chars // FILE_CHARS)))
    # Ranges of ids: equal ids fall into one, and the files' order is that of
    # the partitions. No cut is part of the plan.
    dealt = own.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())

    def run(batches):
        cache = worker_cache(tokenizer, os.path.getmtime(tokenizer))
        narrow = cache.size <= 1 << 16
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        data = index = None
        at = n_docs = n_tokens = first = part = 0
        name = f"{base}/.{uuid.uuid4().hex}"
        for batch in batches:
            for begin, length in slices(batch["text"], AT_ONCE):
                rows = batch.slice(begin, length)
                ids = rows["doc_id"].to_pylist()
                if data is None:
                    part, first = rows["part"][0].as_py(), ids[0]
                    data, index = system.open_output_stream(name), system.open_output_stream(f"{name}.index")
                triples = []
                for doc, got in zip(ids, cache.encode(rows["text"], end), strict=True):
                    record = struct.pack("<q", doc) + got.astype("<u2" if narrow else "<u4").tobytes()
                    data.write(frame(record))
                    triples.append((doc, at, len(record)))
                    at += len(record) + 16
                    n_docs += 1
                    n_tokens += len(got)
                index.write(np.array(triples, TRIPLE).tobytes())
        if data is not None:
            data.close()
            index.close()
            final = f"{base}/tokens-{part:06d}"
            system.move(f"{name}.index", f"{final}.index")
            system.move(name, final)
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/tokens-{part:06d}"], "first": [first], "n_docs": [n_docs], "n_tokens": [n_tokens]}, pa.schema([("part", pa.int32()), ("path", pa.string()), ("first", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    with small_batches(docs.sparkSession):
        return written(dealt.mapInArrow(run, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame, width: int = 2) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` from the files.

    Files are read record by record, each by one task; every checksum is
    verified. ``start`` counts the ids of all documents before, in file order.
    """
    from pyspark.sql import Window

    # One row for each file, and a running sum over these few rows.
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", base.alias("base"))
    # A number that is named isn't merged at run time: file lists are tiny rows
    # that stand for large reads.
    files = files.repartition(max(1, manifest.count()), "path")

    def run(batches):
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_stream(name, buffer_size=READ) as file:
                    for part in iter(lambda f=frames(file): list(itertools.islice(f, 2000)), []):
                        rows = []
                        for _, record in part:
                            ids = np.frombuffer(record, "<u2" if width == 2 else "<u4", offset=8)
                            rows.append((struct.unpack_from("<q", record)[0], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    read = files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def token_files(docs: DataFrame, tokenizer: str, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents to a shared folder and read the files back."""
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    folder = f"{shared_dir(docs.sparkSession)}/tokens"
    return read_tokens(write_tokens(docs, tokenizer, folder, end, key, text), width)
