"""SentencePiece encoding and decoding, batched in numpy.

Chunks (a run of spaces with the characters behind it, or a line break) are
encoded once for each worker's cache; those of one length advance together.
Hashes of all substrings up to the longest piece probe a sorted array of piece
hashes, which gives a table of piece ids by (chunk, start, length). From it

* ``unigram`` models take the best path: vectorised maxima over the pieces that
  end at a position store backpointers (Viterbi);
* ``bpe`` models merge: in every round the vectorised maximum over neighbouring
  symbols picks each chunk's best merge. The best path over a BPE model's
  scores is not what its merges give, so Viterbi can't be right for them.

Pieces never hold a space behind another character, nor a line break, so that
chunks don't influence one another; ``load`` checks this.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import set_batches

SPACE = "▁"
CHUNK = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
#: Chunks that a worker's cache holds, chunks encoded at once, longest chunk
#: that the batch takes: a longer one goes through ``_long_steps``.
CACHE, BATCH, LONGEST = 150_000, 4096, 64
_P = np.uint64(0x9E3779B97F4A7C15)
LOW = -1e18
SEEN_BITS = 20


@dataclass
class Model:
    kind: str
    pieces: list[str]
    scores: np.ndarray
    #: Ids of bytes 0..255, or -1.
    bytes_: np.ndarray
    unknown: int
    dummy_prefix: bool
    keys: np.ndarray
    ids: np.ndarray
    #: True where a key has these top bits: most probes end here.
    seen: np.ndarray
    longest: int
    control: np.ndarray
    rank: dict[str, float]
    id_of: dict[str, int]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _roll(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return _mix(h * _P + code.astype(np.uint64) + np.uint64(1))


def load(path: str, kind: str | None = None) -> Model:
    """Read a model file. ``kind`` overrides the algorithm that it names."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    types = np.array([p.type for p in proto.pieces])
    if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models that leave the text as it is are supported")
    kind = kind or {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type]
    return build([p.piece for p in proto.pieces], np.array([p.score for p in proto.pieces], np.float64), types, kind, proto.normalizer_spec.add_dummy_prefix)


def build(pieces: list[str], scores: np.ndarray, types: np.ndarray, kind: str, dummy_prefix: bool = True) -> Model:
    """A model from its pieces. ``types``: 1 normal, 2 unknown, 3 control, 6 byte."""
    normal = [i for i in range(len(pieces)) if types[i] in (1, 4)]
    if any(SPACE in pieces[i].lstrip(SPACE) or "\n" in pieces[i] for i in normal):
        raise ValueError("a piece spans words or lines")
    hashes = np.empty(len(normal), np.uint64)
    for j, i in enumerate(normal):
        h = np.zeros(1, np.uint64)
        for c in pieces[i]:
            h = _roll(h, np.array([ord(c)]))
        hashes[j] = h[0]
    if len(np.unique(hashes)) < len(hashes):
        raise ValueError("two pieces have one hash")
    order = np.argsort(hashes)
    seen = np.zeros(1 << SEEN_BITS, bool)
    seen[hashes >> np.uint64(64 - SEEN_BITS)] = True
    byte_ids = np.full(256, -1, np.int64)
    for i in np.flatnonzero(types == 6):
        byte_ids[int(pieces[i][3:5], 16)] = i
    unknown = int(np.flatnonzero(types == 2)[0]) if (types == 2).any() else 0
    return Model(kind, pieces, scores, byte_ids, unknown, dummy_prefix, hashes[order], np.array(normal, np.int64)[order], seen, max((len(pieces[i]) for i in normal), default=1), np.isin(types, (2, 3)), {pieces[i]: float(scores[i]) for i in normal}, {pieces[i]: i for i in normal})


def _probe(model: Model, codes: np.ndarray) -> np.ndarray:
    """Piece ids of all substrings: [chunk, start, length - 1], -1 where none."""
    n, size = codes.shape
    top = min(model.longest, size)
    found = np.full((n, size, top), -1, np.int32)
    h = np.zeros((n, size), np.uint64)
    for k in range(top):
        h = _roll(h[:, : size - k], codes[:, k:])
        maybe = np.flatnonzero(model.seen[h.ravel() >> np.uint64(64 - SEEN_BITS)])
        asked = h.ravel()[maybe]
        at = np.searchsorted(model.keys, asked)
        at[at == len(model.keys)] = 0
        hit = model.keys[at] == asked
        row, start = np.divmod(maybe[hit], size - k)
        found[row, start, k] = model.ids[at[hit]]
    return found


def _viterbi(model: Model, found: np.ndarray) -> np.ndarray:
    """Lengths of the pieces that start a step of the best path, [chunk, start]; else 0."""
    n, size, top = found.shape
    score = np.where(found >= 0, model.scores[found], LOW)
    # A character of no piece may stand alone, at a score below all others.
    score[:, :, 0] = np.where(found[:, :, 0] >= 0, score[:, :, 0], model.scores.min() - 10)
    best = np.full((n, size + 1), LOW)
    best[:, 0] = 0
    back = np.zeros((n, size + 1), np.int64)
    for end in range(1, size + 1):
        lengths = np.arange(1, min(top, end) + 1)
        ways = best[:, end - lengths] + score[:, end - lengths, lengths - 1]
        pick = ways.argmax(axis=1)
        best[:, end] = ways[np.arange(n), pick]
        back[:, end] = lengths[pick]
    steps = np.zeros((n, size), np.int64)
    at = np.full(n, size)
    while (live := np.flatnonzero(at > 0)).size:
        length = back[live, at[live]]
        at[live] -= length
        steps[live, at[live]] = length
    return steps


def _merge(model: Model, found: np.ndarray) -> np.ndarray:
    """As ``_viterbi`` returns, by merging the best neighbours in rounds."""
    n, size, top = found.shape
    steps = np.ones((n, size), np.int64)  # length of the symbol that starts here, else 0
    rows = np.arange(n)
    score = np.where(found >= 0, model.scores[found], LOW)
    after = np.tile(np.arange(1, size + 1), (n, 1))  # where the next symbol starts

    def pair(r: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Score of merging the symbols at s with the next ones."""
        middle = after[r, s]
        ok = middle < size
        end = np.where(ok, after[r, np.minimum(middle, size - 1)], size)
        length = end - s
        ok &= length <= top
        return np.where(ok, score[r, s, np.minimum(length, top) - 1], LOW)

    value = np.full((n, size), LOW)
    for s in range(size - 1):
        value[:, s] = pair(rows, np.full(n, s))
    live = rows
    while live.size:
        s = value[live].argmax(axis=1)  # the leftmost of equal ones
        go = value[live, s] > LOW
        live, s = live[go], s[go]
        if not live.size:
            break
        middle = after[live, s]
        after[live, s] = after[live, middle]
        steps[live, s] += steps[live, middle]
        steps[live, middle] = 0
        value[live, middle] = LOW
        value[live, s] = pair(live, s)
        # The symbol before s has a new neighbour.
        before = s - 1
        while (move := (before >= 0) & (steps[live, np.maximum(before, 0)] == 0)).any():
            before = before - move
        has = before >= 0
        value[live[has], before[has]] = pair(live[has], before[has])
    return steps


def _long_steps(model: Model, text: str) -> list[int]:
    """The same for one long chunk, with a heap of merges or a plain best path:
    linear memory, whatever its length."""
    import heapq

    rank = model.rank
    n = len(text)
    if model.kind == "unigram":
        best, back = [0.0] + [LOW] * n, [0] * (n + 1)
        lone = float(model.scores.min() - 10)
        for end in range(1, n + 1):
            for length in range(1, min(model.longest, end) + 1):
                s = rank.get(text[end - length : end], lone if length == 1 else None)
                if s is not None and best[end - length] + s > best[end]:
                    best[end], back[end] = best[end - length] + s, length
        steps, at = [0] * n, n
        while at:
            length = back[at]
            at -= length
            steps[at] = length
        return steps
    size, left, right, heap = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1)), []

    def offer(i: int) -> None:
        j = right[i]
        if i >= 0 and j < n and size[i] + size[j] <= model.longest and (s := rank.get(text[i : j + size[j]])) is not None:
            heapq.heappush(heap, (-s, i, size[i], size[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i] if size[i] == a else n
        if size[i] != a or j >= n or size[j] != b:
            continue
        size[i], size[j] = a + b, 0
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return size


def encode_chunks(model: Model, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The chunks by length, their ids one after the other, and how many each has."""
    by_length: dict[int, list[str]] = {}
    for c in chunks:
        by_length.setdefault(len(c), []).append(c)
    ordered: list[str] = []
    flat, count = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for size, members in by_length.items():
        ordered += members
        for at in range(0, len(members), step := max(1, BATCH * 8 // size)):
            part = members[at : at + step]
            codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), size)
            if size > LONGEST:
                for i, c in enumerate(members[at : at + step]):
                    steps = np.array(_long_steps(model, c))
                    s = np.flatnonzero(steps)
                    ids = np.array([model.id_of.get(c[a : a + steps[a]], -1) for a in s.tolist()], np.int32)
                    got, each = _with_bytes(model, ids, codes[i, s], np.zeros(len(s), np.int64), 1)
                    flat.append(got)
                    count.append(each)
                continue
            found = _probe(model, codes)
            steps = (_viterbi if model.kind == "unigram" else _merge)(model, found)
            r, s = np.nonzero(steps)
            got, each = _with_bytes(model, found[r, s, steps[r, s] - 1], codes[r, s], r, len(part))
            flat.append(got)
            count.append(each)
    return ordered, np.concatenate(flat), np.concatenate(count)


def _with_bytes(model: Model, ids: np.ndarray, codes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, with the UTF-8 bytes of characters that are no piece (else the
    unknown id), and how many each row has."""
    lost = ids < 0
    if not lost.any():
        return ids, np.bincount(rows, minlength=n)
    if not (model.bytes_ >= 0).all():
        return np.where(lost, model.unknown, ids).astype(np.int32), np.bincount(rows, minlength=n)
    width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    times = np.where(lost, width, 1)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    code, w, out = np.repeat(codes, times).astype(np.int64), np.repeat(width, times), np.repeat(ids, times)
    byte = np.where(w == 1, code, np.where(nth == 0, (0xF00 >> w) & 0xFF | code >> (6 * (w - 1)), 0x80 | code >> (6 * (w - 1 - nth)) & 0x3F))
    again = np.repeat(lost, times)
    out[again] = model.bytes_[byte[again]]
    return out.astype(np.int32), np.bincount(np.repeat(rows, times), minlength=n)


class Encoder:
    """Encodes texts with a bounded cache of chunks."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.begin, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _add(self, fresh: list[str]) -> None:
        ordered, flat, count = encode_chunks(self.model, fresh)
        self.index.update(zip(ordered, range(len(self.count), len(self.count) + len(ordered)), strict=True))
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.flat = np.concatenate((self.flat, flat))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text; a null or empty text has none. What the cache
        lacks of all of them is encoded together."""
        prefix = " " if self.model.dummy_prefix else ""
        chunks = [CHUNK.findall((prefix + t).replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.index) >= CACHE or len(self.flat) > 8 * CACHE:
            self._reset()
        if fresh := [c for c in dict.fromkeys(c for own in chunks for c in own) if c not in self.index]:
            self._add(fresh)
        out = []
        for own in chunks:
            which = np.fromiter(map(self.index.__getitem__, own), np.int64, len(own))
            out.append(gathered(self.flat, self.begin[which], self.count[which]))
        return out


def gathered(flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` in turn, as one array."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begin - (ends - count), count) + np.arange(total)]


class Decoder:
    """Texts of id sequences: pieces' bytes in turn, spaces for ``SPACE``."""

    def __init__(self, model: Model):
        parts = []
        for i, p in enumerate(model.pieces):
            byte = np.flatnonzero(model.bytes_ == i)
            parts.append(b"" if model.control[i] and i != model.unknown else " ⁇ ".encode() if i == model.unknown else bytes([int(byte[0])]) if byte.size else p.replace(SPACE, " ").encode())
        self.count = np.array([len(p) for p in parts], np.int64)
        self.begin = np.cumsum(self.count) - self.count
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.prefix = model.dummy_prefix

    def decode(self, ids: np.ndarray) -> bytes:
        raw = gathered(self.flat, self.begin[ids], self.count[ids]).tobytes()
        return raw[1:] if self.prefix and raw[:1] == b" " else raw


_MODELS: dict[tuple[str, str | None], Model] = {}


def _model(path: str, kind: str | None) -> Model:
    if (path, kind) not in _MODELS:
        _MODELS[path, kind] = load(path, kind)
    return _MODELS[path, kind]


def encode_documents(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", kind: str | None = None, ids: bool = True) -> DataFrame:
    """``key``, ``n_tokens``, ``ids_crc32``, ``round_trip`` and (``ids``) ``token_ids``.

    ``ids_crc32`` is over the ids as little-endian 32-bit numbers,
    ``round_trip`` whether they decode to the very text. Null and empty texts
    have no ids and decode to nothing (true). A narrow job: no shuffle, repeated
    rows are encoded alike. The model file must be on every executor.
    """
    from pyspark.sql import functions as F

    # The result is computed when it is read, so the setting stays.
    set_batches(docs.sparkSession)
    own = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    key_type = own.schema["_key"].dataType.simpleString()

    def run(batches):
        model = _model(model_path, kind)
        encoder, decoder = Encoder(model), Decoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part["_text"].to_pylist()
                got = encoder.encode(texts)
                columns = [
                    part["_key"],
                    pa.array([len(x) for x in got], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in got], pa.int64()),
                    pa.array([decoder.decode(x) == (t or "").encode() for x, t in zip(got, texts, strict=True)], pa.bool_()),
                ]
                names = ["_key", "n_tokens", "ids_crc32", "round_trip"]
                if ids:
                    columns.append(pa.array(got, pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"_key {key_type}, n_tokens bigint, ids_crc32 bigint, round_trip boolean" + ", token_ids array<int>" * ids
    return own.mapInArrow(run, schema).withColumnRenamed("_key", key)
