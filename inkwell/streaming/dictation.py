"""Dictation: speech probabilities to utterances, in batch and as a stream.

One function takes in chunks of any size and serves both. A recording is the
key; its state is small and bounded (an open utterance has at most 875 frames), whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RATE, FRAME = 16_000, 512
FRAME_MS = FRAME * 1000 // RATE
MAX_CHARACTERS, TAPS, CUTOFF = 100_000, 32, 0.9


def frames(ms: int) -> int:
    return max(1, -(-ms * RATE // 1000 // FRAME))


@dataclass(frozen=True)
class Policy:
    """Thresholds and times, in milliseconds."""

    start: float = 0.5
    end: float = 0.35
    min_speech: int = 250
    end_silence: int = 700
    pre_roll: int = 300
    post_pad: int = 200
    max_utterance: int = 28_000
    split_search: int = 2_000
    provisional_every: int = 1_200
    min_provisional: int = 1_000
    max_session: int = 600_000


@dataclass
class Recording:
    """What is kept of a recording between chunks: how many frames it had, the
    frames that may still matter (those before an utterance, or the open one),
    the number of utterances so far, whether one is open, its length when its
    last provisional result was asked for, and whether the recording is over."""

    seen: int = 0
    number: int = 0
    open: bool = False
    asked_at: int = 0
    over: bool = False
    kept: np.ndarray = field(default_factory=lambda: np.empty(0))


#: (kind, utterance, first frame, frames)
Event = tuple[str, int, int, int]


def run_lengths(hit: np.ndarray) -> np.ndarray:
    """For each place how many hits in a row end there."""
    places = np.arange(1, len(hit) + 1)
    return places - np.maximum.accumulate(np.where(hit, 0, places)) if len(hit) else places


def _first(condition: np.ndarray, since: int) -> int:
    """The first place from ``since`` on, or one behind the end."""
    found = np.flatnonzero(condition[since:])
    return since + int(found[0]) if len(found) else len(condition)


def advance(rec: Recording, probabilities: np.ndarray, policy: Policy = Policy()) -> list[Event]:
    """Take in a chunk of frames; returns what happened, and leaves in ``rec``
    what the next chunk needs. Work is done for each transition, over arrays."""
    if rec.over:
        return []
    need, quiet, longest = frames(policy.min_speech), frames(policy.end_silence), frames(policy.max_utterance)
    lead, limit = frames(policy.pre_roll) + need, frames(policy.max_session)
    x = np.concatenate((rec.kept, probabilities[: limit - rec.seen]))
    new, begin = len(rec.kept), rec.seen - len(rec.kept)
    events: list[Event] = []
    while new < len(x):
        if not rec.open:
            # Speech: enough loud frames in a row. It takes the frames before along.
            at = _first(run_lengths(x >= policy.start) >= need, new)
            if at == len(x):
                break
            cut = max(0, at + 1 - lead)
            x, begin, new = x[cut:], begin + cut, at + 1 - cut
            rec.open, rec.asked_at, rec.number = True, new, rec.number + 1
            events.append(("started", rec.number, begin, 0))
            continue
        silence = run_lengths(x < policy.end)
        ends = _first(silence >= quiet, new)
        asks = max(rec.asked_at + frames(policy.provisional_every), frames(policy.min_provisional), new + 1) - 1
        at = min(ends, max(longest - 1, new), asks)
        if at >= len(x):
            break
        if at == ends:
            # The end: trailing silence is cut to the padding.
            events.append(("final", rec.number, begin, at + 1 - int(silence[at]) + min(int(silence[at]), frames(policy.post_pad))))
            rec.open, x, begin, new = False, x[at + 1 :], begin + at + 1, 0
        elif at + 1 >= longest:
            # Too long: cut at the quietest of the last frames, the latest of equal ones.
            low = max(1, at + 1 - frames(policy.split_search))
            cut = at - int(np.argmin(x[low : at + 1][::-1]))
            events.append(("final", rec.number, begin, cut))
            x, begin, new = x[cut:], begin + cut, at + 1 - cut
            rec.number, rec.asked_at = rec.number + 1, new
        else:
            rec.asked_at = new = at + 1
            events.append(("provisional", rec.number, begin, new))
    rec.seen = begin + len(x)
    rec.kept = x if rec.open else x[-lead:]
    if rec.seen >= limit:
        events += finished(rec, policy) + [("limit", 0, rec.seen, 0)]
        rec.over = True
    return events


def finished(rec: Recording, policy: Policy = Policy()) -> list[Event]:
    """The open utterance's end; one with too little speech is dropped."""
    x, was, rec.open, rec.kept = rec.kept, rec.open, False, np.empty(0)
    silence = int(run_lengths(x < policy.end)[-1]) if len(x) else 0
    if not was or len(x) - silence < frames(policy.min_speech):
        return []
    return [("final", rec.number, rec.seen - len(x), len(x) - silence + min(silence, frames(policy.post_pad)))]


#: A recording's state in the stream.
STATE = "seen bigint, number bigint, open boolean, asked_at bigint, over boolean, kept array<double>, seq bigint"
EVENTS = "stream_id bigint, seq bigint, kind string, utterance bigint, start_ms bigint, length_ms bigint"


def _frame_of(stream: int, seq: int, event: Event) -> tuple:
    kind, number, first, n = event
    return stream, seq, kind, number, first * FRAME_MS, n * FRAME_MS


def clamp(probability: Column) -> Column:
    """Probabilities within 0 and 1; what isn't finite is 0."""
    ok = probability.isNotNull() & ~F.isnan(probability) & (F.abs(probability) < float("inf"))
    return F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(0.0), probability))).otherwise(0.0)


def segment(frames_table: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Events of each recording of (stream_id, frame_no, probability).

    A recording ends after ``max_session`` frames, so a group that is handed
    to Python is cut to those first: later frames can't change its events.
    """
    import pandas as pd

    w = Window.partitionBy("stream_id").orderBy("frame_no")
    cut = frames_table.select("stream_id", "frame_no", clamp(F.col("probability")).alias("probability")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= frames(policy.max_session)).drop("_n")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_no")
        rec = Recording()
        rows = advance(rec, pdf["probability"].to_numpy(), policy) + finished(rec, policy)
        stream = int(pdf["stream_id"].iloc[0])
        return pd.DataFrame([_frame_of(stream, i, e) for i, e in enumerate(rows)], columns=[c.split()[0] for c in EVENTS.split(", ")])

    return cut.groupBy("stream_id").applyInPandas(run, EVENTS)


def segment_stream(frames_stream: DataFrame, policy: Policy = Policy(), idle_ms: int = 90_000) -> DataFrame:
    """The same for a stream of frames that arrive in order for each recording.

    A recording that stays silent for ``idle_ms`` of processing time is
    finished, and its state goes.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = [c.split()[0] for c in EVENTS.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rec, seq = Recording(), 0
        if state.exists:
            *own, kept, seq = state.get
            rec = Recording(*own, np.array(kept, float))
        if state.hasTimedOut:
            rows = finished(rec, policy)
            state.remove()
        else:
            got = pd.concat(list(parts)).sort_values("frame_no")
            rows = advance(rec, got["probability"].to_numpy(), policy)
            state.update((rec.seen, rec.number, rec.open, rec.asked_at, rec.over, rec.kept.tolist(), seq + len(rows)))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([_frame_of(key[0], seq + i, e) for i, e in enumerate(rows)], columns=names)

    clean = frames_stream.withColumn("probability", clamp(F.col("probability")))
    return clean.groupBy("stream_id").applyInPandasWithState(run, EVENTS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def replay(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Frames (stream_id, frame_no, probability) of recorded files as a stream,
    so many files in each batch."""
    schema = "stream_id bigint, frame_no bigint, probability double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def queue_order(jobs: DataFrame) -> DataFrame:
    """Jobs in the order that a recogniser takes them: final ones first, in
    turn; of provisional ones only the latest of a recording is left."""
    last = F.max(F.when(~F.col("is_final"), F.col("seq"))).over(Window.partitionBy("stream_id"))
    kept = jobs.withColumn("_last", last).where(F.col("is_final") | (F.col("seq") == F.col("_last"))).drop("_last")
    by = Window.partitionBy("stream_id").orderBy(F.desc("is_final"), "seq")
    return kept.withColumn("turn", F.row_number().over(by))


def backlog_ok(jobs: DataFrame, limit_ms: int = 60_000) -> DataFrame:
    """Whether a recording's waiting final jobs stay within the limit."""
    return jobs.where("is_final").groupBy("stream_id").agg(F.sum("length_ms").alias("waiting_ms")).withColumn("ok", F.col("waiting_ms") <= limit_ms)


def accept(results: DataFrame) -> DataFrame:
    """Recognised results (stream_id, seq, utterance, is_final, text) that are
    shown: all final ones with text, and provisional ones of utterances after
    the last final one so far. ``over_limit`` marks final texts beyond the
    length of a note."""
    by = Window.partitionBy("stream_id").orderBy("seq")
    done = F.max(F.when(F.col("is_final"), F.col("utterance"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    size = F.sum(F.when(F.col("is_final") & F.col("text").isNotNull(), F.length("text") + 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    out = results.withColumn("_done", F.coalesce(done, F.lit(0))).withColumn("over_limit", size > MAX_CHARACTERS)
    return out.where(F.col("text").isNotNull() & (F.col("is_final") | (F.col("utterance") > F.col("_done")))).drop("_done")


def level(samples: Column) -> Column:
    """Loudness of samples: -60 to 0 dBFS as 0 to 1; silence and NaN are 0."""
    mean = F.try_divide(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), F.size(samples))
    db = 10 * F.log10(mean)
    return F.when((F.size(samples) > 0) & (mean > 0) & ~F.isnan(mean), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (db + 60) / 60))).otherwise(0.0)


def level_meter(samples: DataFrame, size: int = 1024) -> DataFrame:
    """Levels of windows of ``size`` samples, from (stream_id, pos, sample)."""
    mean = F.avg(F.col("sample").cast("double") * F.col("sample"))
    by = samples.groupBy("stream_id", F.floor(F.col("pos") / size).alias("window")).agg(mean.alias("m"))
    db = 10 * F.log10(F.col("m"))
    return by.select("stream_id", "window", F.when((F.col("m") > 0) & ~F.isnan("m"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (db + 60) / 60))).otherwise(0.0).alias("level"))


def downmix(channels: Column) -> Column:
    """Mean over channels of interleaved frames (array of arrays)."""
    return F.transform(channels, lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.greatest(F.lit(1), F.size(c)))


HALF = TAPS // 2


def outputs_after(samples: int, source: int, target: int = RATE) -> int:
    """How many output samples exist once ``samples`` of input are there: those
    whose position lies more than half a filter before the end."""
    return max(0, -(-(samples - HALF) * target // source))


def resampled(samples: np.ndarray, first: int, source: int, target: int, begin: int, end: int) -> np.ndarray:
    """Output samples ``begin`` to ``end`` of a recording of which ``samples``
    are those from number ``first`` on: a windowed sinc over the inputs around
    each position. Inputs before the recording's start don't exist and the
    weights of the others are scaled to one."""
    if source == target:
        return samples[begin - first : end - first]
    if end <= begin:
        return np.empty(0)
    at = np.arange(begin, end, dtype=np.int64) * source
    whole, part = at // target, (at % target) / target
    offset = np.arange(1 - HALF, HALF + 1)
    taps, x = whole[:, None] + offset, part[:, None] - offset
    weight = np.sinc(x * CUTOFF * min(1.0, target / source)) * (0.5 + 0.5 * np.cos(np.pi * x / HALF))
    weight[taps < 0] = 0.0
    total = weight.sum(axis=1)
    mean = (samples[np.clip(taps - first, 0, len(samples) - 1)] * weight).sum(axis=1)
    return np.divide(mean, total, out=np.zeros_like(mean), where=np.abs(total) >= 1e-9)


class Resampler:
    """The same for chunks as they come; what later outputs need is kept."""

    def __init__(self, source: int, target: int = RATE):
        self.source, self.target = source, target
        self.kept, self.seen = np.empty(0), 0

    def push(self, samples: np.ndarray) -> np.ndarray:
        """Output samples whose inputs are all there by now."""
        first = self.seen - len(self.kept)
        held = np.concatenate((self.kept, samples))
        if self.source == self.target:
            return held
        done, self.seen = outputs_after(self.seen, self.source, self.target), self.seen + len(samples)
        out = resampled(held, first, self.source, self.target, done, outputs_after(self.seen, self.source, self.target))
        self.kept = held[max(0, len(held) - TAPS) :]
        return out


def resample(chunks: DataFrame, source: int, target: int = RATE) -> DataFrame:
    """Resampled chunks of each recording, from (stream_id, chunk, samples).

    A chunk needs its first sample's number and the last ``TAPS`` samples
    before it, no more: both come from window functions over the ends of
    chunks, so chunks are independent and no recording is held in one place.
    An empty or null chunk gives an empty one.
    """
    import pyarrow as pa

    by = Window.partitionBy("stream_id").orderBy("chunk")
    size = F.coalesce(F.size("samples"), F.lit(0))
    own = chunks.select("stream_id", "chunk", F.coalesce(F.col("samples").cast("array<double>"), F.array().cast("array<double>")).alias("samples"))
    # Of chunks that are shorter than the filter, as many as it can reach.
    ends = F.flatten(F.collect_list(F.when(size > 0, F.slice("samples", F.greatest(F.lit(1), size - TAPS + 1), F.lit(TAPS)))).over(by.rowsBetween(-TAPS, -1)))
    full = own.where(size > 0).withColumn("_first", F.coalesce(F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_tail", ends)
    full = full.withColumn("_tail", F.slice("_tail", F.greatest(F.lit(1), F.size("_tail") - TAPS + 1), F.lit(TAPS)))

    def run(batches):
        for batch in batches:
            out = []
            for first, tail, own in zip(batch["_first"].to_pylist(), batch["_tail"], batch["samples"], strict=True):
                before, now = (x.values.to_numpy(zero_copy_only=False) for x in (tail, own))
                held, start = np.concatenate((before, now)), first - len(before)
                begin, end = (first, first + len(now)) if source == target else (outputs_after(n, source, target) for n in (first, first + len(now)))
                out.append(resampled(held, start, source, target, begin, end))
            lists = pa.array(out, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["stream_id"], batch["chunk"], lists], ["stream_id", "chunk", "samples"])

    shape = "stream_id bigint, chunk bigint, samples array<double>"
    made = full.select(F.col("stream_id").cast("bigint").alias("stream_id"), F.col("chunk").cast("bigint").alias("chunk"), "samples", "_first", "_tail").mapInArrow(run, shape)
    return made.unionByName(own.where(size == 0).select(F.col("stream_id").cast("bigint").alias("stream_id"), F.col("chunk").cast("bigint").alias("chunk"), "samples"))


HOP, CONTEXT = 8, 16


def hop_plan(recordings: DataFrame) -> DataFrame:
    """How voice detection takes each recording of (stream_id, n_samples):
    (stream_id, hop, first, n_frames, context). Hops of ``HOP`` frames, at the
    end the whole frames that are left; samples of a frame that isn't whole go.
    Each hop is scored behind up to ``CONTEXT`` frames before it, whose own
    scores are left out."""
    whole = F.expr(f"n_samples div {FRAME}")
    hops = recordings.where(whole > 0).select("stream_id", whole.alias("_n"), F.posexplode(F.sequence(F.lit(0).cast("bigint"), whole - 1, F.lit(HOP).cast("bigint"))).alias("hop", "first"))
    return hops.select("stream_id", "hop", "first", F.least(F.lit(HOP), F.col("_n") - F.col("first")).cast("bigint").alias("n_frames"), F.least(F.lit(CONTEXT), F.col("first")).cast("bigint").alias("context"))


def terminal(events: DataFrame) -> DataFrame:
    """One last event for each recording of (stream_id, seq, kind, message):
    ``cancelled`` if it was cancelled, else ``failed`` with the first failure's
    message, else ``finished``."""
    first = F.min(F.when(F.col("kind") == "fail", F.struct("seq", "message")))["message"]
    failed, cancelled = F.count_if(F.col("kind") == "fail") > 0, F.count_if(F.col("kind") == "cancel") > 0
    kind = F.when(cancelled, "cancelled").when(failed, "failed").otherwise("finished")
    return events.groupBy("stream_id").agg(kind.alias("kind"), F.when(~cancelled, first).alias("message"))
