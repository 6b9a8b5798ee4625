"""Exact deduplication of a growing folder of documents, by streams with state.

Texts are equal when they are identical without white space (U+0020 and U+0009
to U+000D); the row with the longest original text stays, of these one with the
smallest id.

1. A stateless stream reads each new file once and appends one fingerprint for
   each row: id, SHA-256 of the normalised text, length, and the content's
   locator (file and row in it).
2. A stateful stream over the fingerprints has the digest as its key. Its state,
   in RocksDB on disk and never expired, retains for each digest the row that
   came first with its locator (the anchor), the row that stays, and the number
   of rows. It is an aggregate that merges, so copies within one file meet
   before the shuffle and a digest with a third of all rows is no hot key.
3. Rows that hit a known digest are checked in full: their bytes and those at
   the anchor's locator are compared. The anchor never changes, so rows that
   came earlier needn't be read again. Texts that differ in spite of a common
   digest are told apart by the texts themselves.

Both streams run until all files are read and end; called again with the same
folder they take up new files only, with the state that they had.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hinted, written

_SPACE = "[\\x20\\x09-\\x0D]+"
#: State on disk, and logs of changes rather than whole snapshots at each batch.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Files grow as they are written: many small stores would each reserve megabytes.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Rows of one class that are compared with one copy of the anchor's text.
TOGETHER = 500
_PLACE = ["run", "path", "row"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, "")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


@contextmanager
def _state_on_disk(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _run(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _exists(spark: SparkSession, path: str) -> bool:
    system, at = _file_system(spark, path)
    return system.exists(at)


def _stream_path(spark: SparkSession, path: str) -> str:
    """A stream reads a folder or a pattern: one file becomes a pattern for itself."""
    system, at = _file_system(spark, path)
    return f"{path[:-1]}[{path[-1]}]" if system.exists(at) and system.getFileStatus(at).isFile() else path


FINGERPRINT = "doc_id bigint, sha string, n int, path string, row bigint, run int"


def fingerprints(spark: SparkSession, source: str, folder: str, key: str, text: str, files: int) -> tuple[DataFrame, int]:
    """(all fingerprints, number of this run) after reading what is new."""
    at = f"{folder}/fingerprints"
    run = 0
    if _exists(spark, at):
        run = 1 + (spark.read.schema(FINGERPRINT).parquet(at).agg(F.max("run")).first()[0] or 0)
    docs = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files).parquet(_stream_path(spark, source))
    rows = docs.select(
        F.col(key).cast("bigint").alias("doc_id"),
        digest(F.col(text)).alias("sha"),
        F.coalesce(F.length(text), F.lit(0)).alias("n"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.row_index").alias("row"),
        F.lit(run).alias("run"),
    )
    _run(rows.writeStream.format("parquet").option("path", at).option("checkpointLocation", f"{folder}/reading"))
    return spark.read.schema(FINGERPRINT).parquet(at), run


def classes(spark: SparkSession, folder: str, group: Callable[[Column], Column], files: int) -> DataFrame:
    """(digest, anchor, stays, size) for every digest so far, from the state."""
    rows = spark.readStream.schema(FINGERPRINT).option("maxFilesPerTrigger", files).parquet(f"{folder}/fingerprints")
    place = F.struct(*_PLACE)
    # What stays: most code points, then an id, the smallest, then the first place.
    best = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", place.alias("place"))
    state = rows.groupBy(group(F.col("sha")).alias("digest")).agg(F.min(place).alias("anchor"), F.min(best).alias("stays"), F.count(F.lit(1)).alias("size"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/classes/batch={number}")

    with _state_on_disk(spark):
        _run(state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state"))
    updates = spark.read.schema(f"{_ddl(state)}, batch int").option("basePath", f"{folder}/classes").parquet(f"{folder}/classes")
    return updates.groupBy("digest").agg(*[F.max_by(c, "batch").alias(c) for c in ("anchor", "stays", "size")])


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _texts(spark: SparkSession, source: str, text: str) -> DataFrame:
    return spark.read.parquet(source).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"), F.col(text).alias("_text"))


def mismatches(spark: SparkSession, source: str, judged: DataFrame, run: int, text: str) -> DataFrame:
    """Digests with a row, read from ``run`` on, whose text isn't the anchor's, byte by byte."""
    hits = judged.where(f"size > 1 and (run >= {run} or is_anchor)").select("path", "row", "digest", "is_anchor", F.ceil(F.col("size") / TOGETHER).alias("salts"))
    # An anchor's text goes to as many tasks as its class has rows to compare.
    texts = _texts(spark, source, text).join(hinted(hits), ["path", "row"]).withColumn("_text", normalised(F.col("_text")))
    texts = written(texts, "hits")
    anchors = texts.where("is_anchor").select("digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("_text").alias("_anchor"))
    rows = texts.where("not is_anchor").select("digest", F.pmod(F.xxhash64("path", "row"), "salts").alias("salt"), "_text")
    return rows.join(anchors, ["digest", "salt"]).where("_text != _anchor").select("digest").distinct()


def deduplicate(spark: SparkSession, source: str, folder: str, key: str = "doc_id", text: str = "text", files: int = 1000, group: Callable[[Column], Column] = lambda sha: sha) -> DataFrame:
    """One row for each row of the Parquet files at ``source``: doc_id, keep_id
    (of the row that stays), group_size, kept, text_sha256, stays (true for one
    row of each class even where an id is repeated).

    ``folder`` keeps fingerprints, state, checkpoints and the digests with
    several texts; with the same folder
    a later call reads new files only. ``group`` makes the state's key out of
    the digest, for tests of what happens on collisions. Null texts are empty,
    and equal to texts of white space only. Rows without an id take part; they
    stay only where no row with an id is as long. No rows give none.
    """
    rows, run = fingerprints(spark, source, folder, key, text, files)
    known = classes(spark, folder, group, files)
    # The state has one row for each digest; skewed digests are split by AQE.
    both = rows.withColumn("digest", group(F.col("sha"))).join(known, "digest")
    place = F.struct(*_PLACE)
    judged = both.select(*rows.columns, "digest", "size", (place == F.col("anchor")).alias("is_anchor"), F.col("stays.doc_id").alias("keep_id"), (place == F.col("stays.place")).alias("stays"))
    judged = written(judged, "judged")
    checked = f"{folder}/broken/run="
    # Also what an earlier call has read and not checked.
    since = next((r + 1 for r in range(run, -1, -1) if _exists(spark, f"{checked}{r}/_SUCCESS")), 0)
    if since <= run:
        mismatches(spark, source, judged, since, text).write.mode("overwrite").parquet(f"{checked}{run}")
    # Once told apart, always told apart.
    broken = spark.read.schema("digest string").parquet(f"{checked}*").distinct()
    if broken.limit(1).count():
        judged = _told_apart(spark, source, judged, broken, text)
    return judged.select("doc_id", "keep_id", F.col("size").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("keep_id"), "stays").alias("kept"), F.col("sha").alias("text_sha256"), "stays")


def _told_apart(spark: SparkSession, source: str, judged: DataFrame, broken: DataFrame, text: str) -> DataFrame:
    """``judged`` with the rows of broken digests grouped by their whole texts."""
    rows = written(judged.join(broken, "digest"), "told")
    texts = _texts(spark, source, text).join(rows.select("path", "row", "doc_id", "n", "run"), ["path", "row"]).withColumn("_text", normalised(F.col("_text")))
    place = F.struct(*_PLACE)
    best = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", place.alias("place"))
    groups = texts.groupBy("_text").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("size"))
    own = texts.select("path", "row", "_text", place.alias("place")).join(groups, "_text").select("path", "row", "size", F.col("best.doc_id").alias("keep_id"), (F.col("place") == F.col("best.place")).alias("stays"))
    again = rows.drop("size", "keep_id", "stays").join(own, ["path", "row"]).select(*judged.columns)
    return judged.join(broken, "digest", "left_anti").select(*judged.columns).unionByName(again)
