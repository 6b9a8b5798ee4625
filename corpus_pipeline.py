"""A corpus pipeline in five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import mixing, near_dup, quality, secrets, sentencepiece
from inkwell.llm.common import hinted, shared_dir, table, written
from inkwell.llm.queries import DOMAIN, MIX_WEIGHTS, tokenizer_path

#: Share of the words that reach the mixing stage and leave it, at most.
MIX_SHARE = "0.8"
#: Percent of similarity from which documents are near duplicates.
NEAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that a quality rule rejects. Rows that repeat an id are
    judged by their own texts; a null text fails."""
    counts = quality.measured(docs.select("doc_id", "lang", F.col("text").alias("_text")), "_text").drop("_text")
    cutoffs = written(quality.cutoff_table(written(counts, "quality"), table(spark, sf_dir, "labels")), "cutoffs")
    # Counting again costs less than moving the texts to join the verdicts.
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "lang", F.col("text").alias("_text"))
    kept = quality.with_rejects(quality.measured(rows, "_text").where(~quality.base_failed()), cutoffs)
    return kept.where("not _rejected").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, one with the smallest
    id. Rows are told apart by id and text: one that repeats an id with a text
    that is no copy stays, of equal rows one stays. Documents without an id
    belong to no group and stay."""
    named = docs.where("doc_id is not null")
    judged = near_dup.near_duplicates(named, threshold=NEAR).select("doc_id", "text_hash", "first")
    # A row that goes, by what its copies have in common; where one of equal
    # rows stays the others go by being repeated.
    groups = written(judged.groupBy("doc_id", "text_hash").agg(F.max("first").alias("stays"), F.count(F.lit(1)).alias("n")), "groups")
    gone = hinted(groups.where("not stays").select("doc_id", "text_hash"))
    rows = named.withColumn("_hash", F.xxhash64("text"))
    one = rows.join(gone.withColumnRenamed("text_hash", "_hash"), ["doc_id", "_hash"], "left_anti")
    if groups.where("stays and n > 1").limit(1).count():
        one = one.dropDuplicates(["doc_id", "_hash"])
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a label; all documents stay."""
    found, _ = secrets.scan_versions(docs, "doc_id", "text", rules=secrets.WHOLE)
    hits = found.where(F.size("findings") > 0).select("blob", "findings").dropDuplicates(["blob"])
    hits = hinted(written(hits, "hits"), 1 + F.size("findings"))
    joined = docs.withColumn("blob", secrets.blob_of(F.col("text"))).join(hits, "blob", "left")
    clean = F.when(F.size("findings") > 0, secrets.redact(F.col("text"), F.col("findings"))).otherwise(F.col("text"))
    out = joined.withColumn("text", clean).withColumn("n_chars", F.when(F.size("findings") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Select documents so that sources keep to their weights."""
    mix = mixing.Mix(levels=(DOMAIN, "lang", "source"), weights=MIX_WEIGHTS, share=MIX_SHARE)
    return mixing.mix_sources(docs, mix).select(*docs.columns)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    return sentencepiece.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece_ids),
]

#: The first cutoffs, the order of the mix and the ids aren't SQL's: tests
#: compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
