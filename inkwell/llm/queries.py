"""The queries, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import literal_table, shared_dir, table, written

# The rules of the URL query.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

DOMAIN = "CASE WHEN TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) < 10 THEN 'web' ELSE 'reference' END"
MIX_WEIGHTS = {("web",): "6", ("reference",): "4", **{(d, lang): w for d in ("web", "reference") for lang, w in (("en", "4"), ("de", "2"), ("fr", "2"), ("es", "2"))}}


def tokenizer_path(name: str) -> str:
    """Where an installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _base(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(*kinds))


def _number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    # The documents go through the ledger twice, as two runs would take them:
    # the second scans nothing and has all findings from the ledger.
    documents, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/ledger"
    _, fresh = secrets.scan_versions(documents, "doc_id", "text")
    secrets.append_ledger(fresh, folder)
    found, _ = secrets.scan_versions(documents, "doc_id", "text", spark.read.schema(fresh.schema).parquet(folder))
    kinds = tuple(r.kind for r in secrets.BASE)
    base = _base(F.col("findings"), kinds)
    return found.select("doc_id", *[_number(F.col("findings"), k) for k in kinds], F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("findings")).alias("spans"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dup

    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sentencepiece

    return sentencepiece.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files

    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    judged = quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    kinds = tuple(k.name for k in pii.BASE)
    return found.select("doc_id", *[_number(F.col("spans"), k) for k in kinds], F.sha2(pii.joined(_base(F.col("spans"), kinds)), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    rules = literal_table(spark, URL_RULES, url_filter.RULES_SCHEMA)
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def source_mix():
    from . import mixing

    return mixing.Mix(levels=(DOMAIN, "lang", "source"), weights=MIX_WEIGHTS, share="0.5", max_epochs=2)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix_sources(table(spark, sf_dir, "documents"), source_mix()).select("doc_id", "epoch", "leaf", "n_tokens")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import alignment

    return alignment.link_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def value_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, grp, batch, x) of clicks and sale lines. Rows that repeat a
    click_id are equal but for their time of arrival; if not, each column's
    greatest value counts. A null vendor is in batch 0; money that is no finite
    number has no x."""
    clicks = table(spark, sf_dir, "clicks").groupBy("click_id").agg(F.max("client_id").alias("client_id"), F.max("value").alias("money"))
    value = clicks.select(F.lit("value").alias("stream"), F.col("client_id").cast("string").alias("grp"), F.col("click_id").alias("id"), "money", F.lit(1).cast("long").alias("c"))
    # Lines are counted before the join, so that a hot item is a row for each vendor.
    lines = table(spark, sf_dir, "sale_lines").where("item_id is not null").groupBy("item_id", "vendor_id").agg(F.count(F.lit(1)).alias("c"))
    items = table(spark, sf_dir, "items").where("item_id is not null").select("item_id", "brand", "price")
    price = lines.join(items.hint("shuffle_hash"), "item_id").select(F.lit("price").alias("stream"), F.col("brand").alias("grp"), F.col("vendor_id").alias("id"), F.col("price").alias("money"), "c")
    rows = value.unionByName(price).where("grp is not null and money > double('-Infinity') and money < double('Infinity')")
    batch = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(16)), F.lit(0)).cast("int")
    return rows.select("stream", "grp", batch.alias("batch"), F.expr("cast(floor(100 * money + 0.5) as bigint)").alias("x"), "c").withColumn("x", F.col("x") + 1000 * F.col("batch"))


def op12_quantile_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quantiles

    own, whole = ["stream", "grp", "batch"], ["stream", "grp"]
    cells = written(quantiles.counted(value_streams(spark, sf_dir), own, count="c"), "cells")
    parts = quantiles.summarise(quantiles.blocks_of(cells, own), own)
    merged = quantiles.merge(parts.drop("batch"), whole)
    # Summaries answer first. What a batch's says was counted; for the merged
    # ones a pass over the rows counts what is exact.
    of_parts = quantiles.exact_of_points(quantiles.answers(parts, own, 20, 20), own)
    all_cells = written(quantiles.counted(cells, whole, count="c"), "cells")
    of_whole = quantiles.with_exact(quantiles.answers(merged, whole, 20, 20), quantiles.blocks_of(all_cells, whole), whole, 20)
    found = of_parts.unionByName(of_whole.withColumn("batch", F.lit(-1))).withColumn("i", F.col("i").cast("int"))
    error = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    found = found.withColumn("rank_error", error).withColumn("within", F.col("rank_error") * 1000 <= F.col("n") * 10)
    return found.select("stream", "grp", "batch", "i", "n", "target", "exact_x", F.col("kept").alias("points"), "answer", "n_below", "n_upto", "rank_error", "within")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import exact_dedup

    found = exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet", f"{shared_dir(spark)}/exact")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secret_scan, op2_near_duplicates, op3_license_scan, op4_sentencepiece, op5_token_files, op6_topk_search, op7_quality_rules, op8_personal_data, op9_url_filter, op10_source_mixing, op11_token_alignment, op12_quantile_summaries, op13_exact_dedup)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from .oracles import oracles

    return oracles(URL_RULES, source_mix())
