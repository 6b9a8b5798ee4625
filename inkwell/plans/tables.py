"""Stand-ins for the note library's tables, from the relational test tables.

Each is built twice, as a DataFrame and as a common table expression of the
SQL that checks it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions.pricing import MODELS, cost_nanos, models
from inkwell.sources import notes as N

MAPPINGS = ((1, "Fictional Row", "LOCATION", "[STREET]"), (2, "no change", "MISC", "[SAME]"), (3, "SYN-000007", "CASE_REFERENCE", "[GLOBAL_REF]"), (4, "3-medium", "MISC", "[PRIORITY]"))


def mappings(spark: SparkSession) -> DataFrame:
    rows = [(i, p, p.lower(), c, r, 0, 0) for i, p, c, r in MAPPINGS]
    return spark.createDataFrame(rows, "id bigint, phrase string, normalized_phrase string, category string, replacement string, created_at bigint, updated_at bigint")


MAPPINGS_SQL = "mappings AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{p}', '{p.lower()}', '{c}', '{r}', 0::BIGINT, 0::BIGINT)" for i, p, c, r in MAPPINGS) + ") AS t(id, phrase, normalized_phrase, category, replacement, created_at, updated_at))"


def patient_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third patient's own reference as a saved phrase."""
    p = N.patients(spark, sf_dir).where("patient_id % 3 = 1")
    ref = F.col("patient_reference")
    return p.select("patient_id", F.col("patient_id").alias("id"), ref.alias("phrase"), F.lower(ref).alias("normalized_phrase"), F.lit("CASE_REFERENCE").alias("category"), F.lit("[CLIENT]").alias("replacement"))


PATIENT_MAPPINGS_SQL = "patient_mappings AS (SELECT patient_id, patient_id AS id, patient_reference AS phrase, lower(patient_reference) AS normalized_phrase, 'CASE_REFERENCE' AS category, '[CLIENT]' AS replacement FROM patients WHERE patient_id % 3 = 1)"


def originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = N.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("original-"), F.col("o_orderkey").cast("string"), F.lit(".txt")).alias("name"), F.lit("txt").alias("format"))


ORIGINALS_SQL = "originals AS (SELECT o_orderkey AS doc_id, 'original-' || o_orderkey || '.txt' AS name, 'txt' AS format FROM orders WHERE o_orderkey % 3 = 0)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = N.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("patient_id"), F.col("o_orderpriority").alias("title"), (F.col("o_orderstatus") != "P").alias("materialized"), F.unix_timestamp("o_orderdate").alias("updated_at"))


DOCUMENTS_SQL = "patient_documents AS (SELECT o_orderkey AS document_id, o_custkey AS patient_id, o_orderpriority AS title, o_orderstatus <> 'P' AS materialized, epoch(o_orderdate)::BIGINT AS updated_at FROM orders)"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = N.table(spark, sf_dir, "orders")
    done = F.when(F.col("o_orderstatus") == "F", F.unix_timestamp("o_orderdate"))
    return o.select(F.col("o_orderkey").alias("report_id"), F.col("o_orderkey").alias("document_id"), done.alias("first_completed_at"))


REPORTS_SQL = "usage_reports AS (SELECT o_orderkey AS report_id, o_orderkey AS document_id, CASE WHEN o_orderstatus = 'F' THEN epoch(o_orderdate)::BIGINT END AS first_completed_at FROM orders)"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation attempts with counts of tokens; unknown costs are null."""
    x = N.table(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(m[0]) for m in MODELS])
    rows = x.select(
        F.col("l_orderkey").alias("document_id"), ((F.col("l_orderkey") * 1000000 + F.col("l_partkey")) * 10 + F.col("l_linenumber")).alias("attempt_id"),
        F.unix_timestamp("l_shipdate").alias("attempted_at"), F.get(names, (F.col("l_partkey") % 7).cast("int")).alias("model"),
        (F.floor("l_extendedprice") * 3).cast("bigint").alias("input_tokens"), F.expr("cast(floor(l_extendedprice) * 3 * l_linenumber div 5 as bigint)").alias("cached_tokens"),
        (F.floor("l_quantity") * 100).cast("bigint").alias("output_tokens"), F.col("l_linestatus").alias("status"),
    )
    priced = rows.join(F.broadcast(models(spark)), "model")
    cost = cost_nanos(F.col("input_tokens"), F.col("cached_tokens"), F.col("output_tokens"))
    return priced.select("document_id", "attempt_id", "attempted_at", "model", "input_tokens", "cached_tokens", "output_tokens", cost.alias("priced_nanos"), F.when(F.col("status") != "F", cost).alias("cost_nanos"))


_COST = """CASE WHEN cached_tokens <= input_tokens AND input_tokens <= 2000000 AND output_tokens <= 100000 THEN
  (input_tokens - cached_tokens) * input_nanos * (CASE WHEN long_context AND input_tokens > 272000 THEN 2 ELSE 1 END)
  + cached_tokens * cached_nanos * (CASE WHEN long_context AND input_tokens > 272000 THEN 2 ELSE 1 END)
  + output_tokens * (CASE WHEN long_context AND input_tokens > 272000 THEN output_nanos * 3 // 2 ELSE output_nanos END) END"""
MODELS_SQL = "models AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{n}', {i}::BIGINT, {c}::BIGINT, {o}::BIGINT, {str(long).upper()}, {repr(e) if e else 'NULL'})" for m, n, i, c, o, long, e in MODELS) + ") AS t(model, model_name, input_nanos, cached_nanos, output_nanos, long_context, effort))"
ATTEMPTS_SQL = f"""{MODELS_SQL},
attempt_rows AS (SELECT l_orderkey AS document_id, (l_orderkey * 1000000 + l_partkey) * 10 + l_linenumber AS attempt_id, epoch(l_shipdate)::BIGINT AS attempted_at,
  [{", ".join(f"'{m[0]}'" for m in MODELS)}][(l_partkey % 7)::INT + 1] AS model, floor(l_extendedprice)::BIGINT * 3 AS input_tokens,
  floor(l_extendedprice)::BIGINT * 3 * l_linenumber // 5 AS cached_tokens, floor(l_quantity)::BIGINT * 100 AS output_tokens, l_linestatus AS status FROM lineitem),
attempts AS (SELECT document_id, attempt_id, attempted_at, model, input_tokens, cached_tokens, output_tokens, {_COST} AS priced_nanos, CASE WHEN status <> 'F' THEN {_COST} END AS cost_nanos FROM attempt_rows JOIN models USING (model))"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search corpus: documents with their source as title."""
    return N.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("patient_reference"), "text")


CORPUS_SQL = r"""corpus AS (SELECT doc_id, source AS title, lang AS patient_reference, text FROM documents),
tokenised AS (SELECT doc_id, [regexp_extract_all(lower(strip_accents(title)), '[\p{L}\p{N}]+'), regexp_extract_all(lower(strip_accents(patient_reference)), '[\p{L}\p{N}]+'), regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')] AS cols FROM corpus),
sizes AS (SELECT doc_id, (len(cols[1]) + len(cols[2]) + len(cols[3]))::BIGINT AS tokens FROM tokenised),
postings AS (SELECT doc_id, c AS col, unnest(cols[c]) AS term, unnest(range(len(cols[c]))) AS pos FROM tokenised, range(1, 4) r(c))"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.table(spark, sf_dir, "conversations")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech probabilities: the events of one user in seven are a recording."""
    stream = (F.col("user_id") % 7).alias("stream_id")
    e = N.table(spark, sf_dir, "events").withColumn("stream_id", stream)
    n = F.row_number().over(Window.partitionBy("stream_id").orderBy("ts", "event_id")) - 1
    return e.select("stream_id", n.cast("bigint").alias("frame_no"), F.least(F.col("value") / 40, F.lit(1.0)).alias("probability"))
