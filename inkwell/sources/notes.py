"""Notes and reference tables, derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_CHARS = 100_000
_LETTERS = "GB,NK,AB,CE,ZY,SP"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("patient_id"), F.col("c_name").alias("name"), F.lower("c_name").alias("normalized_name"), F.concat(F.lit("SYN-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("patient_reference"), F.col("c_nationkey").alias("nation"))


def notes(spark: SparkSession, sf_dir: str, named: bool = False) -> DataFrame:
    """One note for each order, with every kind of identifier in its text.

    Some numbers pass their checks and some don't, by the order's key.
    ``named`` adds the patient's name.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    p = patients(spark, sf_dir).select("patient_id", "name", "patient_reference")
    k = F.col("o_orderkey")
    nine = F.expr("(o_orderkey * 7919 + 123456789) % 1000000000")
    text9 = F.lpad(nine.cast("string"), 9, "0")
    digit = lambda i: F.substring(text9, i + 1, 1).cast("int")
    check = (11 - sum((digit(i) * (10 - i) for i in range(9)), F.lit(0)) % 11) % 11
    last = F.when((k % 2 == 0) & (check < 10), check).otherwise((k % 10).cast("int"))
    nhs = F.concat(text9, last.cast("string"))
    prefix = F.get(F.split(F.lit(_LETTERS), ","), (k % 6).cast("int"))
    text = F.concat(
        F.lit("Patient ID: "), F.col("patient_reference"), F.lit(" was seen on "), F.date_format("o_orderdate", "dd/MM/yyyy"),
        F.lit(". NHS number: "), F.substring(nhs, 1, 3), F.lit(" "), F.substring(nhs, 4, 3), F.lit(" "), F.substring(nhs, 7, 4),
        F.lit(". NI number: "), prefix, F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit("C. Call +44 7700 "), F.lpad((k * 37 % 1000000).cast("string"), 6, "0"),
        F.lit(" or write to "), F.replace(F.lower("name"), F.lit("#"), F.lit(".")), F.lit("@example.invalid, see https://example.invalid/notes/"), k.cast("string"),
        F.lit(").\nSeen again 3 June 2026 at Flat 2B, "), (k % 90 + 10).cast("string"), F.lit(" Fictional Row, SW1A 1AA. "), F.col("patient_reference"), F.lit(" is stable; "),
        F.replace(F.lower("name"), F.lit("#"), F.lit(".")), F.lit("@example.invalid confirmed. No change to "), F.col("o_orderpriority"), F.lit("."),
    )
    joined = o.join(p, F.col("o_custkey") == F.col("patient_id"))
    made = joined.select(
        k.alias("doc_id"), "patient_id", F.concat(F.lit("Note "), k.cast("string")).alias("title"), "patient_reference",
        F.unix_timestamp("o_orderdate").alias("created_at"), F.lit(1).cast("bigint").alias("revision"), text.alias("text"), *["name"] * named,
    )
    # A few small files hold all orders. Dealt by id the notes keep all cores
    # busy, each text is made once, and later steps by document stay in place.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return made.repartition(parts, "doc_id")


#: The same notes in DuckDB.
NOTES_SQL = f"""
patients AS (SELECT c_custkey AS patient_id, c_name AS name, lower(c_name) AS normalized_name, 'SYN-' || lpad(c_custkey::VARCHAR, 6, '0') AS patient_reference, c_nationkey AS nation FROM customer),
notes_nine AS (SELECT o.*, p.*, lpad(((o_orderkey * 7919 + 123456789) % 1000000000)::VARCHAR, 9, '0') AS t9 FROM orders o JOIN patients p ON o_custkey = patient_id),
notes_check AS (SELECT *, (11 - ({" + ".join(f"substr(t9, {i + 1}, 1)::INT * {10 - i}" for i in range(9))}) % 11) % 11 AS chk FROM notes_nine),
notes_nhs AS (SELECT *, t9 || (CASE WHEN o_orderkey % 2 = 0 AND chk < 10 THEN chk ELSE o_orderkey % 10 END)::VARCHAR AS nhs FROM notes_check),
notes AS (SELECT o_orderkey AS doc_id, patient_id, 'Note ' || o_orderkey AS title, patient_reference, epoch(o_orderdate)::BIGINT AS created_at, 1::BIGINT AS revision,
  'Patient ID: ' || patient_reference || ' was seen on ' || strftime(o_orderdate, '%d/%m/%Y') || '. NHS number: ' || substr(nhs, 1, 3) || ' ' || substr(nhs, 4, 3) || ' ' || substr(nhs, 7, 4)
  || '. NI number: ' || string_split('{_LETTERS}', ',')[(o_orderkey % 6)::INT + 1] || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') || 'C. Call +44 7700 ' || lpad((o_orderkey * 37 % 1000000)::VARCHAR, 6, '0')
  || ' or write to ' || replace(lower(name), '#', '.') || '@example.invalid, see https://example.invalid/notes/' || o_orderkey::VARCHAR || ').' || chr(10) || 'Seen again 3 June 2026 at Flat 2B, ' || (o_orderkey % 90 + 10)::VARCHAR
  || ' Fictional Row, SW1A 1AA. ' || patient_reference || ' is stable; ' || replace(lower(name), '#', '.') || '@example.invalid confirmed. No change to ' || o_orderpriority || '.' AS text FROM notes_nhs)
"""


def source_valid(text):
    """A text that isn't blank and has at most ``MAX_CHARS`` code points."""
    return F.coalesce(F.regexp_replace(text, r"[\s\x{85}\p{Z}]+", "") != "", F.lit(False)) & (F.length(text) <= MAX_CHARS)
