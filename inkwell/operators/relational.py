"""The note library as tables: listings, counts, filters, cascades, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def optional(column: str, value) -> Column:
    """Equality when a value is given, else no condition."""
    return F.lit(True) if value is None else F.col(column) == value


def in_period(column: str, start: int, until: int) -> Column:
    """Half-open; a period that is negative or empty is refused."""
    if start < 0 or start >= until:
        raise ValueError("the period is not valid")
    return (F.col(column) >= start) & (F.col(column) < until)


def contains_text(query: str, *columns: str) -> Column:
    """Whether a query occurs in the columns' texts, whatever the case."""
    whole = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.lower(whole).contains(query.strip().lower())


def nocase(column: str) -> Column:
    """Sort key that folds A-Z only."""
    return F.translate(F.col(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def note_listing(notes: DataFrame, patients: DataFrame, originals: DataFrame, patient_id: int | None = None) -> DataFrame:
    """Notes, newest id first, with the live patient reference, the first 180
    characters and the original's name."""
    n = notes.where(optional("patient_id", patient_id))
    p = patients.select("patient_id", F.col("patient_reference").alias("_live"), F.col("name").alias("patient_name"))
    o = originals.select("doc_id", F.col("name").alias("document_name"), "format")
    out = n.join(p, "patient_id", "left").join(o, "doc_id", "left")
    return out.select("doc_id", "title", F.coalesce("_live", "patient_reference").alias("patient_reference"), "patient_name", F.substring("text", 1, 180).alias("preview"), "document_name", "format", "created_at").orderBy(F.desc("doc_id"))


def patient_counts(patients: DataFrame, notes: DataFrame, mappings: DataFrame, documents: DataFrame) -> DataFrame:
    """Patients with how many notes, mappings and materialised documents each has."""
    out = patients
    for name, child in (("n_notes", notes), ("n_mappings", mappings), ("n_documents", documents.where("materialized"))):
        out = out.join(child.groupBy("patient_id").agg(F.count(F.lit(1)).alias(name)), "patient_id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))
    return out.select("patient_id", "name", "patient_reference", "n_notes", "n_mappings", "n_documents").orderBy("patient_id")


def document_library(documents: DataFrame, patients: DataFrame, usage: DataFrame) -> DataFrame:
    """Materialised documents with their patients and usage, newest first; the
    usage of all of them comes from one grouped pass."""
    totals = usage.groupBy("document_id").agg(F.count(F.lit(1)).alias("attempts"), F.coalesce(F.sum("cost_nanos"), F.lit(0)).alias("known_nanos"), F.count_if(F.col("cost_nanos").isNull()).alias("unknown"))
    out = documents.where("materialized").join(patients.select("patient_id", "name"), "patient_id").join(totals, "document_id", "left")
    return out.select("document_id", "title", "name", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("known_nanos", F.lit(0)).alias("known_nanos"), F.coalesce("unknown", F.lit(0)).alias("unknown"), "updated_at").orderBy(F.desc("updated_at"), F.desc("document_id"))


def template_listing(templates: DataFrame, archived: bool = False) -> DataFrame:
    """Templates by archive flag, then name without regard to ASCII case."""
    shown = templates if archived else templates.where(~F.col("archived"))
    return shown.orderBy("archived", nocase("name"), "id")


def delete_notes(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the notes of ``gone`` (doc_id): originals and index
    rows go too, sources of documents are detached with a warning, and
    preparations that used one are dropped."""
    ids = gone.select("doc_id").distinct()
    out = dict(tables)
    for name in ("notes", "originals", "postings"):
        if name in out:
            out[name] = out[name].join(ids, "doc_id", "left_anti")
    if "document_sources" in out:
        marked = out["document_sources"].join(ids.withColumn("_gone", F.lit(True)), "doc_id", "left")
        out["document_sources"] = marked.select("document_id", F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("doc_id")).alias("doc_id"), (F.coalesce("_gone", F.lit(False)) | F.col("deleted_warning")).alias("deleted_warning"))
    if "preparations" in out:
        used = tables["preparation_sources"].join(ids, "doc_id", "left_semi").select("preparation_id").distinct()
        out["preparations"] = out["preparations"].join(used, "preparation_id", "left_anti")
    return out


def delete_patients(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Cascade from patients: mappings, documents and notes with all that is theirs."""
    ids = gone.select("patient_id").distinct()
    lost = tables["notes"].join(ids, "patient_id", "left_semi").select("doc_id")
    out = delete_notes(tables, lost)
    for name in ("patients", "notes", "patient_mappings", "documents"):
        if name in out:
            out[name] = out[name].join(ids, "patient_id", "left_anti")
    if "document_sources" in out and "documents" in out:
        out["document_sources"] = out["document_sources"].join(out["documents"].select("document_id"), "document_id", "left_semi")
    if "usage_reports" in out and "documents" in out:
        out["usage_reports"] = detach_reports(out["usage_reports"], tables["documents"].join(ids, "patient_id", "left_semi"))
    return out


def detach_reports(reports: DataFrame, gone_documents: DataFrame) -> DataFrame:
    """Usage reports stay when their documents go; the link becomes null."""
    ids = gone_documents.select("document_id").distinct().withColumn("_gone", F.lit(True))
    joined = reports.join(ids, "document_id", "left")
    return joined.select(*[F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(c)).alias(c) if c == "document_id" else F.col(c) for c in reports.columns])


def merge_notes(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert new notes at revision 1 and update known ones at revision + 1;
    columns that a change leaves null stay as they were."""
    new = changes.select("doc_id", *[F.col(c).alias(f"_{c}") for c in old.columns if c in changes.columns and c != "doc_id"], F.lit(True).alias("_changed"))
    joined = old.join(new, "doc_id", "full_outer")
    cols = []
    for c in old.columns:
        if c == "doc_id":
            cols.append(F.col(c))
        elif c == "revision":
            cols.append(F.when(F.col(c).isNull(), 1).when(F.col("_changed"), F.col(c) + 1).otherwise(F.col(c)).cast("bigint").alias(c))
        else:
            cols.append((F.coalesce(f"_{c}", c) if f"_{c}" in new.columns else F.col(c)).alias(c))
    return joined.select(*cols)


def create_patients(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicts): a normalised name must be new, and of equal new
    ones the first by id is taken."""
    named = new.withColumn("normalized_name", normalised_name("name"))
    ranked = named.withColumn("_n", F.row_number().over(Window.partitionBy("normalized_name").orderBy("patient_id")))
    known = old.select("normalized_name").distinct().withColumn("_known", F.lit(True))
    checked = ranked.join(known, "normalized_name", "left").withColumn("_ok", F.col("_known").isNull() & (F.col("_n") == 1) & (F.col("normalized_name") != ""))
    return tuple(checked.where(F.col("_ok") == ok).drop("_n", "_known", "_ok") for ok in (True, False))


def normalised_name(name: str) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def update_patients(old: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patients, conflicts) after renaming by (patient_id, name,
    patient_reference). A name that another patient has, or gets in the same
    call from a smaller id, is a conflict; an id that isn't there changes
    nothing. Notes and documents stay attached through the id."""
    new = changes.select("patient_id", F.col("name").alias("_name"), F.col("patient_reference").alias("_ref"), normalised_name("name").alias("_norm"))
    asked = new.join(old.select("patient_id"), "patient_id", "left_semi")
    holders = old.select(F.col("normalized_name").alias("_norm"), F.col("patient_id").alias("_owner")).groupBy("_norm").agg(F.min("_owner").alias("_owner"))
    ranked = asked.withColumn("_n", F.row_number().over(Window.partitionBy("_norm").orderBy("patient_id"))).join(holders, "_norm", "left")
    checked = ranked.withColumn("_ok", (F.col("_norm") != "") & (F.col("_n") == 1) & F.coalesce(F.col("_owner") == F.col("patient_id"), F.lit(True)))
    joined = old.join(checked.where("_ok").select("patient_id", "_name", "_ref", "_norm"), "patient_id", "left")
    hit = F.col("_norm").isNotNull()
    put = {"name": "_name", "normalized_name": "_norm", "patient_reference": "_ref"}
    now = joined.select(*[F.when(hit, F.col(put[c])).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in old.columns])
    return now, checked.where(~F.col("_ok")).select("patient_id", F.col("_name").alias("name"))


def patient_listing(patients: DataFrame) -> DataFrame:
    return patients.orderBy("normalized_name")


def insert_notes(tables: dict[str, DataFrame], new: DataFrame, originals: DataFrame | None = None) -> dict[str, DataFrame]:
    """``notes``, ``postings`` and ``originals`` after saving ``new`` notes: all
    of a note comes in or nothing. A note of a patient who isn't there is left
    out with its original and its index rows; one without a reference takes the
    patient's. Write the tables that come back as one version."""
    from inkwell.operators.search import postings

    known = tables["patients"].select("patient_id", F.col("patient_reference").alias("_ref"))
    ok = new.join(known, "patient_id").withColumn("patient_reference", F.coalesce("patient_reference", "_ref")).drop("_ref")
    out = dict(tables)
    out["notes"] = tables["notes"].unionByName(ok.select(*tables["notes"].columns))
    out["postings"] = tables["postings"].unionByName(postings(ok))
    if originals is not None:
        out["originals"] = tables["originals"].unionByName(originals.join(ok.select("doc_id"), "doc_id", "left_semi").select(*tables["originals"].columns))
    return out


def latest(notes: DataFrame, keys: tuple[str, ...] = ("patient_id",), n: int = 1) -> DataFrame:
    """The last n notes of each key by (created_at, id)."""
    order = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("doc_id"))
    return notes.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def governed(settings: DataFrame) -> DataFrame:
    """Sending is enabled when all confirmations are given and the model that
    they were given for is still the one in use."""
    ok = F.forall("confirmations", lambda c: F.coalesce(c, F.lit(False))) & (F.size("confirmations") > 0)
    return settings.withColumn("sending_enabled", F.coalesce(ok & (F.col("model") == F.col("confirmed_model")), F.lit(False)))


def commit_version(df: DataFrame, folder: str, version: int) -> str:
    """Write a table version beside the others; a version that is there already
    is not touched. Readers take the largest with a _SUCCESS mark."""
    path = f"{folder.rstrip('/')}/v{version:09d}"
    df.write.mode("errorifexists").parquet(path)
    return path
