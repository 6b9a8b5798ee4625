"""Templates, documents, submissions and manual edits as table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions.text import trimmed

# The templates that an empty table starts with.
STARTERS = (
    ("GP letter", "Summarise care for the GP", "Write a letter using only the supplied notes. Include presentation, relevant history, progress, and next steps. Use professional British English. Do not invent missing details."),
    ("Referral letter", "Present the reason for referral", "Write a referral letter using only the supplied notes. Explain the reason for referral, relevant history, current presentation, and requested next steps. Use professional British English. Do not invent missing details."),
    ("Progress report", "Summarise progress and next steps", "Write a progress report using only the supplied notes. Summarise presentation, work completed, progress, remaining needs, and next steps. Use professional British English. Do not invent missing details."),
)
TEMPLATE = "id bigint, version bigint, name string, description string, instructions string, archived boolean, created_at bigint, updated_at bigint"


def no_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TEMPLATE)


def seed_templates(templates: DataFrame, now: int) -> DataFrame:
    """The starters where the table is empty, else the table as it is."""
    if templates.limit(1).count():
        return templates
    rows = [(i + 1, 1, n, d, t, False, now, now) for i, (n, d, t) in enumerate(STARTERS)]
    return templates.sparkSession.createDataFrame(rows, TEMPLATE)


def _next_ids(new: DataFrame, old: DataFrame, order: str) -> DataFrame:
    """Ids after the largest; new rows come from one person's edits."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    return new.withColumn("_n", F.row_number().over(Window.orderBy(order))).join(top).withColumn("id", (F.col("_top") + F.col("_n")).cast("bigint")).drop("_n", "_top")


def create_templates(templates: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Add (seq, name, description, instructions) at version 1. Without a name
    or instructions, or with over 8,000 characters of them, a row is refused."""
    clean = new.withColumns({c: trimmed(F.coalesce(c, F.lit(""))) for c in ("name", "description", "instructions")})
    ok = clean.where((F.col("name") != "") & F.length("instructions").between(1, 8000))
    added = _next_ids(ok, templates, "seq").select("id", F.lit(1).cast("bigint").alias("version"), "name", "description", "instructions", F.lit(False).alias("archived"), F.lit(now).cast("bigint").alias("created_at"), F.lit(now).cast("bigint").alias("updated_at"))
    return templates.select(added.columns).unionByName(added)


def update_templates(templates: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """New fields by id, at the next version."""
    c = changes.select("id", *[F.col(x).alias(f"_{x}") for x in ("name", "description", "instructions")], F.lit(True).alias("_hit"))
    joined = templates.join(c, "id", "left")
    pick = lambda x: F.when(F.col("_hit"), F.col(f"_{x}")).otherwise(F.col(x)).alias(x)
    return joined.select("id", (F.col("version") + F.coalesce(F.col("_hit").cast("int"), F.lit(0))).cast("bigint").alias("version"), pick("name"), pick("description"), pick("instructions"), "archived", "created_at", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("updated_at")).cast("bigint").alias("updated_at"))


def duplicate_templates(templates: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Copies named "… copy", at version 1."""
    chosen = templates.join(ids.select("id").distinct(), "id", "left_semi")
    return create_templates(templates, chosen.select(F.col("id").alias("seq"), F.concat("name", F.lit(" copy")).alias("name"), "description", "instructions"), now)


def archive_templates(templates: DataFrame, flags: DataFrame, now: int) -> DataFrame:
    """Set ``archived`` by id; the version stays."""
    joined = templates.join(flags.select("id", F.col("archived").alias("_to")), "id", "left")
    return joined.withColumn("updated_at", F.when(F.col("_to").isNotNull(), F.lit(now)).otherwise(F.col("updated_at")).cast("bigint")).withColumn("archived", F.coalesce("_to", "archived")).select(*templates.columns)


def save_documents(documents: DataFrame, edits: DataFrame, profile: Column, signature: Column, now: int) -> DataFrame:
    """Apply (document_id, title, text, reviewed, include_signature): revision +
    1; an id that isn't there is a new document at revision 1. A reviewed
    document takes snapshots of the profile, and of the signature where that is
    included; one that isn't keeps what it had. A text with a token left can't
    be reviewed: such an edit is refused."""
    from inkwell.operators.generation import may_be_reviewed

    usable = edits.where(~F.col("reviewed") | may_be_reviewed(F.col("text")))
    e = usable.select("document_id", *[F.col(c).alias(f"_{c}") for c in ("title", "text", "reviewed", "include_signature")], F.lit(True).alias("_hit"))
    j = documents.join(e, "document_id", "full_outer")
    hit = F.coalesce("_hit", F.lit(False))
    done = hit & F.coalesce("_reviewed", F.lit(False))
    take = lambda c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return j.select(
        "document_id", take("title"), take("text"), (F.coalesce("revision", F.lit(0)) + hit.cast("int")).cast("bigint").alias("revision"), take("reviewed"), take("include_signature"),
        F.when(done, profile).otherwise(F.col("clinician_snapshot")).alias("clinician_snapshot"),
        F.when(done & F.col("_include_signature"), signature).when(done, F.lit(None)).otherwise(F.col("signature_snapshot")).alias("signature_snapshot"),
        F.when(hit, F.lit(now)).otherwise(F.col("updated_at")).cast("bigint").alias("updated_at"),
    )


def rewrite_sources(bridge: DataFrame, saved: DataFrame, sources: DataFrame, notes: DataFrame) -> DataFrame:
    """The bridge (document_id, doc_id, deleted_warning) after documents were
    ``saved`` (document_id): their rows are replaced by those of ``sources``
    (document_id, doc_id), each once; a note that is gone leaves a row without
    an id and with the warning."""
    ids = saved.select("document_id").distinct()
    kept = bridge.join(ids, "document_id", "left_anti")
    live = notes.select("doc_id", F.lit(True).alias("_live"))
    named = sources.join(ids, "document_id", "left_semi").select("document_id", "doc_id").distinct().join(live, "doc_id", "left")
    fresh = named.select("document_id", F.when(F.col("_live"), F.col("doc_id")).alias("doc_id"), F.col("_live").isNull().alias("deleted_warning"))
    return kept.select("document_id", "doc_id", "deleted_warning").unionByName(fresh)


def update_replacements(mappings: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """New replacements by id; labels that aren't valid change nothing."""
    from inkwell.operators.review import valid_label

    good = changes.where(valid_label(F.col("replacement")) & (F.length("replacement") <= 46))
    c = good.select("id", F.col("replacement").alias("_new"))
    joined = mappings.join(c, "id", "left")
    return joined.withColumn("replacement", F.coalesce("_new", "replacement")).withColumn("updated_at", F.when(F.col("_new").isNotNull(), F.lit(now)).otherwise(F.col("updated_at")).cast("bigint")).select(*mappings.columns)


def gates(requests: DataFrame, request_notes: DataFrame, notes: DataFrame, templates: DataFrame, models: DataFrame, sending_enabled: bool = True, has_key: bool = True) -> DataFrame:
    """Why each request can't be prepared, in the order that it is checked;
    null where it can: sending, key, model, template, its notes (of that
    patient, one at least)."""
    owned = request_notes.join(notes.select("doc_id", F.col("patient_id").alias("_owner")), "doc_id", "left").join(requests.select("request_id", "patient_id"), "request_id")
    per = owned.groupBy("request_id").agg(F.min(F.coalesce(F.col("_owner") == F.col("patient_id"), F.lit(False))).alias("_own"))
    t = templates.select(F.col("id").alias("template_id"), F.col("archived").alias("_archived"))
    m = models.select("model", F.lit(True).alias("_model"))
    j = requests.join(per, "request_id", "left").join(t, "template_id", "left").join(m, "model", "left")
    why = (
        F.when(F.lit(not sending_enabled), "sending").when(F.lit(not has_key), "key").when(F.col("_model").isNull(), "model")
        .when(F.coalesce("_archived", F.lit(True)), "template").when(~F.coalesce("_own", F.lit(False)), "notes")
    )
    return j.select("request_id", why.alias("refused"))


def consume(submissions: DataFrame, requests: DataFrame) -> DataFrame:
    """One-shot use of usable submissions: of several requests for one, the
    first by ``seq`` gets it; ``granted`` says which."""
    usable = submissions.where("usable").select("preparation_id", F.lit(True).alias("_usable"))
    first = F.row_number().over(Window.partitionBy("preparation_id").orderBy("seq"))
    joined = requests.withColumn("_n", first).join(usable, "preparation_id", "left")
    return joined.withColumn("granted", F.coalesce("_usable", F.lit(False)) & (F.col("_n") == 1)).drop("_n", "_usable")


def append_audit(outcomes: DataFrame, folder: str, key: str) -> None:
    """Outcomes of submissions are only ever added; a retried job writes its
    ``key``'s rows over those of its first try."""
    outcomes.write.mode("overwrite").parquet(f"{folder}/job={key}")


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """One row by its key; the condition reaches the scan."""
    return table.where(F.col(key) == value)


def original_of(originals: DataFrame, doc_id: int, content: bool = False) -> DataFrame:
    """Metadata of a note's original; its bytes are read only when asked for."""
    own = lookup(originals, "doc_id", doc_id)
    return own if content else own.drop("bytes")


def code_point_of(text: Column, unit: Column) -> Column:
    """Code-point offset of a UTF-16 offset; null inside a surrogate pair or
    outside the text. Bisection is not needed: the text before ``unit`` code
    units is found through its encoded prefix."""
    encoded = F.encode(text, "UTF-16BE")
    inside = (unit >= 0) & (unit * 2 <= F.octet_length(encoded))
    prefix = F.substring(encoded, F.lit(1), (unit * 2).cast("int"))
    # A prefix that ends with the first half of a pair has D8 to DB there.
    last = F.conv(F.hex(F.substring(prefix, (unit * 2 - 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    half = (unit > 0) & last.between(0xD8, 0xDB)
    return F.when(inside & ~half, F.when(unit == 0, 0).otherwise(F.length(F.decode(prefix, "UTF-16BE"))))


def manual_evidence(selections: DataFrame, notes: DataFrame, text: str = "text") -> DataFrame:
    """Evidence of selections (doc_id, seq, start_utf16, end_utf16). One that
    splits a character, is empty or lies outside is refused."""
    j = selections.join(notes.select("doc_id", F.col(text).alias("_text")), "doc_id")
    j = j.withColumn("start", code_point_of(F.col("_text"), F.col("start_utf16"))).withColumn("end", code_point_of(F.col("_text"), F.col("end_utf16")))
    ok = j.where("start is not null and end is not null and start < end")
    return ok.select("doc_id", F.col("seq").cast("bigint").alias("seq"), F.lit("MANUAL").alias("category"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(1.0).alias("confidence"), F.lit("manual").alias("stage"))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (b_end <= a_end)


def valid_span(start: Column, end: Column, text: Column) -> Column:
    return (start >= 0) & (start < end) & (end <= F.length(text))
