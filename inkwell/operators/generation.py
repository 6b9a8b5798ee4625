"""Payloads of reviewed notes: tokens, digest, restoration, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.spans import let
from inkwell.operators.review import spliced

# The token's marks, its longest offset, the payload's limit.
OPEN, CLOSE, REACH, MAX_BYTES = "⟪CV_", "⟫", 96, 512 * 1024
#: The column that tells submissions apart, in every table here.
KEY = "preparation_id"


def eligible(value: Column) -> Column:
    """A placeholder that may be replaced by a token."""
    return F.coalesce(value.rlike(r"^\[[A-Z0-9_]+\]$") & F.octet_length(value).between(3, 66), F.lit(False))


def token_items(items: DataFrame, ordinals: DataFrame) -> DataFrame:
    """Tokens of each submission's eligible items: numbered against the text's
    direction within a note, and on across the submission's notes
    (``ordinals``: preparation_id, doc_id, ordinal).

    A submission is a person's choice of notes and limited in bytes, so the
    window over its items is small, however many submissions there are.
    """
    own = items.drop("number").where(eligible(F.col("replacement"))).join(ordinals, "doc_id")
    number = F.row_number().over(Window.partitionBy(KEY).orderBy("ordinal", F.desc("output_start")))
    digits = F.col("number").cast("string")
    token = F.concat(F.lit(OPEN), F.col(KEY), F.lit("_"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits), F.lit(CLOSE))
    return own.withColumn("number", number).withColumn("token", token)


def token_lists(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``token_items`` of notes' own rows (preparation_id, doc_id, ``output``, and
    ``items``, what leaves a note by position), as an array ``tokens`` by
    position, with ``ordinal``, the place of a note in its submission by
    ``order``, and ``known``, the map from all tokens of the submission to the
    originals. Notes are moved once, to their submission."""
    own = F.filter("items", lambda x: eligible(x["replacement"]))
    by = Window.partitionBy(KEY)
    before = F.coalesce(F.sum(F.size("_own")).over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    numbered = rows.withColumn("_own", own).drop("items").withColumn("ordinal", F.row_number().over(by.orderBy(*order))).withColumn("_before", before)

    def token(x: Column, i: Column) -> Column:
        # Against the text's direction: the last of a note comes first.
        number = F.col("_before") + F.size("_own") - i
        digits = number.cast("string")
        name = F.concat(F.lit(OPEN), F.col(KEY), F.lit("_"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits), F.lit(CLOSE))
        return F.struct(x["output_start"].cast("int").alias("start"), x["output_end"].cast("int").alias("end"), name.alias("token"), x["item"].alias("item"), number.alias("number"), x["phrase"].alias("phrase"))

    named = numbered.withColumn("tokens", F.transform("_own", token)).drop("_own", "_before")
    return named.withColumn("known", F.map_from_entries(F.flatten(F.collect_list(F.transform("tokens", lambda x: F.struct(x["token"], x["phrase"]))).over(by))))


def tokenised(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rendered texts (preparation_id, doc_id, output) with their tokens in place."""
    piece = F.struct(F.col("output_start").cast("int").alias("start"), F.col("output_end").cast("int").alias("end"), "token")
    by = tokens.groupBy(KEY, "doc_id").agg(F.sort_array(F.collect_list(piece)).alias("_p"))
    joined = texts.join(by, [KEY, "doc_id"], "left").withColumn("_p", F.coalesce("_p", F.array().cast("array<struct<start:int,end:int,token:string>>")))
    return joined.select(KEY, "doc_id", spliced(F.col("output"), F.col("_p"), lambda x: x["token"]).alias("prepared"))


def assemble(prepared: DataFrame, ordinals: DataFrame) -> DataFrame:
    """A row for each submission: its notes' blocks in order, and whether they fit the limit."""
    return assembled(prepared.join(ordinals, [KEY, "doc_id"]))


def assembled(prepared: DataFrame) -> DataFrame:
    """``assemble`` of texts that have their ordinals."""
    block = F.concat(F.lit('<reviewed-note index="'), F.col("ordinal").cast("string"), F.lit('">\n'), F.col("prepared"), F.lit("\n</reviewed-note>"))
    rows = prepared.select(KEY, "ordinal", block.alias("block"))
    joined = rows.groupBy(KEY).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "block"))), lambda x: x["block"]), "\n\n").alias("input"))
    return joined.withColumn("fits", F.octet_length("input") <= MAX_BYTES)


def digest(*parts: Column) -> Column:
    """SHA-256 over every part behind its length in eight bytes."""
    framed = [x for p in parts for x in (F.unhex(F.lpad(F.hex(F.octet_length(p).cast("bigint")), 16, "0")), F.encode(p, "UTF-8"))]
    return F.sha2(F.concat(*framed), 256)


def with_known(responses: DataFrame, tokens: DataFrame) -> DataFrame:
    """``responses`` with ``tokens``, the map from all tokens of their
    submission (``preparation_id``) to the originals."""
    known = tokens.groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("token", "phrase"))).alias("tokens"))
    return responses.join(known, KEY, "left")


def _as_bytes(text: Column) -> Column:
    """A text with one character for each of its bytes, for patterns that count bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _as_text(chars: Column) -> Column:
    return F.decode(F.encode(chars, "ISO-8859-1"), "UTF-8")


_OPEN, _CLOSE = (x.encode().decode("latin-1") for x in (OPEN, CLOSE))
#: A token: from an opening mark to the next closing one, which begins at most
#: REACH bytes behind the opening mark's begin.
_TOKEN = f"{_OPEN}(?:(?!{_CLOSE})[\\s\\S]){{0,{REACH - len(_OPEN)}}}{_CLOSE}"


def restored(text: Column, tokens: Column) -> Column:
    """restored, exact_replacements and unknown_tokens of a text as a struct;
    ``tokens`` maps tokens to originals. Tokens are cut out first and put
    together with the gaps between them, so what is put in isn't searched again."""
    tokens = F.coalesce(tokens, F.create_map().cast("map<string,string>"))
    chars = _as_bytes(text)
    found = F.transform(F.regexp_extract_all(chars, F.lit(_TOKEN), F.lit(0)), _as_text)
    gaps = F.transform(F.split(chars, _TOKEN, -1), _as_text)

    def filled(cut: Column) -> Column:
        shown = F.transform(cut["found"], lambda t: F.coalesce(F.try_element_at(tokens, t), t))
        out = F.array_join(F.flatten(F.zip_with(cut["gaps"], shown, lambda g, t: F.array(g, F.coalesce(t, F.lit(""))))), "")
        unknown = F.filter(cut["found"], lambda t: ~F.map_contains_key(tokens, t))
        return F.struct(out.alias("restored"), (F.size(cut["found"]) - F.size(unknown)).cast("bigint").alias("exact_replacements"), F.array_distinct(unknown).alias("unknown_tokens"))

    none = F.struct(F.lit(None).cast("string").alias("restored"), F.lit(0).cast("bigint").alias("exact_replacements"), F.array().cast("array<string>").alias("unknown_tokens"))
    return F.when(text.isNull(), none).otherwise(let(F.struct(found.alias("found"), gaps.alias("gaps")), filled))


def restore(responses: DataFrame, key: str | tuple[str, ...] = "response_id", text: str = "text", tokens: str = "tokens") -> DataFrame:
    """``restored`` of each response as columns; ``key`` names those that are kept."""
    keys = (key,) if isinstance(key, str) else key
    return responses.select(*keys, restored(F.col(text), F.col(tokens)).alias("r")).select(*keys, "r.*")


def may_be_reviewed(text: Column) -> Column:
    """A text that still holds a token can't be marked as reviewed."""
    return ~text.contains(OPEN)


def stale(submissions: DataFrame, sources: DataFrame, notes: DataFrame, templates: DataFrame) -> DataFrame:
    """Submissions with ``usable``: not consumed yet, the template and every
    source note unchanged since."""
    now = notes.select("doc_id", F.col("revision").alias("_now"))
    moved = sources.join(now, "doc_id", "left").groupBy("preparation_id").agg(F.max(F.coalesce(F.col("revision") != F.col("_now"), F.lit(True))).alias("_moved"))
    held = submissions.join(moved, "preparation_id", "left").join(templates.select("template_id", F.col("version").alias("_version"), "archived"), "template_id", "left")
    ok = F.col("consumed_at").isNull() & ~F.coalesce("_moved", F.lit(True)) & F.coalesce(F.col("template_version") == F.col("_version"), F.lit(False)) & ~F.coalesce("archived", F.lit(True))
    return held.withColumn("usable", ok).drop("_moved", "_version", "archived")


def body_text(blocks: Column) -> Column:
    """Plain text of a body: runs joined, bullets marked, blocks by lines."""
    line = lambda b: F.concat(F.when(b["kind"] == "bulleted_list", "• ").otherwise(""), F.array_join(F.transform(b["runs"], lambda r: r["text"]), ""))
    return F.array_join(F.transform(blocks, line), "\n")


def body_valid(blocks: Column) -> Column:
    kinds = ("paragraph", "heading", "bulleted_list")
    return F.coalesce(F.size(blocks).between(1, 2000) & F.forall(blocks, lambda b: b["kind"].isin(*kinds)), F.lit(False))
