"""Review of detected identifiers: merging, labels, decisions, rendering, rescan.

One shuffle on the document id brings a document's evidence together; every
window below has the document in its key, so a partition is never more than
one document's evidence.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.spans import CUT, FEW, cut_out, let, running, running_sums
from inkwell.operators import batches, detect
from inkwell.sources.shared import written

DOC = "doc_id"


def islands(spans: DataFrame, order: tuple[str, ...] = ("start", "end", "seq")) -> DataFrame:
    """Number the groups of overlapping spans; spans that only touch stay apart."""
    by = Window.partitionBy(DOC).orderBy(*order)
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    return spans.withColumn("_opens", opens).withColumn("island", F.sum("_opens").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def merge(evidence: DataFrame) -> DataFrame:
    """Items: merged spans with category, stages and confidence.

    The category is that of the first evidence by rules in (start, end, seq)
    order, else of the first evidence.
    """
    rank = F.struct(F.col("stage") != "rules", F.col("start"), F.col("end"), F.col("seq"))
    items = islands(evidence).groupBy(DOC, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("category", rank).alias("category"),
        F.sort_array(F.collect_set("stage")).alias("stages"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_evidence"),
    )
    return items.withColumnRenamed("island", "item")


def label(items: DataFrame, notes: DataFrame, text: str = "text") -> DataFrame:
    """Phrase, group and placeholder of every item. The same phrase in the same
    category is one group; numbers go by first appearance in each category."""
    phrase = F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start"))
    named = items.join(notes.select(DOC, F.col(text).alias("_text")), DOC).withColumn("phrase", phrase).drop("_text")
    same = Window.partitionBy(DOC, "category", "phrase")
    named = named.withColumn("group", F.min("item").over(same)).withColumn("_first", F.min("start").over(same))
    number = F.dense_rank().over(Window.partitionBy(DOC, "category").orderBy("_first"))
    return named.withColumn("number", number).withColumn("replacement", F.concat(F.lit("["), "category", F.lit("_"), F.col("number").cast("string"), F.lit("]"))).drop("_first")


#: Characters up to which a text's items are made in its own row.
SHORT = 4096


def items_in(evidence: Column, text: Column) -> Column:
    """``label(merge(evidence))`` of one text as an array in its row, from an
    array of structs (start, end, seq, category, confidence, stage). Quadratic
    in the number of pieces, so for short texts."""

    def item(part: Column, k: Column) -> Column:
        first, one = F.get(part, F.lit(0)), F.size(part) == 1
        rank = lambda x: F.struct((x["stage"] != "rules").alias("later"), x["start"], x["end"], x["seq"], x["category"].alias("category"))
        greatest = lambda c: F.when(one, first[c]).otherwise(F.array_max(F.transform(part, lambda x: x[c])))
        return F.struct(
            (k + 1).cast("bigint").alias("item"), first["start"].alias("start"), greatest("end").alias("end"),
            F.when(one, first["category"]).otherwise(F.array_min(F.transform(part, rank))["category"]).alias("category"),
            F.when(one, F.array(first["stage"])).otherwise(F.sort_array(F.array_distinct(F.transform(part, lambda x: x["stage"])))).alias("stages"),
            greatest("confidence").alias("confidence"), F.size(part).cast("bigint").alias("n_evidence"),
        )

    def merged(ordered: Column) -> Column:
        opens = lambda reach: F.filter(F.transform(ordered, lambda x, i: F.when((i == 0) | (x["start"] >= F.array_max(F.slice(reach, F.lit(1), i))), i)), lambda i: i.isNotNull())
        at = let(F.transform(ordered, lambda x: x["end"]), opens)
        cut = lambda b: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda s, k: let(F.slice(ordered, s + 1, F.get(b, k + 1) - s), lambda part: item(part, k)))
        return let(F.concat(at, F.array(F.size(ordered))), cut)

    def named(items: Column) -> Column:
        keys = F.transform(items, lambda x: F.struct(x["category"].alias("category"), F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("phrase")))

        def grouped(keys: Column) -> Column:
            # A group has the number of its first item.
            def numbered(group: Column) -> Column:
                heads = F.transform(keys, lambda x, i: F.when(F.get(group, i) == i + 1, x["category"]))

                def out(heads: Column) -> Column:
                    def row(x: Column, i: Column) -> Column:
                        number = F.size(F.filter(F.slice(heads, F.lit(1), F.get(group, i).cast("int")), lambda c: c == x["category"]))
                        own = [x[c].alias(c) for c in ("item", "start", "end", "category", "stages", "confidence", "n_evidence")]
                        return let(number, lambda n: F.struct(*own, F.get(keys, i)["phrase"].alias("phrase"), F.get(group, i).alias("group"), n.alias("number"), F.concat(F.lit("["), x["category"], F.lit("_"), n.cast("string"), F.lit("]")).alias("replacement")))

                    return F.transform(items, row)

                return let(heads, out)

            return let(F.transform(keys, lambda x: F.array_position(keys, x)), numbered)

        return let(keys, grouped)

    return let(let(F.sort_array(evidence), merged), named)


def found_in(text: Column) -> Column:
    """The rules' evidence of a text as ``items_in`` takes it."""
    return _staged(detect.evidence_in(text))


def _staged(evidence: Column) -> Column:
    return F.transform(evidence, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), i.cast("bigint").alias("seq"), x["category"].alias("category"), x["confidence"].alias("confidence"), F.lit("rules").alias("stage")))


def with_items(notes: DataFrame, text: str = "text", fields: tuple[str, ...] = tuple(batches.ITEM)) -> DataFrame:
    """``notes`` that have an id with the ``items`` of their texts by the rules
    as an array in the row, for texts of any length: they are taken through by
    batches. ``fields`` are the items' columns."""
    return batches.with_items(notes.where(F.col(DOC).isNotNull()), text, _staged(detect.rule_evidence(F.col(text))), "items", fields)


def labelled(notes: DataFrame, text: str = "text", fields: tuple[str, ...] = tuple(batches.ITEM)) -> DataFrame:
    """``label(merge(detect(notes)))``, for notes whose ids aren't repeated; a
    text's items are made in its row. ``fields`` are the columns that are made."""
    return rows_of(with_items(notes, text, fields)).withColumn("stages", F.array(F.lit("rules")))


def rows_of(notes: DataFrame, items: str = "items") -> DataFrame:
    """A row for each item of a column of arrays. It is exploded as an
    expression: Spark would filter a column first, and make it twice."""
    return notes.select(DOC, F.inline(F.coalesce(items, F.array().cast(notes.schema[items].dataType))))


def reason(stages: Column) -> Column:
    """Why an item is there, by the strongest stage. The wordings."""
    has = lambda s: F.array_contains(stages, s)
    return (
        F.when(has("manual"), "Manually selected for review.").when(has("library"), "Matches a saved local mapping.")
        .when(has("rules"), "Matches a structured identifier pattern.").otherwise("The local model marked this as a possible named entity.")
    )


def valid_label(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^\[[A-Z][A-Z0-9_]*\]$") & F.octet_length(value).between(3, 48), F.lit(False))


def decide(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply (doc_id, group, decision, label) to whole groups.

    A group without a decision is pending. An edit with a label that isn't
    valid leaves the group pending; several decisions on a group: the last by
    ``seq`` counts, where there is such a column.
    """
    order = F.col("seq") if "seq" in decisions.columns else F.lit(0)
    last = decisions.groupBy(DOC, "group").agg(F.max_by(F.struct("decision", "label"), F.struct(order.alias("o"), "decision")).alias("_d"))
    joined = items.join(last, [DOC, "group"], "left")
    return decided(joined, F.col("_d.decision"), F.col("_d.label")).drop("_d")


def decided(items: DataFrame, decision: Column, label: Column) -> DataFrame:
    """``decide`` where the decision and label of a group are known from its
    items' own columns: no table of decisions is built and joined."""
    chosen = F.when(decision == "edit", F.when(valid_label(label), "edit").otherwise("pending")).otherwise(F.coalesce(decision, F.lit("pending")))
    renamed = F.when(F.col("_chosen") == "edit", label).otherwise(F.col("replacement"))
    return items.withColumn("_chosen", chosen).withColumn("replacement", renamed).withColumn("decision", F.col("_chosen")).drop("_chosen")


# The same of short lists in their notes' rows: ``items`` is an array there.


def decided_in(items: Column, decision, label) -> Column:
    """``decided`` of an array of items; ``decision`` and ``label`` take an item.
    Each item has at least phrase and replacement."""

    def one(x: Column, asked: Column) -> Column:
        named = F.when(asked == "edit", label(x))
        return let(named, lambda n: let(F.when(asked == "edit", F.when(valid_label(n), "edit").otherwise("pending")).otherwise(F.coalesce(asked, F.lit("pending"))), lambda c: x.withField("replacement", F.when(c == "edit", n).otherwise(x["replacement"])).withField("decision", c)))

    return F.transform(items, lambda x: let(decision(x), lambda asked: one(x, asked)))


def rendered_in(text: Column, items: Column) -> Column:
    """The rendered text of a note from its decided items."""
    return spliced(text, items, lambda x: written_as(x["phrase"], x["decision"], x["replacement"]))


def egress_in(items: Column) -> Column:
    """``egress`` of an array of decided items, by position."""
    shift = F.transform(items, lambda x: F.length(written_as(x["phrase"], x["decision"], x["replacement"])) - (x["end"] - x["start"]))

    def placed(shifts: Column) -> Column:
        # Texts before an item have moved it; its own change moves its end.
        moved = F.transform(items, lambda x, i: x.withField("output_start", (x["start"] + F.coalesce(F.when(i > 0, F.get(shifts, i - 1)), F.lit(0))).cast("bigint")).withField("output_end", (x["end"] + F.get(shifts, i)).cast("bigint")))
        return F.filter(moved, lambda x: x["decision"].isin("accept", "edit"))

    return let(let(shift, lambda n: F.when(F.size(n) <= FEW, running(n)).otherwise(running_sums(n))), placed)


_SAVED = ("item", "start", "end", "category", "group", "replacement", "decision")


def snapshot_in(items: Column) -> Column:
    """``snapshot`` of an array of items."""
    return F.to_json(F.transform(items, lambda x: F.struct(*[x[c].alias(c) for c in _SAVED])))


def restored_in(snapshot: Column, text: Column) -> Column:
    """``restore`` of a note's snapshot as an array; null where it can't be restored."""
    return let(F.from_json(snapshot, SNAPSHOT), lambda items: F.when(_restorable(items, F.length(text)), items))


def split_item(items: DataFrame, splits: DataFrame | Column) -> DataFrame:
    """Give each (doc_id, item) of ``splits`` (or each item that meets such a
    condition) a group of its own and the next label of its category that no
    item of the document has; it is pending again."""
    if isinstance(splits, Column):
        marked = items.withColumn("_split", F.when(splits, True))
    else:
        marked = items.join(splits.select(DOC, "item").distinct().withColumn("_split", F.lit(True)), [DOC, "item"], "left")
    doc, kind = Window.partitionBy(DOC), Window.partitionBy(DOC, "category")
    # The window with an order comes first: its sort serves the others.
    nth = F.row_number().over(kind.orderBy(F.col("_split").isNull(), "start"))
    counter = F.max("number").over(kind)
    used = F.collect_set("replacement").over(doc)
    marked = marked.withColumn("_nth", nth).withColumn("_max", counter).withColumn("_used", used)
    # Free numbers above the counter: of max + 1 .. max + nth + used, the nth that is not taken.
    free = F.filter(F.transform(F.sequence(F.col("_max") + 1, F.col("_max") + F.col("_nth") + F.size("_used")), lambda n: F.concat(F.lit("["), F.col("category"), F.lit("_"), n.cast("string"), F.lit("]"))), lambda s: ~F.array_contains("_used", s))
    own = F.col("_split").isNotNull()
    out = marked.withColumn("replacement", F.when(own, F.get(free, F.col("_nth") - 1)).otherwise(F.col("replacement")))
    out = out.withColumn("group", F.when(own, F.col("item") + (1 << 20)).otherwise(F.col("group"))).withColumn("decision", F.when(own, "pending").otherwise(F.col("decision")))
    return out.drop("_split", "_used", "_max", "_nth")


def reopen(items: DataFrame) -> DataFrame:
    """A pending member makes its whole group pending."""
    any_open = F.max((F.col("decision") == "pending").cast("int")).over(Window.partitionBy(DOC, "group"))
    return items.withColumn("decision", F.when(any_open == 1, "pending").otherwise(F.col("decision")))


def written_as(phrase: Column, decision: Column, replacement: Column) -> Column:
    return F.when(decision == "keep", phrase).when(decision == "remove", "").otherwise(replacement)


def output_positions(items: DataFrame) -> DataFrame:
    """Where each item lies in the rendered text."""
    out = written_as(F.col("phrase"), F.col("decision"), F.col("replacement"))
    shift = F.length(out) - (F.col("end") - F.col("start"))
    before = F.coalesce(F.sum(shift).over(Window.partitionBy(DOC).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return items.withColumn("output_start", (F.col("start") + before).cast("bigint")).withColumn("output_end", (F.col("start") + before + F.length(out)).cast("bigint"))


_PIECE = "array<struct<start:int,end:int,out:string,replaced:boolean,category:string>>"


def pieces(items: DataFrame) -> DataFrame:
    """Each document's items as one array, by position."""
    out = written_as(F.col("phrase"), F.col("decision"), F.col("replacement"))
    piece = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), out.alias("out"), (F.col("decision") != "keep").alias("replaced"), "category")
    return items.groupBy(DOC).agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.count_if(F.col("decision") == "pending").alias("pending"), F.count_if(F.col("decision") == "keep").alias("retained"))


def spliced(text: Column, parts: Column, put) -> Column:
    """``text`` with ``put(part)`` in place of each of ``parts`` (ordered, with
    ``start`` and ``end``). Pieces are cut out side by side and joined once."""

    def joined(parts: Column, piece) -> Column:
        # Each part with the text between it and the one before.
        cut = F.transform(parts, lambda x, i: F.concat(piece(F.when(i == 0, 0).otherwise(F.get(parts, i - 1)["end"]), x["start"]), put(x)))
        return F.concat(F.array_join(cut, ""), piece(F.coalesce(F.try_element_at(parts, F.lit(-1))["end"], F.lit(0)), F.length(text)))

    # A short text is cut as it is.
    direct = lambda start, end: F.substring(text, start + 1, end - start)
    return let(parts, lambda p: F.when(F.length(text) <= CUT, joined(p, direct)).otherwise(cut_out(text, lambda piece: joined(p, piece))))


def _masked(x: Column) -> Column:
    return F.when(x["replaced"], F.repeat(F.lit(" "), F.length(x["out"]))).otherwise(x["out"])


def render(notes: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, output, scan_text (generated parts masked by spaces), pending,
    retained. A note without items is rendered as it is. ``scan_text`` is null
    while anything is pending."""
    joined = notes.select(DOC, F.col(text).alias("_text")).join(pieces(items), DOC, "left")
    parts = F.coalesce("pieces", F.array().cast(_PIECE))
    out = joined.withColumn("pieces", parts).withColumn("pending", F.coalesce("pending", F.lit(0))).withColumn("retained", F.coalesce("retained", F.lit(0)))
    return out.select(DOC, spliced(F.col("_text"), F.col("pieces"), lambda x: x["out"]).alias("output"), F.when(F.col("pending") == 0, spliced(F.col("_text"), F.col("pieces"), _masked)).alias("scan_text"), "pending", "retained", "pieces", F.length("_text").alias("n_chars"))


def _found_again(shown: DataFrame, find) -> DataFrame:
    """``find``'s evidence in the texts of ``render``, at positions of the source."""
    ready = shown.where("scan_text is not null")
    found = find(ready.select(DOC, F.col("scan_text").alias("text")))
    # Unreplaced pieces of source and output, the gaps between items among them.
    last = F.struct(F.col("n_chars").alias("start"), F.col("n_chars").alias("end"), F.lit("").alias("out"), F.lit(True).alias("replaced"), F.lit("").alias("category"))
    cut = ready.select(DOC, F.posexplode(F.concat("pieces", F.array(last))).alias("n", "p"))
    by = Window.partitionBy(DOC).orderBy("n")
    gap_start = F.coalesce(F.lag("p.end").over(by), F.lit(0))
    cut = cut.withColumn("gap_start", gap_start).withColumn("size", F.col("p.start") - F.col("gap_start") + F.length("p.out"))
    cut = cut.withColumn("out_start", F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    gap = F.struct(F.col("gap_start").alias("s"), F.col("p.start").alias("e"), F.col("out_start").alias("os"), F.lit(False).alias("kept"))
    kept = F.struct(F.col("p.start").alias("s"), F.col("p.end").alias("e"), (F.col("out_start") + F.col("p.start") - F.col("gap_start")).alias("os"), F.lit(True).alias("kept"))
    plain = cut.select(DOC, F.inline(F.array(gap, F.when(~F.col("p.replaced"), kept)))).where("e > s").withColumn("oe", F.col("os") + F.col("e") - F.col("s"))
    touched = found.join(plain, DOC).where((F.col("os") < F.col("end")) & (F.col("start") < F.col("oe")))
    first, last = F.min(F.struct("os", "s")).alias("f"), F.max(F.struct("os", "oe", "s", "e", "kept")).alias("l")
    mapped = touched.groupBy(DOC, "seq", "category", "start", "end", "confidence", "stage").agg(first, last).select(
        DOC, "seq", "category", "confidence", "stage",
        (F.col("f.s") + F.greatest("start", "f.os") - F.col("f.os")).cast("int").alias("start"),
        (F.col("l.s") + F.least("end", "l.oe") - F.col("l.os")).cast("int").alias("end"),
        F.col("l.s").alias("_s"), F.col("l.kept").alias("_kept"),
    )
    # A span inside a kept item touches that piece alone.
    return mapped.where(~(F.col("_kept") & (F.col("_s") <= F.col("start")))).drop("_s", "_kept")


def rescan(notes: DataFrame, items: DataFrame, text: str = "text", find=detect.detect) -> DataFrame:
    """Evidence that the rendered text still shows, at positions of the source.

    ``find`` takes (doc_id, text) and gives evidence: the rules, or those with
    recognised entities and saved phrases (``detect.combined``). What lies
    wholly in generated text, or inside a kept item, is dropped; notes with
    anything pending aren't scanned.
    """
    return _found_again(written(render(notes, items, text), "shown"), find)


def gate(notes: DataFrame, items: DataFrame, text: str = "text", find=detect.detect) -> DataFrame:
    """doc_id, pending, found_again, may_copy: a text may be copied only when
    nothing is pending and the rescan finds nothing."""
    shown = written(render(notes, items, text), "shown")
    again = _found_again(shown, find).groupBy(DOC).agg(F.count(F.lit(1)).alias("found_again"))
    out = shown.select(DOC, "pending", "retained").join(again, DOC, "left").withColumn("found_again", F.coalesce("found_again", F.lit(0)))
    return out.withColumn("may_copy", (F.col("pending") == 0) & (F.col("found_again") == 0))


def add_evidence(items: DataFrame, evidence: DataFrame, notes: DataFrame, text: str = "text") -> DataFrame:
    """Labelled, decided items after more evidence (doc_id, seq, category,
    start, end, confidence, stage) has come in, as by a rescan or by hand.

    Evidence that overlaps an item becomes part of it and makes it pending. An
    item that grows, or whose category a rule now decides, leaves its group and
    its label. Items without a label take that of an equal phrase in their
    category, else a new one that no item has; a pending member reopens its
    whole group. Items are numbered anew, groups that stay keep their numbers.
    """
    none = lambda t: F.lit(None).cast(t)
    old = items.select(DOC, "start", "end", "category", "stages", F.col("confidence").cast("double").alias("confidence"), F.col("group").cast("bigint").alias("group"), F.col("number").cast("bigint").alias("number"), "replacement", "decision", F.lit(0).alias("_new"), F.col("item").cast("bigint").alias("_seq"))
    new = evidence.select(DOC, "start", "end", "category", F.array("stage").alias("stages"), F.col("confidence").cast("double").alias("confidence"), none("bigint").alias("group"), none("bigint").alias("number"), none("string").alias("replacement"), F.lit("pending").alias("decision"), F.lit(1).alias("_new"), F.col("seq").cast("bigint").alias("_seq"))
    doc = Window.partitionBy(DOC)
    pool = old.unionByName(new).withColumn("_top", F.coalesce(F.max("group").over(doc), F.lit(0))).withColumn("_used", F.collect_set("replacement").over(doc))
    counters = old.groupBy(DOC, "category").agg(F.max("number").alias("_count"))
    rank = F.struct("start", "end", "_new", "_seq")
    ruled = F.when(F.array_contains("stages", "rules"), F.struct("start", "end", "_new", "_seq", "category"))
    parts = islands(pool, ("start", "end", "_new", "_seq")).groupBy(DOC, F.col("island").alias("item")).agg(
        F.min_by(F.struct("start", "end", "category", "group", "number", "replacement", "decision"), rank).alias("f"), F.max("end").alias("end"), F.min(ruled)["category"].alias("_rule"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("stages")))).alias("stages"), F.max("confidence").alias("confidence"),
        F.max((F.col("decision") == "pending").cast("int")).alias("_open"), F.first("_top").alias("_top"), F.first("_used").alias("_used"),
    )
    merged = parts.withColumn("start", F.col("f.start")).withColumn("category", F.coalesce("_rule", "f.category"))
    grown = (F.col("end") != F.col("f.end")) | (F.col("category") != F.col("f.category"))
    keeps = ~grown & F.col("f.replacement").isNotNull()
    merged = merged.withColumn("decision", F.when(grown | (F.col("_open") == 1), "pending").otherwise(F.col("f.decision"))).withColumns({c: F.when(keeps, F.col(f"f.{c}")) for c in ("group", "number", "replacement")})
    phrase = F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start"))
    merged = merged.join(counters, [DOC, "category"], "left").join(notes.select(DOC, F.col(text).alias("_text")), DOC).withColumn("phrase", phrase).drop("_text", "f", "_rule", "_open")
    same, kind = Window.partitionBy(DOC, "category", "phrase"), Window.partitionBy(DOC, "category")
    named = F.struct("start", "group", "number", "replacement")
    merged = merged.withColumn("_like", F.min(F.when(F.col("replacement").isNotNull(), named)).over(same)).withColumn("_at", F.min("start").over(same))
    fresh = F.col("_like").isNull()
    # Phrases without any label, in the order of their first places: the nth of
    # a category gets the nth free number above those that were given.
    merged = merged.withColumn("_nth", F.dense_rank().over(kind.orderBy(F.when(fresh, F.col("_at")).asc_nulls_last()))).withColumn("_count", F.coalesce("_count", F.lit(0)))
    named_as = lambda n: F.concat(F.lit("["), F.col("category"), F.lit("_"), n.cast("string"), F.lit("]"))
    free = F.filter(F.sequence(F.col("_count") + 1, F.col("_count") + F.col("_nth") + F.size("_used")), lambda n: ~F.array_contains("_used", named_as(n)))
    merged = merged.withColumn("_number", F.when(fresh, F.get(free, F.col("_nth") - 1))).withColumn("_own", F.min("item").over(same))
    lacks = F.col("replacement").isNull()
    out = merged.withColumns({
        "group": F.when(lacks, F.coalesce("_like.group", F.col("_top") + F.col("_own"))).otherwise(F.col("group")),
        "number": F.when(lacks, F.coalesce("_like.number", "_number")).otherwise(F.col("number")),
        "replacement": F.when(lacks, F.coalesce("_like.replacement", named_as(F.col("_number")))).otherwise(F.col("replacement")),
    })
    return reopen(out.select(DOC, "item", "start", "end", "category", "stages", "confidence", "phrase", "group", "number", "replacement", "decision"))


def finish_scan(notes: DataFrame, items: DataFrame, text: str = "text", find=detect.detect) -> DataFrame:
    """Items after the rescan: what it finds comes in as pending evidence."""
    return add_evidence(items, rescan(notes, items, text, find), notes, text)


def accept_pending(items: DataFrame) -> DataFrame:
    return items.withColumn("decision", F.when(F.col("decision") == "pending", "accept").otherwise(F.col("decision")))


def settle(notes: DataFrame, items: DataFrame, text: str = "text", find=detect.detect, decide=accept_pending, rounds: int = 16) -> tuple[DataFrame, DataFrame]:
    """Rescan until nothing is found: (items, notes' (doc_id, rounds, settled)).

    Each round renders, scans and merges only the notes in which the round
    before found something; the others are done. ``decide`` takes the decisions
    on what is pending, as all items are that come without one. ``rounds`` tells how often something was found; a note
    that still shows something after the last one isn't ``settled``, its items
    are those of that round. One number, of notes still open, reaches the
    driver in a round.
    """
    columns = [DOC, "item", "start", "end", "category", "stages", "confidence", "phrase", "group", "number", "replacement", "decision"]
    items = items if "decision" in items.columns else items.withColumn("decision", F.lit("pending"))
    open_notes, open_items = notes.select(DOC, F.col(text).alias("text")), written(decide(items).select(*columns), "items")
    done_items, done = [], []
    for n in range(rounds + 1):
        found = written(rescan(open_notes, open_items, "text", find), "found")
        still = written(found.select(DOC).distinct(), "open")
        last = n == rounds or still.limit(1).count() == 0
        over = still.limit(0) if last else still
        done_items.append(open_items.join(over, DOC, "left_anti").select(*columns))
        marked = open_notes.select(DOC).join(still.withColumn("_open", F.lit(True)), DOC, "left")
        marked = marked if last else marked.where("_open is null")
        done.append(marked.select(DOC, F.lit(n).alias("rounds"), F.col("_open").isNull().alias("settled")))
        if last:
            break
        open_notes = written(open_notes.join(still, DOC, "left_semi"), "notes")
        again = add_evidence(open_items.join(still, DOC, "left_semi"), found, open_notes)
        open_items = written(decide(again).select(*columns), "items")
    union = lambda dfs: functools.reduce(DataFrame.unionByName, dfs)
    return union(done_items), union(done)


def grouped_view(items: DataFrame) -> DataFrame:
    """(doc_id, group, place, start, n_items, manual, items): the groups as a
    reviewer meets them, those without manual items first, then by first place."""
    row = F.struct("start", "end", "item")
    groups = items.groupBy(DOC, "group").agg(F.min("start").alias("start"), F.count(F.lit(1)).alias("n_items"), F.max(F.array_contains("stages", "manual")).alias("manual"), F.sort_array(F.collect_list(row)).alias("items"))
    return groups.withColumn("place", F.row_number().over(Window.partitionBy(DOC).orderBy("manual", "start", "group")))


def egress(items: DataFrame) -> DataFrame:
    """Items that leave under a placeholder: accepted or edited ones."""
    return output_positions(items).where(F.col("decision").isin("accept", "edit"))


def snapshot(items: DataFrame) -> DataFrame:
    """Each document's items as JSON."""
    row = F.struct("item", "start", "end", "category", "group", "replacement", "decision")
    return items.groupBy(DOC).agg(F.to_json(F.sort_array(F.collect_list(row))).alias("snapshot"))


SNAPSHOT = "array<struct<item:bigint,start:int,end:int,category:string,group:bigint,replacement:string,decision:string>>"


def _restorable(items: Column, size: Column) -> Column:
    return F.forall(items, lambda x: x["item"].isNotNull() & (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= size))


def _read_snapshots(snapshots: DataFrame, notes: DataFrame, text: str) -> DataFrame:
    read = snapshots.withColumn("_items", F.from_json("snapshot", SNAPSHOT)).join(notes.select(DOC, F.length(text).alias("_n")), DOC, "left")
    return read.withColumn("valid", F.coalesce(_restorable(F.col("_items"), F.col("_n")), F.lit(False)))


def restorable(snapshots: DataFrame, notes: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and ``valid`` of every snapshot: false for a record that can't be
    read, a span outside its note, and a note that is gone."""
    return _read_snapshots(snapshots, notes, text).select(DOC, "valid")


def restore(snapshots: DataFrame, notes: DataFrame, text: str = "text") -> DataFrame:
    """Items from JSON, of the snapshots that are ``restorable``; of the others
    no item is restored."""
    return _read_snapshots(snapshots, notes, text).where("valid").select(DOC, F.inline("_items"))


def check_revision(edits: DataFrame, notes: DataFrame) -> DataFrame:
    """Edits with ``accepted``: false where the note moved on or is gone."""
    now = notes.select(DOC, F.col("revision").alias("_now"))
    return edits.join(now, DOC, "left").withColumn("accepted", F.coalesce(F.col("revision") == F.col("_now"), F.lit(False))).drop("_now")
