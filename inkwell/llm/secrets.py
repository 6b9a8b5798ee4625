"""Secret scans over an incremental blob ledger.

Every version of a text is content-addressed. Only pairs of blob and rule
version that the ledger has not seen are scanned, once for each blob however
many paths hold it, and the findings are joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.spans import cut_out, find_spans, let, running_sums

from .common import hinted, written

RULE_VERSION = "4"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A text without this substring (or, as a pattern, without a match) has no match.
    cue: str
    #: Group whose length is at least ``least``; else the match is dropped.
    least: int = 0


#: Base kinds, in the order that their spans are listed. A drop rule can't be
#: part of ``assign``'s pattern: a short value uses up its text.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++""", r"(?i:passw|secret|token|api_?key)", 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}+", "AKIA"),
    Rule("hex", r"(?:(?<![0-9a-f])|\G)[0-9a-f]{32,}+", r"[0-9a-f]{32}"),
)
#: What the scan finds beyond them.
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("github", r"(?<![A-Za-z0-9_])gh[oprsu]_[A-Za-z0-9]{36,255}+", r"gh[oprsu]_"),
    Rule("slack", r"(?<![A-Za-z0-9_])xox[abprs]-[A-Za-z0-9-]{10,255}+", r"xox[abprs]-"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "eyJ"),
)
RULES = BASE + MORE
#: The same to the end of a token: op1's SQL ends those of GitHub and Slack at
#: 255 characters, but a redacted text may not keep the rest.
WHOLE = tuple(replace(r, pattern=r.pattern.replace(",255}+", ",}+")) for r in RULES)
FINDING = "array<struct<start:int,order:int,kind:string,end:int>>"


def _findings(text: Column, order: int, rule: Rule) -> Column:
    cue = text.rlike(rule.cue) if any(c in rule.cue for c in "[(") else text.contains(rule.cue)
    spans = find_spans(text, rule.pattern, cue, context=0)
    if rule.least:
        # The value is what follows the one separator and quote that the pattern allows.
        value = rf"(?i)^(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{{{rule.least},}}$"
        spans = F.filter(spans, lambda x: x["value"].rlike(value))
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), x["end"].alias("end")))


def scan(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All findings of a text, by start, then by the order of the rules."""
    return F.sort_array(F.concat(*[_findings(text, order, rule) for order, rule in enumerate(rules)]))


def joined(findings: Column) -> Column:
    """``kind:start:end`` of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_versions(versions: DataFrame, path: str, text: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings for every row of ``versions``, and the ledger's new rows.

    ``ledger`` has (blob, rule_version, findings) of earlier runs; its blobs
    aren't scanned again under the same rule version. Returns ``versions``'
    ``path`` with ``blob`` and ``findings`` (row for row; an empty array where
    there are none), and the new ledger rows, which the caller appends. A null
    text counts as empty; equal rows each get the findings; a null path is a
    path like others.
    """
    docs = versions.select(F.col(path).alias("path"), F.col(text).alias("text")).withColumn("blob", blob_of(F.col("text")))
    seen = written(docs.select("path", "blob"), "versions")
    # One row of each blob is scanned: that of its first path, unless the ledger
    # has the blob. What is scanned and what isn't is settled without the texts.
    shared = written(seen.groupBy("blob").agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared")
    marked = seen.join(hinted(shared).withColumn("_many", F.lit(True)), "blob", "left")
    if ledger is not None:
        known = written(ledger.where(F.col("rule_version") == rule_version).groupBy("blob").agg(F.first("findings").alias("findings")), "known")
        marked = marked.join(known.select("blob", F.lit(True).alias("_known")), "blob", "left")
    else:
        marked = marked.withColumn("_known", F.lit(None).cast("boolean"))
    todo = F.col("_known").isNull() & (F.col("_many").isNull() | F.col("path").eqNullSafe(F.col("first")))
    marked = written(marked.groupBy("path", "blob", todo.alias("todo")).agg(F.count(F.lit(1)).alias("n")), "marked")
    sides = {t: marked.where("todo" if t else "not todo").select(F.col("path").alias("_path"), F.col("blob").alias("_blob")) for t in (True, False)}
    same = lambda side: docs["path"].eqNullSafe(side["_path"]) & (docs["blob"] == side["_blob"])
    # The smaller side is joined, so that as a rule the texts needn't move.
    few = min(sides, key=lambda t: sides[t].count())
    side = hinted(sides[few])
    texts = docs.join(side, same(side), "left_semi" if few else "left_anti").select("blob", "text")
    # Equal rows of one path, and rows without a path, can't be told apart.
    again = hinted(marked.where("todo and n > 1").select("blob").distinct())
    if again.limit(1).count():
        alike = texts.join(again, "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
        texts = texts.join(again, "blob", "left_anti").unionByName(alike)
    scanned = texts.select("blob", scan(F.col("text"), rules).alias("findings"))
    rows = written(scanned.withColumn("rule_version", F.lit(rule_version)).select("blob", "rule_version", "findings"), "ledger")
    every = rows.select("blob", "findings") if ledger is None else rows.select("blob", "findings").unionByName(known)
    # Blobs without findings need no row in this join.
    hits = every.where(F.size("findings") > 0)
    back = seen.join(hits, "blob", "left").select(F.col("path").alias(path), "blob", F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))
    return back, rows


def append_ledger(rows: DataFrame, folder: str) -> None:
    """Add new rows to a ledger folder of Parquet files."""
    rows.write.mode("append").parquet(folder)


def redact(text: Column, findings: Column, label: str = "[SECRET]") -> Column:
    """The text with every finding (ordered by start) replaced by ``label``;
    findings that overlap become one. Linear in the text: what lies between
    findings is cut out in blocks and joined once."""

    def joined(piece) -> Column:
        def put(reach: Column) -> Column:
            # Each finding beside how far those before it reach.
            pairs = F.arrays_zip(findings.alias("own"), F.slice(F.concat(F.array(F.lit(0)), reach), F.lit(1), F.size(findings)).alias("after"))
            cut = F.transform(pairs, lambda z: F.when(z["own"]["start"] >= z["after"], F.concat(piece(z["after"], z["own"]["start"]), F.lit(label))).otherwise(""))
            return F.concat(F.array_join(cut, ""), piece(F.coalesce(F.try_element_at(reach, F.lit(-1)), F.lit(0)), F.length(text)))

        return let(running_sums(F.transform(findings, lambda x: x["end"]), F.greatest), put)

    return F.when(F.size(findings) > 0, cut_out(text, joined)).otherwise(text)
