"""URL filters: host-suffix and path-prefix expressions against a rule table.

Each URL is expanded into the few expressions that a rule could have (one for
each pair of label count and path length that occurs among the rules), these
are equi-joined with the rules on a short prefix of their SHA-256 digests, the
full digests confirm the match, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Hex digits of a digest that are the join key.
PREFIX_DIGITS = 8
#: A rule table may have this many distinct (label count, path length) pairs.
MAX_SHAPES = 4096
RULES_SCHEMA = "verdict string, host string, path string"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def _digest(frame: DataFrame, host: str, path: str) -> DataFrame:
    full = F.sha2(F.concat_ws("\n", F.col(host), F.col(path)), 256)
    return frame.withColumn("_digest", full).withColumn("_prefix", F.substring("_digest", 1, PREFIX_DIGITS))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    A rule fits its host and all subdomains when the path starts with the
    rule's. The longest rule (host and path together, then host) wins; of equal
    rules, block wins. Without one, ``rule`` is null and ``verdict`` is
    ``default``. A null URL, or one without ``://``, has an empty host and
    path and fits no rule. Repeated rows stay; columns of ``pages`` that clash
    with the four are replaced.
    """
    rules = rules.where("host <> ''").select("verdict", ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    shapes = rules.select((F.length("host") - F.length(F.replace("host", F.lit("."))) + 1).alias("labels"), F.length("path").alias("chars")).distinct().limit(MAX_SHAPES + 1).collect()
    if len(shapes) > MAX_SHAPES:
        raise ValueError("the rules have too many distinct label counts and path lengths")

    # Each distinct URL is judged once, so a hot one costs no more than others.
    urls = pages.select(F.col(url).alias("_url")).where("_url is not null").distinct()
    parts = urls.select("_url", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"))
    n_labels = F.length("_host") - F.length(F.replace("_host", F.lit("."))) + 1
    expressions = [
        F.when((n_labels >= s.labels) & (F.length("_path") >= s.chars), F.struct(F.substring_index("_host", ".", -s.labels).alias("h"), F.substring("_path", 1, s.chars).alias("p")))
        for s in shapes
    ]
    array = F.array(*expressions) if expressions else F.array().cast("array<struct<h:string,p:string>>")
    expanded = parts.select("_url", F.explode(F.filter(array, lambda x: x.isNotNull())).alias("x")).select("_url", "x.h", "x.p")

    table = _digest(rules, "host", "path").select("_prefix", F.col("_digest").alias("_rule_digest"), "verdict", "host", "path")
    hits = _digest(expanded, "h", "p").join(table, "_prefix").where("_digest = _rule_digest")
    rank = F.struct(
        (F.length("host") + F.length("path")).alias("length"),
        F.length("host").alias("host_length"),
        (F.col("verdict") == "block").alias("block"),
        F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("verdict"),
    )
    best = hits.groupBy("_url").agg(F.max(rank).alias("_best"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = pages.join(best, pages[url] == best["_url"], "left")
    return judged.select(
        *[pages[c] for c in kept],
        F.coalesce(host_of(pages[url]), F.lit("")).alias("host"),
        F.coalesce(path_of(pages[url]), F.lit("")).alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
