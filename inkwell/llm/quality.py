"""Quality rules with risk-controlled cutoffs.

Fixed base rules reject first. Beyond them each stratum (language) gets a
cutoff of its own on one score, the worst of five signals in thousandths:
labelled documents are the holdout, and a cutoff is used only if the exact
(Clopper-Pearson) upper bound on the share of good documents that it rejects
stays within the allowed risk. The cutoffs of a stratum are tested from the
mildest on, ending at the first that fails (fixed sequence, so a grid costs no
correction); strata are corrected for by Bonferroni. Of those that pass the one
is used that parts labelled bad from good documents best (the greatest
difference of their rejected shares; of equals the mildest).

One score, for a cutoff on each of five would divide the risk and the level by
five, and a stratum would need 1,149 good labels for any; here it needs 149 if
it is alone and 217 if it is one of four.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.spans import let

from .common import hinted, words, written

#: Signals, each in thousandths, and the cutoffs that may be chosen, mildest first.
GRID = (950, 900, 800, 700, 600, 500, 400, 300, 200, 150, 100)
SIGNALS = {
    "symbols": "1000 * n_symbols div greatest(1, n_words)",
    "dup_lines": "1000 * n_dup_lines div greatest(1, n_lines)",
    "repeats": "1000 * n_repeat_words div greatest(1, n_words)",
    "upper": "1000 * n_upper div greatest(1, word_chars)",
    "short_words": "1000 - least(1000, 200 * word_chars div greatest(1, n_words))",
}
#: What the cutoffs apply to.
SCORE = f"greatest({', '.join(SIGNALS.values())})"
RISK, DELTA = 0.02, 0.05
WINDOW = 5


def _repeat_words(ws: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("i")))
        again = let(
            pairs,
            lambda s: F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))),
        )
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        gaps = let(starts, lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), x - F.coalesce(F.get(p, k - 1), x - WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - WINDOW + 1), lambda i: F.xxhash64(*[F.element_at(ws, i + k) for k in range(WINDOW)]))
    return F.when(F.size(ws) > WINDOW, let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))).otherwise(0)


def signals(text: Column) -> Column:
    """One struct of counts for a text; for a null text all are zero."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    by_word = let(
        words(text),
        lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), _repeat_words(ws).cast("long").alias("n_repeat_words")),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(
        by_word.alias("w"),
        by_line.alias("l"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, "[^A-Z]++", "")).cast("long").alias("n_upper"),
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with the counts that the rules use as columns."""
    got = docs.withColumn("_s", signals(F.col(text)))
    flat = {"n_words": "_s.w.n_words", "word_chars": "_s.w.word_chars", "n_symbols": "_s.n_symbols", "n_dup_lines": "_s.l.n_dup_lines", "n_repeat_words": "_s.w.n_repeat_words", "n_lines": "_s.l.n_lines", "n_upper": "_s.n_upper"}
    return got.withColumns({k: F.col(v) for k, v in flat.items()}).drop("_s")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials with chance p, summed from logarithms."""
    if k >= n:
        return 1.0
    of = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    if k > n * p:  # the bound can't hold; no need for the sum
        return 1.0
    return math.fsum(math.exp(of(i)) for i in range(k + 1))


def certified(k: int, n: int, risk: float, delta: float) -> bool:
    """Whether the exact upper bound at level ``delta`` on k of n is at most ``risk``."""
    return n > 0 and binomial_tail(k, n, risk) <= delta


def _log_gamma(z: Column) -> Column:
    """Stirling's series eight places up; below 1e-12 off for z >= 1."""
    up = z + 8
    shift = sum((F.log(z + i) for i in range(8)), F.lit(0.0))
    series = 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5) - 1 / (1680 * up**7)
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + series - shift


def certified_column(k: Column, n: Column, risk: float, level: Column) -> Column:
    """``certified`` as an expression. The tail is summed from its largest term
    down; what lies nine standard deviations below adds nothing to a double."""
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(risk) + (n - k) * math.log1p(-risk))
    terms = F.least(k, F.ceil(9 * F.sqrt(n * risk)) + 20).cast("int")
    odds = (1 - risk) / risk

    def step(a: Column, i: Column) -> Column:
        j = k - i + 1
        term = a["term"] * j / (n - j + 1) * odds
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    total = F.when(terms < 1, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), terms)), one, step, lambda a: a["total"]))
    return F.coalesce((n > 0) & (k <= n * risk) & (top * total <= level), F.lit(False))


def least_good(risk: float = RISK, delta: float = DELTA) -> int:
    """Good labels without which no cutoff can be certified, were a stratum alone."""
    return math.ceil(math.log(delta) / math.log1p(-risk))


def cutoff_table(measures: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA, key: str = "doc_id") -> DataFrame:
    """(stratum, cutoff) for all strata with one.

    ``labels`` has ``key`` and ``quality`` (1: good); repeated labels of a
    document count once, as good if any says so, and null ones don't count.
    Where no labelled bad document shows a cutoff rejects more bad than good
    there is none. Documents that the base rules reject aren't part of the
    holdout. Any number of strata is corrected for and gets its cutoffs; their
    number is all that reaches the driver.
    """
    marks = labels.groupBy(key).agg((F.max("quality") == 1).alias("_good")).where("_good is not null")
    held = measures.where(~base_failed()).join(marks, key).withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    counts = {f"at_{c}_{g}": F.count_if((F.col("_score") >= c) & (F.col("_good") == bool(g))) for c in GRID for g in (0, 1)}
    per = held.withColumn("_score", F.expr(SCORE)).groupBy("_stratum").agg(F.count_if("_good").alias("n"), F.count_if(~F.col("_good")).alias("n_bad"), *[v.alias(k) for k, v in counts.items()])
    per = written(per.where(F.col("n") >= least_good(risk, delta)), "strata")
    level = F.lit(delta / max(1, per.count()))
    grid = F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"at_{c}_1").alias("good"), F.col(f"at_{c}_0").alias("bad")) for c in GRID])
    # What is gained by a cutoff, times both numbers of labels: a whole number.
    gain = lambda x: x["bad"] * F.col("n") - x["good"] * F.col("n_bad")
    tested = F.transform(grid, lambda x: F.struct(gain(x).alias("gain"), x["cutoff"].alias("cutoff"), certified_column(x["good"], F.col("n"), risk, level).alias("ok")))

    def best(x: Column) -> Column:
        # Fixed sequence: up to the first that fails.
        usable = F.slice(x, F.lit(1), F.coalesce(F.nullif(F.array_position(F.transform(x, lambda y: y["ok"]), False), F.lit(0)).cast("int") - 1, F.lit(len(GRID))))
        return F.array_max(F.filter(usable, lambda y: y["gain"] > 0))["cutoff"]

    return per.select(F.col("_stratum").alias("stratum"), let(tested, best).cast("int").alias("cutoff")).where("cutoff is not null")


def choose_cutoffs(measures: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA, key: str = "doc_id") -> list[tuple[str, int]]:
    """``cutoff_table`` as (stratum, cutoff), for a look at a few strata."""
    return [tuple(r) for r in cutoff_table(measures, labels, stratum, risk, delta, key).orderBy("stratum").collect()]


def with_rejects(measured_rows: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured_rows`` with ``_rejected``: whether the certified cutoff of the
    row's stratum is reached. The cutoffs are one short row for each stratum,
    broadcast only after they were counted and found few."""
    table = hinted(cutoffs.select(F.col("stratum").alias("_stratum"), F.col("cutoff").alias("_cutoff")))
    rows = measured_rows.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit(""))).join(table, "_stratum", "left")
    return rows.withColumn("_rejected", F.coalesce(F.expr(SCORE) >= F.col("_cutoff"), F.lit(False))).drop("_stratum", "_cutoff")


def judge_quality(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", key: str = "doc_id", risk: float = RISK, delta: float = DELTA, carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row, without its text but
    with the columns in ``carry``.

    Texts are read once: the counts are written to the shared folder, the
    cutoffs come from there. Null and empty texts have no words and fail; a
    null stratum is the stratum ''; empty labels certify nothing, so that only
    the base rules reject. Repeated rows are judged alike.
    """
    own = docs.select(F.col(key), F.col(stratum), *carry, F.col(text).alias("_text"))
    measures = written(measured(own, "_text").drop("_text"), "quality")
    cutoffs = written(cutoff_table(measures, labels, stratum, risk, delta, key), "cutoffs")
    judged = with_rejects(measures.withColumn("base_failed", base_failed()), cutoffs, stratum)
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("_rejected")).drop("_rejected")
