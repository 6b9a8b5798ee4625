"""Usage accounting: attempts, reports, totals, periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcomes that end an attempt; a started one has none yet.
TERMINAL = ("completed", "failed", "cancelled")
#: Every character that Unicode calls white space.
_BLANK = r"^\p{IsWhite_Space}*$"


def summary(attempts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Attempts, known cost, attempts of unknown cost, and the latest attempt's
    cost, which is null when it is unknown."""
    latest = F.max_by(F.struct("cost_nanos"), F.struct("attempted_at", "attempt_id"))
    return attempts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempts"), F.coalesce(F.sum("cost_nanos"), F.lit(0)).cast("bigint").alias("known_nanos"),
        F.count_if(F.col("cost_nanos").isNull()).alias("unknown"), latest["cost_nanos"].alias("latest_nanos"),
    )


def reports_created(reports: DataFrame, condition: Column | None = None) -> DataFrame:
    """How many reports have a first completion (in a period)."""
    done = reports.where(F.col("first_completed_at").isNotNull())
    return (done if condition is None else done.where(condition)).agg(F.count(F.lit(1)).alias("reports"))


def average_nanos(known: Column, unknown: Column, reports: Column) -> Column:
    """Null without reports, or while any cost is unknown."""
    return F.when((reports > 0) & (unknown == 0), known / reports)


def first_completed(events: DataFrame) -> DataFrame:
    """First completion of each report."""
    return events.groupBy("report_id").agg(F.min(F.when(F.col("outcome") == "completed", F.col("at"))).alias("first_completed_at"))


def lifecycle(events: DataFrame) -> DataFrame:
    """One row for each attempt from its events: the first terminal event
    counts, later ones are ignored; the price is that of the start."""
    end = F.min_by(F.struct("outcome", "cost_nanos"), F.when(F.col("outcome").isin(*TERMINAL), F.struct("at", "seq")))
    start = F.min_by(F.struct("model", "at"), F.when(F.col("outcome") == "started", F.struct("at", "seq")))
    ended = F.max(F.col("outcome").isin(*TERMINAL))
    rows = events.groupBy("attempt_id").agg(start.alias("s"), end.alias("e"), ended.alias("_ended"))
    return rows.select("attempt_id", "s.model", F.col("s.at").alias("attempted_at"), F.when(F.col("_ended"), F.col("e.outcome")).otherwise("started").alias("outcome"), F.when(F.col("_ended"), F.col("e.cost_nanos")).alias("cost_nanos"))


RESPONSE = "status string, model string, service_tier string, output array<struct<type:string,content:array<struct<type:string,text:string>>>>, usage struct<input_tokens:bigint,output_tokens:bigint,input_tokens_details:struct<cached_tokens:bigint,cache_write_tokens:bigint>>"


def parse_responses(responses: DataFrame, body: str = "body", model: str = "model", cancelled: str | None = None) -> DataFrame:
    """Text and usage of each provider response. The text is that of all output
    parts, by lines, of a completed response that wasn't ``cancelled`` (a
    boolean column) meanwhile, and null if it is blank. Usage counts only for
    the ``model`` that was asked for, in the default service tier; it is null
    when a part of it is missing, when cache writes were billed, or when the
    counts can't be."""
    r = responses.withColumn("_r", F.from_json(F.col(body), RESPONSE))
    parts = F.flatten(F.transform(F.coalesce("_r.output", F.array()), lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    text = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "output_text"), lambda p: p["text"]), "\n")
    u = F.col("_r.usage")
    i, c, o = u["input_tokens"], u["input_tokens_details"]["cached_tokens"], u["output_tokens"]
    priced = F.coalesce(F.col("_r.model") == F.col(model), F.lit(False)) & F.coalesce(F.col("_r.service_tier") == "default", F.lit(True))
    ok = priced & i.isNotNull() & c.isNotNull() & o.isNotNull() & (F.coalesce(u["input_tokens_details"]["cache_write_tokens"], F.lit(0)) == 0) & (c <= i) & (c >= 0) & (o >= 0)
    done = F.coalesce(F.col("_r.status") == "completed", F.lit(False)) & (F.lit(True) if cancelled is None else ~F.coalesce(F.col(cancelled), F.lit(False)))
    return r.select(*responses.columns, F.when(done & ~text.rlike(_BLANK), text).alias("text"), *[F.when(ok, x).alias(n) for n, x in (("input_tokens", i), ("cached_tokens", c), ("output_tokens", o))])


def month_of(at: Column) -> Column:
    """First day of the calendar month in the session's time zone."""
    return F.date_trunc("month", F.timestamp_seconds(at)).cast("date")


def currency(nanos: Column) -> Column:
    """Dollars with two to nine decimals; null stays null."""
    text = F.concat((F.floor(nanos / 1_000_000_000)).cast("string"), F.lit("."), F.rtrim(F.lpad((nanos % 1_000_000_000).cast("string"), 9, "0"), F.lit("0")))
    decimals = F.length(F.substring_index(text, ".", -1))
    return F.concat(F.lit("$"), text, F.repeat(F.lit("0"), F.greatest(F.lit(0), 2 - decimals)))
