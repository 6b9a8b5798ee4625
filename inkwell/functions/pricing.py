"""Model rates and integer costs, in nanodollars. An unknown cost is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Model id, name, nanodollars per input, cached input and output
# token, long-context pricing, reasoning effort.
MODELS = (
    ("gpt-6-luna", "GPT-6 Luna · Lowest cost", 100, 10, 500, True, "none"),
    ("gpt-6-sol", "GPT-6 Sol", 2_000, 200, 10_000, True, "none"),
    ("gpt-6-astra", "GPT-6 Astra", 10_000, 1_000, 50_000, True, "low"),
    ("gpt-5.6-luna", "GPT-5.6 Luna", 200, 20, 1_200, True, "none"),
    ("gpt-5.4-mini-2026-03-17", "GPT-5.4 mini", 750, 75, 4_500, False, "none"),
    ("gpt-4.1-mini-2025-04-14", "GPT-4.1 mini", 400, 100, 1_600, False, None),
    ("gpt-4.1-2025-04-14", "GPT-4.1", 2_000, 500, 8_000, False, None),
)
MODEL_SCHEMA = "model string, model_name string, input_nanos bigint, cached_nanos bigint, output_nanos bigint, long_context boolean, effort string"
LONG_CONTEXT, MAX_INPUT, MAX_OUTPUT, OUTPUT_ALLOWANCE, FRAMING = 272_000, 2_000_000, 100_000, 4_096, 128


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODELS), MODEL_SCHEMA)


def cost_nanos(inputs: Column, cached: Column, outputs: Column) -> Column:
    """Cost from the columns of a joined model row; null for counts that can't
    be, and where the sum doesn't fit."""
    valid = (inputs >= 0) & (cached >= 0) & (outputs >= 0) & (cached <= inputs) & (inputs <= MAX_INPUT) & (outputs <= MAX_OUTPUT)
    long = F.col("long_context") & (inputs > LONG_CONTEXT)
    rate = lambda c: F.when(long, F.try_multiply(F.col(c), F.lit(2))).otherwise(F.col(c))
    out_rate = F.when(long, F.expr("try_multiply(output_nanos, 3L) div 2")).otherwise(F.col("output_nanos"))
    parts = F.try_add(F.try_multiply(inputs - cached, rate("input_nanos")), F.try_multiply(cached, rate("cached_nanos")))
    return F.when(valid, F.try_add(parts, F.try_multiply(outputs, out_rate)))


def estimate_nanos(instructions: Column, text: Column) -> tuple[Column, Column]:
    """Allowance of input tokens by bytes, and the cost to budget for."""
    allowance = (F.octet_length(instructions) + F.octet_length(text) + FRAMING).cast("bigint")
    long = F.col("long_context") & (allowance > LONG_CONTEXT)
    rate = F.when(F.col("long_context"), F.expr("input_nanos * 5 div 4")).otherwise(F.col("input_nanos"))
    output = F.lit(OUTPUT_ALLOWANCE).cast("bigint") * F.col("output_nanos") * F.when(long, 3).otherwise(2)
    return allowance, allowance * rate * F.when(long, 2).otherwise(1) + (output / 2).cast("bigint")
