"""Summaries of recorded calls: outcomes, refusals, nearest-rank percentiles, citation statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A tool with fewer calls has thin figures; this many recent calls are shown.
THIN, RECENT = 20, 25


def events(df: DataFrame) -> DataFrame:
    """One row per event_id; a null outcome or tool reads 'unknown', a null duration 0. Repeated rows are equal, so any may stay."""
    return df.dropDuplicates(["event_id"]).withColumns({"outcome": F.coalesce("outcome", F.lit("unknown")), "tool": F.coalesce("tool", F.lit("unknown")), "ms": F.coalesce("ms", F.lit(0.0))})


def nearest_rank(fraction: float, n: Column) -> Column:
    """1-based rank of a percentile: half-even rounding, no interpolation."""
    return F.least(n, F.greatest(F.lit(1), F.bround(F.lit(fraction) * n + F.lit(0.5)).cast("bigint")))


def percentiles(df: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """(by, one column per fraction): equal values share a row with their count before anything is ordered,
    so the window runs over distinct values and a hot group stays small."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    placed = counts.withColumn("_upto", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    return placed.groupBy(*by).agg(*[F.min(F.when(F.col("_upto") >= nearest_rank(f, F.col("_n")), F.col(value))).alias(name) for name, f in fractions.items()])


def by_tool(df: DataFrame) -> DataFrame:
    """(tool, calls, ok, refused, rejected, errors, refusal_rate, thin, longest) of events."""
    is_ = lambda o: F.col("outcome") == o
    known = F.col("outcome").isin("ok", "refused", "rejected")
    tally = df.groupBy("tool").agg(
        F.count("*").alias("calls"), F.count_if(is_("ok")).alias("ok"), F.count_if(is_("refused") | F.coalesce("refused", F.lit(False))).alias("refused"),
        F.count_if(is_("rejected")).alias("rejected"), F.count_if(~known).alias("errors"), F.max("ms").alias("longest"),
    )
    return tally.withColumns({"refusal_rate": F.round(F.col("refused") / F.col("calls"), 3), "thin": F.col("calls") < THIN})


def overall(df: DataFrame) -> DataFrame:
    """One row: (calls, first_at, last_at, refused, refusal_rate, p50, p95, longest, sample) of all events; sample is true or false where all agree, else null."""
    tally = df.agg(
        F.count("*").alias("calls"), F.min("at_s").alias("first_at"), F.max("at_s").alias("last_at"), F.count_if(F.coalesce("refused", F.lit(False))).alias("refused"), F.max("ms").alias("longest"),
        F.when(F.every(F.coalesce("is_sample", F.lit(False))), True).when(~F.some(F.coalesce("is_sample", F.lit(False))), False).alias("sample"),
    )
    ranks = percentiles(df.withColumn("_all", F.lit(1)), ["_all"], "ms", {"p50": 0.5, "p95": 0.95})
    rate = F.when(F.col("calls") > 0, F.round(F.col("refused") / F.col("calls"), 3))
    return tally.withColumns({"refusal_rate": rate, "_all": F.lit(1)}).join(ranks, "_all", "left").drop("_all")


def result_statuses(results: DataFrame, call_id: str, status: str) -> DataFrame:
    """(call_id, statuses): of each call, how often each status stands in its result."""
    counted = results.where(F.col(status).isNotNull()).groupBy(call_id, status).agg(F.count("*").alias("n"))
    return counted.groupBy(call_id).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(status), "n")))).alias("statuses"))


def status_counts(df: DataFrame) -> DataFrame:
    """(status, n): citation statuses summed over the maps of all events."""
    return df.select(F.explode("statuses").alias("status", "n")).groupBy("status").agg(F.sum("n").alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def recent(df: DataFrame, n: int = RECENT) -> DataFrame:
    """The last n events, a bounded top-k."""
    return df.orderBy(F.desc("at_s"), F.desc("event_id")).limit(n)
