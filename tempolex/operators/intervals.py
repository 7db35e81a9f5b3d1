"""Continuous periods and gaps of many intervals per entity.

Starts and ends are sorted independently of each other. With starts S1 <= S2 <= ... and ends E1 <= E2 <= ...
there is a gap behind rank i exactly where S(i+1) > E(i); the boundaries between two such ranks pair up to one
continuous period. Equal dates of an entity share one row that carries their number, so the two rank sequences
are held run-length encoded: an entity has at most as many rows as there are calendar days in its data, however
many of the intervals it owns, and the counts are combined before the shuffle. A hot entity is therefore bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN = "9999-12-31"


def boundaries(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """(keys, _day, _starts, _ends): how many intervals begin and how many end on each day.

    An interval without start, or with an end not after its start, covers nothing. A null end is open.
    """
    last = F.coalesce(F.col(end), F.lit(OPEN).cast("date"))
    valid = df.where(F.col(start).isNotNull() & (F.col(start) < last))
    return (
        valid.select(
            *keys,
            F.explode(F.array(F.struct(F.col(start).alias("d"), F.lit(1).alias("s")), F.struct(last.alias("d"), F.lit(0).alias("s")))).alias("_e"),
        )
        .groupBy(*keys, F.col("_e.d").alias("_day"))
        .agg(F.sum("_e.s").cast("bigint").alias("_starts"), F.sum(1 - F.col("_e.s")).cast("bigint").alias("_ends"))
    )


def coverage(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Periods and gaps of each entity: (keys, kind, date_from, date_to, deepest).

    kind is 'period' (date_to exclusive, null when open) or 'gap'. deepest is the largest number of intervals
    that hold on one day of the period, 0 for gaps. Touching and overlapping intervals are one period.
    Empty input gives no rows; repeated intervals count as often as they occur; null keys are an entity of their own.
    """
    by_day = Window.partitionBy(*keys).orderBy("_day")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        boundaries(df, keys, start, end)
        .withColumn("_s", F.sum("_starts").over(so_far))  # rank reached in the sorted starts
        .withColumn("_e", F.sum("_ends").over(so_far))  # rank reached in the sorted ends
        # ranks meet: every start so far is paired with an end, the next start is later
        .withColumn("_breaks", F.when(F.col("_s") == F.col("_e"), 1).otherwise(0))
        .withColumn("_period", F.sum("_breaks").over(so_far) - F.col("_breaks"))
    )
    periods = ranked.groupBy(*keys, "_period").agg(
        F.min("_day").alias("_from"), F.max("_day").alias("_to"), F.max(F.col("_s") - F.col("_e")).alias("_deepest")
    )
    following = F.lead("_from").over(Window.partitionBy(*keys).orderBy("_from"))
    rows = periods.withColumn("_next", following).select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.lit("period").alias("kind"), F.col("_from").alias("date_from"), F.nullif(F.col("_to"), F.lit(OPEN).cast("date")).alias("date_to"), F.col("_deepest").alias("deepest")),
                F.struct(F.lit("gap").alias("kind"), F.col("_to").alias("date_from"), F.col("_next").alias("date_to"), F.lit(0).cast("bigint").alias("deepest")),
            )
        ),
    )
    return rows.where((F.col("kind") == "period") | (F.col("date_to").isNotNull()))
