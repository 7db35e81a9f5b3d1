"""History of changing attributes from periodic snapshots, by differencing consecutive snapshots.

Each snapshot is joined with the one before it in a null-safe full outer join on the key; the pairs are
classified as inserted, changed, deleted or equal, the change events are united and lead() over them gives
the period of each version. All consecutive pairs are differenced in one join: the left side is every state,
the right side every state moved to the next snapshot. Texts take part as a digest only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapsed(text: Column) -> Column:
    """Each run of spaces, tabs and line breaks as one space, ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def snapshot_states(df: DataFrame, keys: Sequence[str], snapshot: str, delivered: str, row_id: str, state: Sequence[Column]) -> DataFrame:
    """One row (keys, snapshot, _state, row id) per key and snapshot: the delivery that came last holds.

    Equal delivery times are decided by the larger row id. The choice is a max over a struct, so it is combined
    before the shuffle and a key delivered very often is no hot group. Rows without a snapshot date are left out.
    """
    digest = F.md5(F.to_json(F.struct(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(state)]), {"ignoreNullFields": "false"}))
    last = F.max(F.struct(F.col(delivered).alias("d"), F.col(row_id).alias("r"), F.unhex(digest).alias("s")))
    return (
        df.where(F.col(snapshot).isNotNull())
        .groupBy(*keys, F.col(snapshot).alias("_on"))
        .agg(last.alias("_l"))
        .select(*keys, "_on", F.col("_l.s").alias("_state"), F.col("_l.r").alias("_row"))
    )


def snapshot_dates(df: DataFrame, snapshot: str) -> DataFrame:
    """(_on, _prev_on, _next_on): the calendar of snapshots, one row per distinct date of the whole table."""
    days = df.where(F.col(snapshot).isNotNull()).select(F.col(snapshot).alias("_on")).distinct()
    w = Window.orderBy("_on")
    return days.select("_on", F.lead("_on").over(w).alias("_next_on"))


def change_events(states: DataFrame, dates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _on, change, _row): inserted, changed and deleted keys between consecutive snapshots."""
    at = states.join(dates, "_on")
    cur = at.select(*[F.col(k).alias(f"c_{k}") for k in keys], F.col("_on").alias("c_on"), F.col("_state").alias("c_state"), F.col("_row").alias("c_row"))
    prev = at.where(F.col("_next_on").isNotNull()).select(
        *[F.col(k).alias(f"p_{k}") for k in keys], F.col("_next_on").alias("p_on"), F.col("_state").alias("p_state")
    )
    on = F.col("c_on") == F.col("p_on")
    for k in keys:
        on = on & F.col(f"c_{k}").eqNullSafe(F.col(f"p_{k}"))
    change = (
        F.when(F.col("p_on").isNull(), "inserted").when(F.col("c_on").isNull(), "deleted").when(~F.col("c_state").eqNullSafe(F.col("p_state")), "changed")
    )
    in_cur = F.col("c_on").isNotNull()
    return (
        cur.join(prev, on, "full_outer")
        .select(
            *[F.when(in_cur, F.col(f"c_{k}")).otherwise(F.col(f"p_{k}")).alias(k) for k in keys],
            F.coalesce("c_on", "p_on").alias("_on"), change.alias("change"), F.col("c_row").alias("_row"),
        )
        .where(F.col("change").isNotNull())
    )


def attribute_history(df: DataFrame, keys: Sequence[str], snapshot: str, delivered: str, row_id: str, state: Sequence[Column]) -> DataFrame:
    """(keys, valid_from, valid_to, change, row id): every version of every key with the period it was recorded.

    valid_to is the first snapshot that no longer shows the version, null while the last snapshot shows it.
    The row id names the delivery that first shows the version, so that any attribute can be joined to it.
    A key missing from a snapshot has no version there; empty input gives no rows.
    """
    states = snapshot_states(df, keys, snapshot, delivered, row_id, state)
    events = change_events(states, snapshot_dates(df, snapshot), keys)
    until = F.lead("_on").over(Window.partitionBy(*keys).orderBy("_on"))
    return (
        events.withColumn("_until", until)
        .where(F.col("change") != "deleted")
        .select(*keys, F.col("_on").alias("valid_from"), F.col("_until").alias("valid_to"), "change", F.col("_row").alias(row_id))
    )
