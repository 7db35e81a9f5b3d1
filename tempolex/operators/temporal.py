"""Valid-time operators: half-open periods [in_force_from, in_force_to), null end = still in force.

Every function takes and returns DataFrames of versions with the columns of `versions`. Point lookups always carry
the key, so that they plan as equi-joins with the period as residual condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempolex.functions.keys import canonical_key

KEY = ["statute", "unit", "number"]
CARRIED = ["heading", "text", "in_force_from", "in_force_to", "superseded_by", "manner", "amended_by", "enacted_by", "start_known", "end_known"]
TEXTUAL = ["superseded_by", "manner", "amended_by", "enacted_by"]


def records(corpus: DataFrame, columns: list[str] = CARRIED) -> DataFrame:
    """One row per version_id, the last delivery, with its canonical key; null optional strings read ''."""
    last = F.max(F.struct("loaded_at", *KEY, *columns))
    one = corpus.select("version_id", "loaded_at", *canonical_key(), *columns).groupBy("version_id").agg(last.alias("r"))
    out = one.select("version_id", *[F.col(f"r.{c}") for c in [*KEY, *columns]])
    out = out.withColumns({c: F.coalesce(c, F.lit("")) for c in TEXTUAL if c in columns})
    return out.withColumn("key", F.concat_ws(":", *[F.coalesce(k, F.lit("")) for k in KEY]))


def versions(corpus: DataFrame, columns: list[str] = CARRIED) -> DataFrame:
    """The records whose period covers at least one day."""
    return records(corpus, columns).where("in_force_from is not null and (in_force_to is null or in_force_to > in_force_from)")


def in_force(day: Column) -> Column:
    """The boundary day belongs to the version that begins on it."""
    return (F.col("in_force_from") <= day) & (F.col("in_force_to").isNull() | (day < F.col("in_force_to")))


def as_of(df: DataFrame, day: str) -> DataFrame:
    return df.where(in_force(F.lit(day).cast("date")))


def oldest_first() -> Window:
    return Window.partitionBy("key").orderBy("in_force_from", "version_id")


def ranked(df: DataFrame) -> DataFrame:
    """Adds version_rank, counted oldest first within the key."""
    return df.withColumn("version_rank", F.row_number().over(oldest_first()))


def current(df: DataFrame) -> DataFrame:
    """The first version of each key that is still in force."""
    first = F.min(F.struct("in_force_from", "version_id"))
    return df.where("in_force_to is null").groupBy("key").agg(first.alias("f")).select("key", "f.version_id")


def point_lookup(asked: DataFrame, df: DataFrame, day: str = "as_of") -> DataFrame:
    """asked (key, day, ...) left-joined with the version of the key in force on the day."""
    held = df.select(F.col("key").alias("_k"), "version_id", "in_force_from", "in_force_to")
    return asked.join(held, (F.col("key") == F.col("_k")) & in_force(F.col(day)), "left").drop("_k", "in_force_from", "in_force_to")


def nearest(asked: DataFrame, ask_id: str, df: DataFrame, day: str = "as_of") -> DataFrame:
    """(ask_id, version_id): the latest version begun by the day, else the first of the key. Two aggregates, no window."""
    held = asked.join(df.select("key", "version_id", "in_force_from"), "key")
    stamp, begun = F.struct("in_force_from", "version_id"), F.col("in_force_from") <= F.col(day)
    best = held.groupBy(ask_id).agg(F.max(F.when(begun, stamp)).alias("x"), F.min(stamp).alias("y"))
    return best.select(ask_id, F.coalesce("x", "y").getField("version_id").alias("version_id"))


def status_note(day: Column) -> Column:
    """'' while in force; else why not: unknown before the record, not yet, ceased, or ceased at the earliest on a date."""
    ends = F.date_format("in_force_to", "yyyy-MM-dd")
    see = F.when(F.col("superseded_by") != "", F.concat(F.lit("; see "), F.col("superseded_by"))).otherwise("")
    manner = F.when(F.col("manner") != "", F.col("manner")).otherwise("ceased")
    return (
        F.when(in_force(day), "")
        .when((day < F.col("in_force_from")) & ~F.coalesce("start_known", F.lit(True)), F.concat(F.lit("before the record, which begins "), F.date_format("in_force_from", "yyyy-MM-dd")))
        .when(day < F.col("in_force_from"), F.concat(F.lit("not in force until "), F.date_format("in_force_from", "yyyy-MM-dd")))
        .when(F.coalesce("end_known", F.lit(True)), F.concat(manner, F.lit(" on "), ends, see))
        .otherwise(F.concat(manner, F.lit(" on or after "), ends, see))
    )


def enclosing(key: Column) -> Column:
    """The key without its trailing bracketed subdivisions."""
    return F.regexp_replace(key, r"(?:\([0-9A-Za-z]+\))+$", "")


def resolve(asked: DataFrame, df: DataFrame) -> DataFrame:
    """Adds resolved: the asked key if held, else its enclosing provision if that is held, else the asked key."""
    held = df.select("key").distinct()
    exact, parent = held.select(F.col("key").alias("_exact")), held.select(F.col("key").alias("_parent"))
    return (
        asked.join(exact, F.col("key") == F.col("_exact"), "left")
        .join(parent, enclosing(F.col("key")) == F.col("_parent"), "left")
        .withColumn("resolved", F.coalesce("_exact", "_parent", "key"))
        .drop("_exact", "_parent")
    )


def problems(df: DataFrame) -> DataFrame:
    """(key, version_id, problem): what is inconsistent between versions of a key, and between record starts of a statute."""
    w = oldest_first()
    seen = df.select(
        "statute", "key", "version_id", "in_force_from", "in_force_to", "enacted_by", F.coalesce("start_known", F.lit(True)).alias("start_known"),
        F.row_number().over(w).alias("n"), F.lead("in_force_from").over(w).alias("next_from"), F.lead("enacted_by").over(w).alias("next_by"),
    )
    found = F.filter(
        F.array(
            F.when(F.col("next_from").isNotNull() & F.col("in_force_to").isNull(), "open version followed by another"),
            F.when(F.col("next_from") < F.col("in_force_to"), "overlaps the next version"),
            F.when((F.col("next_from") > F.col("in_force_to")) & (F.col("next_by") == ""), "gap before the next version"),
            F.when((F.col("n") > 1) & ~F.col("start_known"), "unknown start behind the first version"),
        ),
        lambda p: p.isNotNull(),
    )
    within = seen.select("key", "version_id", F.explode(found).alias("problem"))
    live = df.where("in_force_to is null").groupBy("key").agg(F.count("*").alias("n"), F.min("version_id").alias("version_id"))
    several = live.where("n > 1").select("key", "version_id", F.lit("several live versions").alias("problem"))
    starts = df.where("start_known = false").groupBy("statute").agg(F.count_distinct("in_force_from").alias("n"), F.min("version_id").alias("version_id"))
    mixed = starts.where("n > 1").select(F.col("statute").alias("key"), "version_id", F.lit("several record starts").alias("problem"))
    return within.unionByName(several).unionByName(mixed)


def record_starts(df: DataFrame) -> DataFrame:
    """(statute, recorded_from): the date before which the record of a statute says nothing."""
    return df.where("start_known = false").groupBy("statute").agg(F.max("in_force_from").alias("recorded_from"))


def changes(df: DataFrame, start: str, end: str) -> DataFrame:
    """(changed_on, key, event, instrument, heading) between two dates, both included.

    A version that begins where the one before it ends is one event, 'substituted'. Other first versions are
    'commenced', other later ones 'reinstated'. An end without successor is named by its manner, else 'repealed'.
    """
    w = oldest_first()
    lined = df.select(
        "key", "version_id", "heading", "in_force_from", "in_force_to", "manner", "amended_by", "enacted_by",
        F.row_number().over(w).alias("n"), F.lag("in_force_to").over(w).alias("before"), F.lag("amended_by").over(w).alias("by_before"), F.lead("in_force_from").over(w).alias("after"),
    )
    follows = F.col("before") == F.col("in_force_from")
    begun = F.struct(
        F.col("in_force_from").alias("changed_on"),
        F.when(F.col("n") == 1, "commenced").when(follows, "substituted").otherwise("reinstated").alias("event"),
        F.when(F.col("enacted_by") != "", F.col("enacted_by")).otherwise(F.coalesce(F.when(follows, F.col("by_before")), F.lit(""))).alias("instrument"),
    )
    ended = F.struct(
        F.col("in_force_to").alias("changed_on"),
        F.when(F.col("manner") != "", F.col("manner")).otherwise("repealed").alias("event"),
        F.col("amended_by").alias("instrument"),
    )
    alone = F.col("in_force_to").isNotNull() & ~F.coalesce(F.col("after") == F.col("in_force_to"), F.lit(False))
    return (
        lined.select("key", "version_id", "heading", F.explode(F.filter(F.array(begun, F.when(alone, ended)), lambda e: e.isNotNull())).alias("e"))
        .select("e.changed_on", "key", "version_id", "e.event", "e.instrument", "heading")
        .where(F.col("changed_on").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    )


def provision_order(number: Column) -> list[Column]:
    """Columns that sort 2 < 10 < 10A < 11 and Order IX Rule 3 by order and rule; other numbers last."""
    arabic, suffix = F.regexp_extract(number, r"^(\d+)([A-Z]*)", 1), F.regexp_extract(number, r"^(\d+)([A-Z]*)", 2)
    order, rule = F.regexp_extract(number, r"^([IVXLC]+)/(\d+)$", 1), F.regexp_extract(number, r"^([IVXLC]+)/(\d+)$", 2)
    scheme = F.when(arabic != "", 0).when(order != "", 1).otherwise(2)
    return [
        scheme.alias("order_scheme"),
        F.when(arabic != "", arabic.try_cast("bigint")).when(order != "", roman(order)).otherwise(F.lit(0)).cast("bigint").alias("order_n"),
        F.when(arabic != "", suffix).otherwise("").alias("order_suffix"),
        F.when(order != "", rule.try_cast("bigint")).otherwise(F.lit(0)).cast("bigint").alias("order_rule"),
    ]


def roman(numeral: Column) -> Column:
    """Roman numeral to number: a letter counts against the larger one behind it."""
    values = F.create_map(*[F.lit(x) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in pair])
    each = F.transform(F.split(F.reverse(numeral), ""), lambda c: F.coalesce(F.element_at(values, c), F.lit(0)))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    return F.aggregate(each, start, lambda s, v: F.struct((s["total"] + F.when(v < s["last"], -v).otherwise(v)).alias("total"), v.alias("last")))["total"]


def contents(df: DataFrame, day: str) -> DataFrame:
    """(statute, key, version_id, heading, amended, position): what is in force on a day, in the order of each statute.

    Positions come from the counts of the provisions before: a statute is ordered by its numbers, of which there are far
    fewer than rows, and the rows of one number are ordered among themselves. No task orders a whole statute.
    """
    held = df.groupBy("key").agg(F.count("*").alias("held"))
    live = as_of(df, day).select("statute", "unit", "number", "key", "version_id", "heading").join(held, "key")
    rows = live.select("*", *provision_order(F.col("number")))
    part = ["statute", "unit", "order_scheme", "order_n"]
    ahead = Window.partitionBy("statute").orderBy("unit", "order_scheme", "order_n").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*part).agg(F.count("*").alias("_n")).select(*[F.col(c).alias(f"_{c}") for c in part], F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    same = F.lit(True)
    for c in part:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    within = F.row_number().over(Window.partitionBy(*part).orderBy("order_suffix", "order_rule", "number", "version_id"))
    placed = rows.withColumn("_within", within).join(before, same)
    return placed.select("statute", "key", "version_id", "heading", (F.col("held") > 1).alias("amended"), (F.col("_before") + F.col("_within")).cast("int").alias("position"))


def sequence_within(number: Column) -> Column:
    """(n, suffix): the place a number has in the numbering a later heading would continue: 302A in its own, IX/3 as rule 3; null for others."""
    scheme, n, suffix, rule = [c for c in provision_order(number)]
    return F.when(scheme == 0, F.struct(n.alias("n"), suffix.alias("suffix"))).when(scheme == 1, F.struct(rule.alias("n"), F.lit("").alias("suffix")))


def checked_versions(df: DataFrame) -> DataFrame:
    """The gate before every write: the versions themselves, or an error with the first problems if there are any."""
    found = problems(df).limit(20).collect()
    if found:
        raise ValueError("; ".join(f"{r.key} ({r.version_id}): {r.problem}" for r in found))
    return df


def coverage_warnings(asked: DataFrame, df: DataFrame, as_at: str | None = None, day: str = "as_of") -> DataFrame:
    """asked (statute, day, ...) with each warning: 'before the record' with its first date, 'after the record' if the day is past as_at."""
    early = asked.join(record_starts(df), "statute").where(F.col(day) < F.col("recorded_from")).withColumn("warning", F.lit("before the record")).withColumnRenamed("recorded_from", "limit_on")
    late = asked.withColumns({"limit_on": F.lit(as_at).cast("date"), "warning": F.lit("after the record")}).where(F.col(day) > F.col("limit_on"))
    return early.unionByName(late)


def contents_counts(df: DataFrame, day: str) -> DataFrame:
    """(statute, in_force, not_in_force): keys in force on a day, and keys held but not in force on it."""
    live = F.max(F.when(in_force(F.lit(day).cast("date")), 1).otherwise(0))
    return df.groupBy("statute", "key").agg(live.alias("live")).groupBy("statute").agg(F.sum("live").alias("in_force"), F.sum(1 - F.col("live")).alias("not_in_force"))


def compare_dates(df: DataFrame, before: str, after: str) -> DataFrame:
    """(key, version_before, version_after, begun, instruments, named): the versions on two dates, and what happened in (before, after]; named lists the instruments."""
    a, b = F.lit(before).cast("date"), F.lit(after).cast("date")
    inside = lambda c: (F.col(c) > a) & (F.col(c) <= b)
    return df.groupBy("key").agg(
        F.min(F.when(in_force(a), F.col("version_id"))).alias("version_before"),
        F.min(F.when(in_force(b), F.col("version_id"))).alias("version_after"),
        F.count_if(inside("in_force_from")).alias("begun"),
        F.array_sort(F.collect_set(F.when(inside("in_force_to") & (F.col("amended_by") != ""), F.col("amended_by")))).alias("n"),
    ).select("key", "version_before", "version_after", "begun", F.size("n").cast("bigint").alias("instruments"), F.array_join("n", "; ").alias("named"))


def corpus_info(df: DataFrame) -> DataFrame:
    """(statute, provisions, versions, live, earliest, latest_change, recorded_from) of every statute; recorded_from is null where the record knows every start."""
    return df.groupBy("statute").agg(
        F.count_distinct("key").alias("provisions"), F.count("*").alias("versions"), F.count_if(F.col("in_force_to").isNull()).alias("live"),
        F.min("in_force_from").alias("earliest"), F.max(F.greatest("in_force_from", F.coalesce("in_force_to", "in_force_from"))).alias("latest_change"),
        F.max(F.when(F.col("start_known") == F.lit(False), F.col("in_force_from"))).alias("recorded_from"),
    )


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit - 1 in the given order, with the total and the next offset (null on the last page).

    The page comes from a bounded top-k; only the count covers all rows.
    """
    total = df.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1))
    cut = df.orderBy(*order).offset(offset).limit(limit).withColumn("_one", F.lit(1))
    after = F.when(F.col("total") > offset + limit, F.lit(offset + limit).cast("bigint"))
    return cut.join(total, "_one").drop("_one").withColumn("next_offset", after)


def normalise_number(number: Column) -> Column:
    """'489-f' -> 489F, '20(1)(A)' -> 20(1)(a); what does not begin with a digit is upper-cased."""
    from tempolex.functions.keys import ascii_digits

    n = F.trim(ascii_digits(number))
    part = lambda k: F.regexp_extract(n, r"^(\d+)-?([A-Za-z]*)(.*)$", k)
    return F.when(n.rlike(r"^\d"), F.concat(part(1), F.upper(part(2)), F.lower(part(3)))).otherwise(F.upper(n))


def expand_range(first: Column, last: Column, limit: int = 50) -> Column:
    """Every number of a range of up to limit steps; of a wider or falling one the two ends."""
    a, b = first.cast("int"), last.cast("int")
    return F.when((b >= a) & (b - a <= limit), F.sequence(a, b)).otherwise(F.array(a, b))
