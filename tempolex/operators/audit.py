"""Citations of documents checked against the versions in force on a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempolex.functions.citations import FOREIGN_REPORTS
from tempolex.operators.temporal import enclosing, in_force

# The statuses and what they say about a draft.
PROBLEMS = ["not_in_force", "not_yet_in_force", "unknown_provision"]
REVIEW = ["amended_since"]
UNVERIFIED = ["before_record", "no_act_named", "act_not_recognised", "statute_not_loaded", "not_checkable", "undated"]


def with_default(cited: DataFrame, default: str | Column) -> DataFrame:
    """Bare statutory citations get the default statute, if it is not null; those that name an unknown Act keep it."""
    given = F.lit(default) if isinstance(default, str) else default
    bare = (F.col("kind") == "statutory") & (F.col("statute") == "") & (F.col("named_statute") == "") & given.isNotNull()
    statute = F.when(bare, given).otherwise(F.col("statute"))
    key = F.when(bare, F.concat_ws(":", given, "unit", "provision")).otherwise(F.col("key"))
    return cited.withColumns({"key": key, "statute": statute})


def checked(cited: DataFrame, versions: DataFrame, day: str = "as_of") -> DataFrame:
    """Adds status, checked_as and version_id (the version in force, null without one) to citations (key, kind, statute, named_statute, day).

    Joins carry the key: first what the key holds at all, for the exact provision or, if it is not held, the enclosing
    one, then the version in force; of several that overlap the one that began first counts. A key's versions are reduced to two dates before the join. A citation
    without a day is 'undated' where only the day is missing to check it. Every citation row comes out once.
    """
    span = versions.groupBy("key").agg(
        F.min(F.struct("in_force_from", F.coalesce("start_known", F.lit(True)).alias("known"))).alias("first"), F.max("in_force_from").alias("last_from")
    )
    held = span.select(F.col("key").alias("_held"))
    loaded = versions.select(F.col("statute").alias("_loaded")).distinct()
    placed = cited.join(held, F.col("key") == F.col("_held"), "left").withColumn("_at", F.when(F.col("_held").isNotNull(), F.col("key")).otherwise(enclosing(F.col("key")))).drop("_held")
    asked = placed.select(F.col("_at").alias("_asked"), F.col(day).alias("_day")).where("_day is not null").distinct()
    held_then = versions.select(F.col("key").alias("_k"), "version_id", "in_force_from", "in_force_to")
    live = (
        asked.join(held_then, (F.col("_asked") == F.col("_k")) & in_force(F.col("_day")))
        .groupBy("_asked", "_day")
        .agg(F.min(F.struct("in_force_from", "version_id")).alias("_live"))
    )
    joined = (
        placed.join(span.withColumnRenamed("key", "_key"), F.col("_at") == F.col("_key"), "left")
        .join(loaded, F.col("statute") == F.col("_loaded"), "left")
        .join(live, (F.col("_at") == F.col("_asked")) & (F.col(day) == F.col("_day")), "left")
    )
    status = (
        F.when(F.col("kind") != "statutory", "not_checkable")
        .when((F.col("statute") == "") & (F.col("named_statute") != ""), "act_not_recognised")
        .when(F.col("statute") == "", "no_act_named")
        .when(F.col("_loaded").isNull(), "statute_not_loaded")
        .when(F.col("_key").isNull(), "unknown_provision")
        .when(F.col(day).isNull(), "undated")
        .when(F.col("_live").isNull() & (F.col(day) < F.col("first.in_force_from")) & F.col("first.known"), "not_yet_in_force")
        .when(F.col("_live").isNull() & (F.col(day) < F.col("first.in_force_from")), "before_record")
        .when(F.col("_live").isNull(), "not_in_force")
        .when(F.col("last_from") > F.col(day), "amended_since")
        .otherwise("in_force")
    )
    checked_as = F.when(F.col("_key").isNotNull(), F.col("_at")).otherwise("")
    return joined.select(*cited.columns, status.alias("status"), checked_as.alias("checked_as"), F.when(F.col("kind") == "statutory", F.col("_live.version_id")).alias("version_id"))


def verdicts(checks: DataFrame, doc_id: str, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, citations, distinct_citations, problems, review, unverified, verdict): problems before review before unverified.

    With docs, documents without citations come out too: nothing in them is verified.
    """
    tally = checks.groupBy(doc_id).agg(
        F.count("*").alias("citations"), F.count_distinct("key").alias("distinct_citations"),
        *[F.count_if(F.col("status").isin(g)).alias(n) for n, g in (("problems", PROBLEMS), ("review", REVIEW), ("unverified", UNVERIFIED))],
    )
    verdict = F.when(F.col("problems") > 0, "problems").when(F.col("review") > 0, "review").when(F.col("unverified") > 0, "unverified").otherwise("all_in_force")
    if docs is not None:
        tally = docs.select(doc_id).distinct().join(tally, doc_id, "left").na.fill(0)
        verdict = F.when(F.col("citations") == 0, "unverified").otherwise(verdict)
    return tally.withColumn("verdict", verdict)


def is_foreign(report):
    """Whether a report is one of another country's series, dots and case aside."""
    return F.upper(F.replace(report, F.lit("."), F.lit(""))).isin([r.upper().replace(".", "") for r in FOREIGN_REPORTS])
