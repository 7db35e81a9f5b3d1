"""Amendments applied to a table of versions, many at once.

An amendment is (key, action, on, by, heading, text, manner) with action substitute, repeal or insert. Those of one
key chain in the order of their dates: each is judged against what the one before it left. Refused amendments come
out beside the new table and change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempolex.functions.citations import extractor


def provision_named(text: str, keys: list[str]) -> str:
    """The key of the one whole provision a text names, or an error: no statutory citation, no Act, or a subdivision."""
    found = [c for c in extractor(tuple(sorted(keys))).locate(text) if c.kind == "statutory"]
    if not found:
        raise ValueError(f"no statutory citation in {text!r}")
    if not found[0].statute:
        raise ValueError(f"{text!r} names no Act")
    if "(" in found[0].provision:
        raise ValueError(f"{text!r} is a subdivision: amend the whole provision")
    return found[0].key()


def judged(versions: DataFrame, amendments: DataFrame) -> DataFrame:
    """Adds refusal ('' if accepted) and opens_from, the start of the version the amendment closes.

    State machine per key: an amendment finds a live version if the one before it (or the table) left one. A refused one leaves
    the state as it was, so the state is folded over the key's amendments, which are few, in one array.
    """
    live = versions.where("in_force_to is null").groupBy("key").agg(F.max("in_force_from").alias("live_from"))
    item = F.struct("on", "amendment_id", "action")  # texts stay out of the chains
    chains = amendments.groupBy("key").agg(F.array_sort(F.collect_list(item)).alias("chain")).join(live, "key", "left")
    start = F.struct(F.col("live_from").alias("live"), F.array().cast("array<struct<id:bigint,refusal:string,closes:date,heir:boolean>>").alias("out"))

    def step(s, a):
        opens = a["action"] == "insert"
        refusal = (
            F.when(a["on"].isNull(), "no date")
            .when(opens & s["live"].isNotNull(), "already in force")
            .when(~opens & s["live"].isNull(), "no version in force")
            .when(~opens & (a["on"] <= s["live"]), "ends before it begins")
            .otherwise("")
        )
        after = F.when(refusal != "", s["live"]).when(a["action"] == "repeal", F.lit(None).cast("date")).otherwise(a["on"])
        row = F.struct(a["amendment_id"].alias("id"), refusal.alias("refusal"), F.when((refusal == "") & ~opens, s["live"]).alias("closes"), ((refusal == "") & (a["action"] != "repeal")).alias("heir"))
        return F.struct(after.alias("live"), F.concat(s["out"], F.array(row)).alias("out"))

    verdicts = chains.select("key", F.explode(F.aggregate("chain", start, step)["out"]).alias("v"))
    return amendments.join(verdicts.select("key", F.col("v.id").alias("amendment_id"), F.col("v.refusal").alias("refusal"), F.col("v.closes").alias("closes"), F.col("v.heir").alias("heir")), ["key", "amendment_id"])


def apply(versions: DataFrame, amendments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions after all accepted amendments, refused amendments)."""
    verdict = judged(versions, amendments)
    accepted, refused = verdict.where("refusal = ''"), verdict.where("refusal <> ''")
    manner = F.when(F.col("action") == "substitute", "substituted").otherwise(F.coalesce("manner", F.lit("repealed")))
    successor = F.when(F.col("action") == "substitute", F.concat_ws(" ", F.col("key"), F.lit("as substituted"), F.date_format("on", "yyyy-MM-dd"))).otherwise("")
    closing = accepted.where("closes is not null").select("key", F.col("closes").alias("in_force_from"), F.col("on").alias("_on"), F.col("by").alias("_by"), manner.alias("_manner"), successor.alias("_heir"))
    heirs = accepted.where("heir")
    w = Window.partitionBy("key").orderBy("in_force_from")
    old = versions.select("key", "heading", "text", "in_force_from", "in_force_to", "manner", "amended_by", "enacted_by", "superseded_by")
    new = heirs.select("key", "heading", "text", F.col("on").alias("in_force_from"), F.lit(None).cast("date").alias("in_force_to"), F.lit("").alias("manner"), F.lit("").alias("amended_by"), F.col("by").alias("enacted_by"), F.lit("").alias("superseded_by"))
    rows = old.unionByName(new).withColumn("heading", F.coalesce("heading", F.last("heading", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit("")))
    closed = F.col("_on").isNotNull() & F.col("in_force_to").isNull()
    after = rows.join(closing, ["key", "in_force_from"], "left").select(
        "key", "heading", "text", "in_force_from", F.when(closed, F.col("_on")).otherwise(F.col("in_force_to")).alias("in_force_to"),
        *[F.when(closed, F.col(n)).otherwise(F.col(o)).alias(o) for o, n in (("manner", "_manner"), ("amended_by", "_by"), ("superseded_by", "_heir"))], "enacted_by",
    )
    return after, refused
