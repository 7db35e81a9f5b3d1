"""From the raw texts of Acts to dated provisions: clean, date, split, drop what ran away, date the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempolex.functions.acts import assent_date, ended, repealed_on, title_year, unique_keys, without_annotations
from tempolex.sources.cleaning import cleaned
from tempolex.sources.splitting import split_acts

# A body longer than this ran away; an Act of which this share ran away is left out.
RUNAWAY, MOST_RUNAWAY = 60_000, 0.5


def one_of_a_name(acts: DataFrame) -> DataFrame:
    """Acts (act_id, title, ...) with name, the title without notes; of several of a name the one whose title speaks of its repeal, else the first title."""
    named = acts.withColumn("name", without_annotations(F.col("title")))
    first = Window.partitionBy(F.lower("name")).orderBy(F.desc(F.col("title") != F.col("name")), "title", "act_id")
    return named.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def provisions(acts: DataFrame, last_year: int, unit: str = "section") -> tuple[DataFrame, DataFrame]:
    """(provisions, reasons) of acts (act_id, title, text): dated rows of every Act that can be read, and why others are left out.

    An Act begins on its date of assent, else on 1 January of the last year its title names, which is then no known
    start. Its end comes from what its title says of a repeal. Provisions that were omitted stay out, those that ran
    away too; an Act without a date, without provisions, or of which half ran away is named in reasons (act_id, reason).
    """
    one = one_of_a_name(acts.select(F.col("act_id").cast("bigint").alias("act_id"), "title", "text"))
    text = cleaned(one, "act_id", "text").select("act_id", "clean")
    on, exact = repealed_on(F.when(F.col("title") != F.col("name"), F.col("title")), last_year)
    assent = assent_date(F.col("clean"))
    year = F.try_to_date(F.concat(title_year(F.col("name")).cast("string"), F.lit("-01-01")), "yyyy-MM-dd")
    dated = one.drop("text").join(text, "act_id").select("act_id", "name", "clean", F.coalesce(assent, year).alias("begins_on"), assent.isNotNull().alias("start_known"), on.alias("_on"), exact.alias("_exact"))
    split = split_acts(dated.where("begins_on is not null"), "act_id", "clean").where("note <> 'omitted'").withColumn("ran_away", F.length("text") > RUNAWAY)
    tally = split.groupBy("act_id").agg(F.count("*").alias("n"), F.count_if("ran_away").alias("away"))
    judged = dated.select("act_id", "begins_on").join(tally, "act_id", "left")
    reason = F.when(F.col("begins_on").isNull(), "no date").when(F.coalesce("n", F.lit(0)) == 0, "no provisions").when(F.col("away") >= MOST_RUNAWAY * F.col("n"), "runs away")
    reasons = judged.select("act_id", reason.alias("reason")).where("reason is not null")
    keyed = unique_keys(dated.select("act_id", "name"), "name").select("act_id", F.col("act_key").alias("statute"))
    good = dated.drop("clean").join(reasons, "act_id", "left_anti").join(keyed, "act_id")
    rows = split.where("not ran_away").select("act_id", "seq", "number", "heading", "text", "chapter").join(good, "act_id")
    ends_on, end_exact = ended(F.col("begins_on"), F.col("_on"), F.col("_exact"))
    return rows.select(
        "act_id", "seq", "statute", F.lit(unit).alias("unit"), "number", "heading", "text", "chapter", F.col("begins_on").alias("in_force_from"), ends_on.alias("in_force_to"),
        "start_known", F.when(F.col("_on").isNotNull(), end_exact).alias("end_known"), F.when(F.col("_on").isNotNull(), "repealed").otherwise("").alias("manner"), F.col("name").alias("source"),
    ), reasons
