"""Queries p2 and p5 over the statute tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempolex.functions.keys import canonical_key, iso_date
from tempolex.operators.history import attribute_history, collapsed
from tempolex.operators.intervals import coverage
from tempolex.session import table

KEY = ["statute", "unit", "number"]


def record_periods(corpus: DataFrame) -> DataFrame:
    """One row per record: version_id, canonical key, in_force_from, in_force_to of its last delivery."""
    narrow = corpus.select("version_id", *canonical_key(), "in_force_from", "in_force_to", "loaded_at")
    last = F.max(F.struct("loaded_at", *KEY, "in_force_from", "in_force_to"))
    return narrow.groupBy("version_id").agg(last.alias("r")).select("version_id", *[f"r.{k}" for k in KEY], "r.in_force_from", "r.in_force_to")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = coverage(record_periods(table(spark, sf_dir, "sample_corpus")), KEY, "in_force_from", "in_force_to")
    return spans.where((F.col("kind") == "gap") | (F.col("deepest") >= 2)).select(
        *KEY, "kind", iso_date(F.col("date_from")).alias("date_from"), iso_date(F.col("date_to")).alias("date_to")
    )


def p2_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every continuous period and gap of every provision, with how deep the records overlap."""
    spans = coverage(record_periods(table(spark, sf_dir, "sample_corpus")), KEY, "in_force_from", "in_force_to")
    return spans.select(*KEY, "kind", iso_date(F.col("date_from")).alias("date_from"), iso_date(F.col("date_to")).alias("date_to"), "deepest")


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    snaps = table(spark, sf_dir, "corpus_snapshots")
    keyed = snaps.select(*canonical_key(), "snapshot_row_id", "snapshot_on", "delivered_at", "text", "in_force_from", "in_force_to", "amended_by")
    state = [collapsed(F.col("text")), F.col("in_force_from"), F.col("in_force_to"), F.coalesce("amended_by", F.lit(""))]
    return snaps, attribute_history(keyed, KEY, "snapshot_on", "delivered_at", "snapshot_row_id", state)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, versions = _history(spark, sf_dir)
    return versions.select(*KEY, iso_date(F.col("valid_from")).alias("valid_from"), iso_date(F.col("valid_to")).alias("valid_to"))


def p5_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions with the attributes of the delivery that first shows them."""
    snaps, versions = _history(spark, sf_dir)
    attributes = snaps.select("snapshot_row_id", "text", "in_force_from", "in_force_to", "amended_by")
    return versions.join(attributes, "snapshot_row_id").select(
        *KEY, iso_date(F.col("valid_from")).alias("valid_from"), iso_date(F.col("valid_to")).alias("valid_to"), "change",
        "text", iso_date(F.col("in_force_from")).alias("in_force_from"), iso_date(F.col("in_force_to")).alias("in_force_to"),
        F.coalesce("amended_by", F.lit("")).alias("amended_by"),
    )


#: Canonical key in SQL. Digits of the two Arabic runs occur in the data.
def sql_key(prefix: str = "") -> str:
    space = r"[\s\p{Z}\x{AD}\x{200B}\x{2060}\x{FEFF}]+"
    dash = r"[\s\p{Z}\p{Pd}\x{2212}\x{AD}\x{200B}\x{2060}\x{FEFF}]+"
    return (
        f"upper(regexp_replace({prefix}statute, '^{space}|{space}$', '', 'g')) AS statute, "
        f"lower(regexp_replace({prefix}unit, '^{space}|{space}$', '', 'g')) AS unit, "
        f"upper(regexp_replace(translate({prefix}number, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '{dash}', '', 'g')) AS number"
    )


def _sql_p2(select: str, where: str) -> str:
    return f"""
WITH rec AS (
  SELECT DISTINCT version_id, {sql_key()}, in_force_from AS f, coalesce(in_force_to, DATE '9999-12-31') AS t FROM sample_corpus
), val AS (SELECT * FROM rec WHERE f IS NOT NULL AND f < t),
mark AS (
  SELECT *, CASE WHEN f <= max(t) OVER (PARTITION BY statute, unit, number ORDER BY f, t, version_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM val
), grp AS (
  SELECT *, sum(fresh) OVER (PARTITION BY statute, unit, number ORDER BY f, t, version_id ROWS UNBOUNDED PRECEDING) AS g FROM mark
), per AS (SELECT statute, unit, number, g, min(f) AS a, max(t) AS b FROM grp GROUP BY ALL),
pts AS (SELECT DISTINCT statute, unit, number, g, f AS d FROM grp),
deep AS (
  SELECT p.statute, p.unit, p.number, p.g, max(n) AS deepest FROM (
    SELECT pts.statute, pts.unit, pts.number, pts.g, pts.d, count(*) AS n FROM pts JOIN grp
      ON pts.statute IS NOT DISTINCT FROM grp.statute AND pts.unit IS NOT DISTINCT FROM grp.unit AND pts.number IS NOT DISTINCT FROM grp.number AND pts.g = grp.g AND grp.f <= pts.d AND pts.d < grp.t
    GROUP BY ALL) p GROUP BY ALL
), rows AS (
  SELECT per.statute, per.unit, per.number, 'period' AS kind, strftime(a, '%Y-%m-%d') AS date_from,
         CASE WHEN b = DATE '9999-12-31' THEN '' ELSE strftime(b, '%Y-%m-%d') END AS date_to, deepest
  FROM per JOIN deep ON per.statute IS NOT DISTINCT FROM deep.statute AND per.unit IS NOT DISTINCT FROM deep.unit AND per.number IS NOT DISTINCT FROM deep.number AND per.g = deep.g
  UNION ALL
  SELECT statute, unit, number, 'gap', strftime(b, '%Y-%m-%d'), strftime(nxt, '%Y-%m-%d'), 0 FROM (
    SELECT *, lead(a) OVER (PARTITION BY statute, unit, number ORDER BY a) AS nxt FROM per) WHERE nxt IS NOT NULL
)
SELECT {select} FROM rows {where}"""


def _sql_p5(attributes: bool) -> str:
    extra = """, CASE WHEN prev_s IS NULL THEN 'inserted' ELSE 'changed' END AS change, text,
  coalesce(strftime(in_force_from, '%Y-%m-%d'), '') AS in_force_from, coalesce(strftime(in_force_to, '%Y-%m-%d'), '') AS in_force_to, coalesce(amended_by, '') AS amended_by"""
    return f"""
WITH days AS (SELECT snapshot_on, row_number() OVER (ORDER BY snapshot_on) AS i, lead(snapshot_on) OVER (ORDER BY snapshot_on) AS nxt
              FROM (SELECT DISTINCT snapshot_on FROM corpus_snapshots WHERE snapshot_on IS NOT NULL)),
k AS (SELECT {sql_key()}, snapshot_on, delivered_at, snapshot_row_id, in_force_from, in_force_to, amended_by, text FROM corpus_snapshots),
one AS (SELECT k.*, days.i, days.nxt, md5(to_json([trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')), in_force_from::VARCHAR, in_force_to::VARCHAR, coalesce(amended_by, '')])::VARCHAR) AS s
        FROM k JOIN days USING (snapshot_on)
        QUALIFY row_number() OVER (PARTITION BY statute, unit, number, snapshot_on ORDER BY delivered_at DESC, snapshot_row_id DESC) = 1),
lagged AS (SELECT *, CASE WHEN lag(i) OVER w = i - 1 THEN lag(s) OVER w END AS prev_s FROM one WINDOW w AS (PARTITION BY statute, unit, number ORDER BY i)),
grp AS (SELECT *, sum(CASE WHEN prev_s = s THEN 0 ELSE 1 END) OVER (PARTITION BY statute, unit, number ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM lagged),
runs AS (SELECT *, arg_max(nxt, i) OVER (PARTITION BY statute, unit, number, g) AS lastnxt, max(i) OVER (PARTITION BY statute, unit, number, g) AS li,
                row_number() OVER (PARTITION BY statute, unit, number, g ORDER BY i) AS rn FROM grp)
SELECT statute, unit, number, strftime(snapshot_on, '%Y-%m-%d') AS valid_from,
  coalesce((SELECT strftime(d.nxt, '%Y-%m-%d') FROM days d WHERE d.i = li), '') AS valid_to{extra if attributes else ''}
FROM runs WHERE rn = 1"""


QUERIES = {"p2_found": p2_found, "p2_periods": p2_periods, "p5_found": p5_found, "p5_history": p5_history}

SQL = {
    "p2_found": _sql_p2("statute, unit, number, kind, date_from, date_to", "WHERE kind = 'gap' OR deepest >= 2"),
    "p2_periods": _sql_p2("*", ""),
    "p5_found": _sql_p5(False),
    "p5_history": _sql_p5(True),
}
