"""Queries of citations, audit, amendments and telemetry, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempolex.functions.citations import citations
from tempolex.functions.keys import iso_date
from tempolex.operators import amend, audit, telemetry
from tempolex.operators import temporal as t
from tempolex.plans.temporal_queries import ASKED, LIVE, PROV
from tempolex.session import table

NARROW = ["heading", "in_force_from", "in_force_to", "start_known", "end_known", "manner", "amended_by", "enacted_by", "superseded_by"]


def _versions(spark: SparkSession, d: str, columns: list[str] = NARROW) -> DataFrame:
    return t.versions(table(spark, d, "sample_corpus"), columns)


def _acts(spark: SparkSession, d: str) -> list[str]:
    return [r.statute for r in table(spark, d, "acts").select("statute").collect()]  # the fixed list of Acts


def citation_parse(spark, d):
    return citations(table(spark, d, "documents"), "doc_id", "text", _acts(spark, d))


def citation_round_trip(spark, d):
    """Every section and article of the record cited in one of several forms, and read again."""
    held = _versions(spark, d).groupBy("statute", "unit", "number").agg(F.min("version_id").alias("doc_id"))
    form = lambda *forms: F.when(F.col("doc_id") % len(forms) == 0, F.format_string(forms[0], "number", "statute"))

    def chosen(forms: list[str]):
        out = form(*forms)
        for k, f in enumerate(forms[1:], 1):
            out = out.when(F.col("doc_id") % len(forms) == k, F.format_string(f, "number", "statute"))
        return out

    section = chosen(["as section %s %s says", "under s. %s of the %s, and", "charged u/s %s %s;", "Secs. %s, of %s", "see § %s of the %s (1990)"])
    article = chosen(["Article %s of the %s", "by Art. %s %s;", "articles %s, %s, apply"])
    printed = held.select("doc_id", F.when(F.col("unit") == "section", section).when(F.col("unit") == "article", article).alias("text"))
    return citations(printed, "doc_id", "text", _acts(spark, d)).select("doc_id", "key")


def default_act_resolution(spark, d):
    """Citations of charge sheets with the Act the document is about as default."""
    docs = table(spark, d, "documents")
    cited = citation_parse(spark, d).join(docs.select("doc_id", F.col("statute").alias("about")), "doc_id")
    return audit.with_default(cited, F.col("about")).select("doc_id", "seq", "key")


def _checked_documents(spark, d):
    dated = table(spark, d, "documents").select("doc_id", F.col("published_on").alias("as_of"))
    cited = citation_parse(spark, d).select("doc_id", "seq", "key", "kind", "statute", "named_statute").join(dated, "doc_id")
    return audit.checked(cited, _versions(spark, d))


def citation_audit(spark, d):
    """Every citation of every document against the versions in force on its date."""
    return _checked_documents(spark, d).select("doc_id", "seq", "key", "status", "checked_as")


def citation_verdict_rollup(spark, d):
    return audit.verdicts(_checked_documents(spark, d), "doc_id", table(spark, d, "documents"))


def audit_of_keys(spark, d):
    """The citations the benchmark expects, checked on its dates."""
    key = F.col("expected_citation")
    asked = table(spark, d, "benchmark").where("expected_citation is not null").select(
        "item_id", key.alias("key"), F.lit("statutory").alias("kind"), F.split_part(key, F.lit(":"), F.lit(1)).alias("statute"), F.lit("").alias("named_statute"), "as_of"
    )
    return audit.checked(asked, _versions(spark, d)).select("item_id", "key", "status")


def _amendments(spark, d, action: str) -> tuple[DataFrame, DataFrame]:
    """Amendments made up from acts and the versions themselves: one per key that has a version or, to insert, none."""
    v = _versions(spark, d, [*NARROW, "text"])
    keys = v.groupBy("key").agg(F.max("in_force_from").alias("last_from"), F.max("version_id").alias("amendment_id"))
    made = keys.select(
        "key", "amendment_id", F.lit(action).alias("action"), F.date_add("last_from", (F.col("amendment_id") % 5000 - 300).cast("int")).alias("on"),
        F.lit("Act I of 2030").alias("by"), F.lit(None).cast("string").alias("heading"), F.concat(F.lit("As amended, "), "key").alias("text"), F.lit(None).cast("string").alias("manner"),
    )
    return v, made


def _amended(spark, d, action):
    after, _ = amend.apply(*_amendments(spark, d, action))
    return after.select("key", iso_date(F.col("in_force_from")).alias("in_force_from"), iso_date(F.col("in_force_to")).alias("in_force_to"), "manner", "amended_by", "enacted_by")


def amend_substitute(spark, d):
    return _amended(spark, d, "substitute")


def amend_repeal(spark, d):
    return _amended(spark, d, "repeal")


def amend_insert(spark, d):
    return _amended(spark, d, "insert")


def amend_refused(spark, d):
    rows = [amend.apply(*_amendments(spark, d, a))[1].select("key", "action", "refusal") for a in ("substitute", "insert")]
    return rows[0].unionByName(rows[1])


def _events(spark, d):
    return telemetry.events(table(spark, d, "telemetry"))


def telemetry_summary(spark, d):
    return telemetry.by_tool(_events(spark, d))


def telemetry_percentiles(spark, d):
    return telemetry.percentiles(_events(spark, d), ["tool"], "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def telemetry_status_counts(spark, d):
    return telemetry.status_counts(_events(spark, d))


def telemetry_outcomes(spark, d):
    return telemetry.value_counts(_events(spark, d), "outcome")


def telemetry_errors(spark, d):
    return telemetry.value_counts(_events(spark, d), "error")


def refusal_rate(spark, d):
    return _events(spark, d).agg(F.count("*").alias("calls"), F.count_if("refused").alias("refused"), F.round(F.count_if("refused") / F.count("*"), 3).alias("rate"))


def refusal_statuses(spark, d):
    return telemetry.value_counts(_events(spark, d).where("refused"), "refusal_status")


def telemetry_overall(spark, d):
    return telemetry.overall(_events(spark, d))


def telemetry_recent(spark, d):
    return telemetry.recent(_events(spark, d)).select("event_id", "tool", "outcome", "ms")


_EV = "ev AS (SELECT DISTINCT event_id, at_s, coalesce(tool, 'unknown') AS tool, coalesce(outcome, 'unknown') AS outcome, coalesce(ms, 0.0) AS ms, refused, refusal_status, error, statuses FROM telemetry)"
_AM = f"""{PROV}, am AS (SELECT key, max(in_force_from) AS last_from, max(version_id) AS id FROM prov GROUP BY key), lv AS (SELECT key, max(in_force_from) AS live_from FROM prov WHERE in_force_to IS NULL GROUP BY key),
am2 AS (SELECT am.key, id, last_from + CAST(id % 5000 - 300 AS INTEGER) AS on_, live_from FROM am LEFT JOIN lv USING (key)),
old AS (SELECT key, in_force_from AS f, in_force_to AS t, manner, amended_by, enacted_by FROM prov)"""
_ISO = "coalesce(strftime({0}, '%Y-%m-%d'), '')"
_AMOUT = f"SELECT key, {_ISO.format('f')} AS in_force_from, {_ISO.format('t')} AS in_force_to, manner, amended_by, enacted_by FROM"
_CLOSE = """SELECT old.key, f, CASE WHEN t IS NULL AND f = live_from AND on_ > live_from THEN on_ ELSE t END AS t, CASE WHEN t IS NULL AND f = live_from AND on_ > live_from THEN '{0}' ELSE manner END AS manner,
  CASE WHEN t IS NULL AND f = live_from AND on_ > live_from THEN 'Act I of 2030' ELSE amended_by END AS amended_by, enacted_by FROM old JOIN am2 USING (key)"""

QUERIES = {
    f.__name__: f
    for f in (
        citation_parse, citation_round_trip, default_act_resolution, citation_audit, citation_verdict_rollup, audit_of_keys, amend_substitute, amend_repeal, amend_insert, amend_refused,
        telemetry_summary, telemetry_percentiles, telemetry_status_counts, telemetry_outcomes, telemetry_errors, refusal_rate, refusal_statuses, telemetry_recent, telemetry_overall,
    )
}

SQL = {
    "citation_round_trip": f"""WITH {PROV} SELECT min(version_id) AS doc_id, statute || ':' || unit || ':' || number AS key FROM prov WHERE unit IN ('section', 'article') AND regexp_full_match(number, '[0-9]{{1,4}}[A-Z]{{0,3}}') GROUP BY statute, unit, number""",
    "audit_of_keys": f"""WITH {PROV}, {ASKED}, sp AS (SELECT key, min(in_force_from) AS f0, max(in_force_from) AS l0, arg_min(coalesce(start_known, true), in_force_from) AS known FROM prov GROUP BY key),
      a AS (SELECT item_id, asked.key, as_of, CASE WHEN e.key IS NOT NULL THEN asked.key ELSE regexp_replace(asked.key, '(?:\\([0-9A-Za-z]+\\))+$', '') END AS at FROM asked LEFT JOIN sp e ON e.key = asked.key)
      SELECT DISTINCT item_id, a.key, CASE WHEN split_part(a.key, ':', 1) NOT IN (SELECT statute FROM prov) THEN 'statute_not_loaded' WHEN sp.key IS NULL THEN 'unknown_provision'
        WHEN p.key IS NULL AND as_of < f0 AND known THEN 'not_yet_in_force' WHEN p.key IS NULL AND as_of < f0 THEN 'before_record' WHEN p.key IS NULL THEN 'not_in_force' WHEN l0 > as_of THEN 'amended_since' ELSE 'in_force' END AS status
      FROM a LEFT JOIN sp ON sp.key = a.at LEFT JOIN prov p ON p.key = a.at AND (p.in_force_from <= as_of AND (p.in_force_to IS NULL OR as_of < p.in_force_to))""",
    "amend_substitute": f"WITH {_AM}, r AS ({_CLOSE.format('substituted')} UNION ALL SELECT key, on_, NULL, '', '', 'Act I of 2030' FROM am2 WHERE on_ > live_from) {_AMOUT} r",
    "amend_repeal": f"WITH {_AM}, r AS ({_CLOSE.format('repealed')}) {_AMOUT} r",
    "amend_insert": f"WITH {_AM}, r AS (SELECT * FROM old UNION ALL SELECT key, on_, NULL, '', '', 'Act I of 2030' FROM am2 WHERE live_from IS NULL) {_AMOUT} r",
    "amend_refused": f"""WITH {_AM} SELECT key, 'substitute' AS action, CASE WHEN live_from IS NULL THEN 'no version in force' ELSE 'ends before it begins' END AS refusal FROM am2 WHERE live_from IS NULL OR on_ <= live_from
      UNION ALL SELECT key, 'insert', 'already in force' FROM am2 WHERE live_from IS NOT NULL""",
    "telemetry_summary": f"""WITH {_EV} SELECT tool, count(*) AS calls, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'refused' OR coalesce(refused, false)) AS refused, count(*) FILTER (outcome = 'rejected') AS rejected,
      count(*) FILTER (outcome NOT IN ('ok', 'refused', 'rejected')) AS errors, max(ms) AS longest, round(count(*) FILTER (outcome = 'refused' OR coalesce(refused, false)) / count(*), 3) AS refusal_rate, count(*) < 20 AS thin FROM ev GROUP BY tool""",
    "telemetry_percentiles": f"""WITH {_EV}, o AS (SELECT tool, ms, row_number() OVER (PARTITION BY tool ORDER BY ms) AS rn, count(*) OVER (PARTITION BY tool) AS n FROM ev)
      SELECT tool, min(ms) FILTER (rn = least(n, greatest(1, round_even(0.5 * n + 0.5, 0)))) AS p50, min(ms) FILTER (rn = least(n, greatest(1, round_even(0.95 * n + 0.5, 0)))) AS p95, min(ms) FILTER (rn = least(n, greatest(1, round_even(0.99 * n + 0.5, 0)))) AS p99 FROM o GROUP BY tool""",
    "telemetry_status_counts": f"WITH {_EV}, s AS (SELECT unnest(map_entries(statuses)) AS e FROM ev) SELECT e.key AS status, CAST(sum(e.value) AS BIGINT) AS n FROM s GROUP BY ALL",
    "telemetry_outcomes": f"WITH {_EV} SELECT outcome AS value, count(*) AS n FROM ev GROUP BY outcome",
    "telemetry_errors": f"WITH {_EV} SELECT error AS value, count(*) AS n FROM ev WHERE error IS NOT NULL GROUP BY error",
    "refusal_rate": f"WITH {_EV} SELECT count(*) AS calls, count(*) FILTER (refused) AS refused, round(count(*) FILTER (refused) / count(*), 3) AS rate FROM ev",
    "refusal_statuses": f"WITH {_EV} SELECT refusal_status AS value, count(*) AS n FROM ev WHERE refused AND refusal_status IS NOT NULL GROUP BY refusal_status",
    "telemetry_overall": f"""WITH {_EV.replace('error, statuses', 'error, is_sample, statuses')}, o AS (SELECT ms, row_number() OVER (ORDER BY ms) AS rn, count(*) OVER () AS n FROM ev)
      SELECT count(*) AS calls, min(at_s) AS first_at, max(at_s) AS last_at, count(*) FILTER (refused) AS refused, max(ms) AS longest, CASE WHEN bool_and(coalesce(is_sample, false)) THEN true WHEN NOT bool_or(coalesce(is_sample, false)) THEN false END AS sample,
        round(count(*) FILTER (refused) / count(*), 3) AS refusal_rate, (SELECT min(ms) FILTER (rn = least(n, greatest(1, round_even(0.5 * n + 0.5, 0)))) FROM o) AS p50, (SELECT min(ms) FILTER (rn = least(n, greatest(1, round_even(0.95 * n + 0.5, 0)))) FROM o) AS p95 FROM ev""",
    "telemetry_recent": f"WITH {_EV} SELECT event_id, tool, outcome, ms FROM ev ORDER BY at_s DESC, event_id DESC LIMIT 25",
}
