"""Queries of the temporal operators over sample_corpus and benchmark, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempolex.operators import temporal as t
from tempolex.functions.keys import iso_date
from tempolex.plans.problems import sql_key
from tempolex.session import table

DAY, EARLIER, AS_AT = "2010-06-15", "1995-03-01", "2015-12-31"
NARROW = [c for c in t.CARRIED if c not in ("text",)]


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return t.versions(table(spark, d, "sample_corpus"), NARROW)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, key, as_of) of the benchmark items that expect a citation."""
    return table(spark, d, "benchmark").where("expected_citation is not null").select("item_id", F.col("expected_citation").alias("key"), "as_of")


def snapshot_as_of(spark, d):
    return t.as_of(_versions(spark, d), DAY).select("version_id", "key")


def versions_ranked(spark, d):
    return t.ranked(_versions(spark, d)).select("version_id", "key", "version_rank")


def version_current(spark, d):
    return t.current(_versions(spark, d))


def version_history(spark, d):
    manner = F.when(F.col("manner") != "", F.col("manner")).when(F.col("in_force_to").isNull(), "in force").otherwise("")
    return t.ranked(_versions(spark, d)).select("key", "version_rank", iso_date(F.col("in_force_from")).alias("in_force_from"), iso_date(F.col("in_force_to")).alias("in_force_to"), manner.alias("manner"), "enacted_by", "amended_by")


def asof_citation_lookup(spark, d):
    """version_id 0 where nothing was in force."""
    return t.point_lookup(_asked(spark, d), _versions(spark, d)).select("item_id", "key", F.coalesce("version_id", F.lit(0)).alias("version_id"))


def nearest_version(spark, d):
    return t.nearest(_asked(spark, d), "item_id", _versions(spark, d))


def status_note_case(spark, d):
    return _asked(spark, d).join(_versions(spark, d), "key").select("item_id", "version_id", t.status_note(F.col("as_of")).alias("note"))


def resolve_subdivision(spark, d):
    asked = _asked(spark, d).select("item_id", F.concat("key", F.lit("(1)(A)")).alias("key"))
    return t.resolve(asked.unionByName(_asked(spark, d).select("item_id", "key")), _versions(spark, d)).select("item_id", "key", "resolved")


def validate_versions(spark, d):
    return t.problems(_versions(spark, d))


def record_start_floor(spark, d):
    return t.record_starts(_versions(spark, d)).select("statute", iso_date(F.col("recorded_from")).alias("recorded_from"))


def coverage_warnings(spark, d):
    asked = _asked(spark, d).withColumn("statute", F.split_part("key", F.lit(":"), F.lit(1)))
    return t.coverage_warnings(asked, _versions(spark, d), AS_AT).select("item_id", "statute", "warning", iso_date(F.col("limit_on")).alias("limit_on"))


def changes_feed(spark, d):
    return t.changes(_versions(spark, d), "1990-01-01", "2016-12-31").withColumn("changed_on", iso_date(F.col("changed_on")))


def contents_listing(spark, d):
    return t.contents(_versions(spark, d), DAY)


def contents_counts(spark, d):
    return t.contents_counts(_versions(spark, d), DAY)


def compare_pair(spark, d):
    """version 0 where none was in force."""
    return t.compare_dates(_versions(spark, d), EARLIER, DAY).fillna(0, ["version_before", "version_after"])


def statute_order_sort(spark, d):
    return _versions(spark, d).select("statute", "number").distinct().select("statute", "number", *t.provision_order(F.col("number")))


def sequence_places(spark, d):
    """The place of every number in the numbering a later heading would continue; -1 for those in none."""
    place = t.sequence_within(F.col("number"))
    return _versions(spark, d).select("number").where("number is not null").distinct().select("number", F.coalesce(place["n"], F.lit(-1)).alias("n"), F.coalesce(place["suffix"], F.lit("")).alias("suffix"))


def paged_listing(spark, d):
    listing = t.contents(_versions(spark, d), DAY)
    return t.page(listing, ["statute", "position"], 200, 200).select("statute", "position", "key", "version_id", "total", "next_offset")


def corpus_info_rollup(spark, d):
    return t.corpus_info(_versions(spark, d)).withColumns({c: iso_date(F.col(c)) for c in ("earliest", "latest_change", "recorded_from")})


def corpus_info_top(spark, d):
    return t.corpus_info(_versions(spark, d)).orderBy(F.desc("versions"), "statute").limit(50).select("statute", "versions")


def number_normalise(spark, d):
    return table(spark, d, "sample_corpus").select("number").distinct().select("number", t.normalise_number(F.col("number")).alias("normal"))


def range_expand(spark, d):
    first = F.regexp_extract(F.split_part("key", F.lit(":"), F.lit(3)), r"^(\d+)", 1)
    ends = _asked(spark, d).where(first != "").select("item_id", first.cast("int").alias("a"), (first.cast("int") + F.col("item_id") % 60).cast("int").alias("b"))
    return ends.select("item_id", F.explode(t.expand_range(F.col("a"), F.col("b"))).alias("member"))


def display_citation(spark, d):
    """Section 302 PPC, Article 25 CONST, Order IX Rule 3 CPC."""
    order, rule = F.split_part("number", F.lit("/"), F.lit(1)), F.split_part("number", F.lit("/"), F.lit(2))
    label = F.when((F.col("unit") == "rule") & (rule != ""), F.concat(F.lit("Order "), order, F.lit(" Rule "), rule)).otherwise(F.concat(F.initcap("unit"), F.lit(" "), F.col("number")))
    return _versions(spark, d).select("key", F.concat(label, F.lit(" "), F.col("statute")).alias("citation")).distinct()


PROV = f"""rec AS (SELECT version_id, {sql_key()}, heading, text, in_force_from, in_force_to, coalesce(superseded_by, '') AS superseded_by, coalesce(manner, '') AS manner,
  coalesce(amended_by, '') AS amended_by, coalesce(enacted_by, '') AS enacted_by, start_known, end_known FROM sample_corpus QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY loaded_at DESC) = 1),
prov AS (SELECT *, concat_ws(':', coalesce(statute, ''), coalesce(unit, ''), coalesce(number, '')) AS key FROM rec WHERE in_force_from IS NOT NULL AND (in_force_to IS NULL OR in_force_to > in_force_from))"""
ASKED = "asked AS (SELECT item_id, expected_citation AS key, as_of FROM benchmark WHERE expected_citation IS NOT NULL)"
LIVE = "(in_force_from <= {0} AND (in_force_to IS NULL OR {0} < in_force_to))"
_ORDER = r"""CASE WHEN regexp_matches(number, '^\d') THEN 0 WHEN regexp_matches(number, '^[IVXLC]+/\d+$') THEN 1 ELSE 2 END AS order_scheme,
  CASE WHEN regexp_matches(number, '^\d') THEN coalesce(try_cast(regexp_extract(number, '^(\d+)', 1) AS BIGINT), 0) ELSE 0 END AS order_n,
  CASE WHEN regexp_matches(number, '^\d') THEN regexp_extract(number, '^(\d+)([A-Z]*)', 2) ELSE '' END AS order_suffix, 0::BIGINT AS order_rule"""
_CONTENTS = f"""held AS (SELECT key, count(*) AS n FROM prov GROUP BY key),
list AS (SELECT statute, unit, number, key, version_id, heading, n > 1 AS amended, {_ORDER} FROM prov JOIN held USING (key) WHERE {LIVE.format(f"DATE '{DAY}'")}),
contents AS (SELECT statute, key, version_id, heading, amended, row_number() OVER (PARTITION BY statute ORDER BY unit, order_scheme, order_n, order_suffix, order_rule, number, version_id)::INTEGER AS position FROM list)"""
_W = "WINDOW w AS (PARTITION BY key ORDER BY in_force_from, version_id)"
_INFO = """info AS (SELECT statute, count(DISTINCT key) AS provisions, count(*) AS versions, count(*) FILTER (in_force_to IS NULL) AS live, min(in_force_from) AS earliest,
  max(greatest(in_force_from, coalesce(in_force_to, in_force_from))) AS latest_change, max(in_force_from) FILTER (start_known = false) AS recorded_from FROM prov GROUP BY statute)"""

QUERIES = {
    f.__name__: f
    for f in (
        snapshot_as_of, versions_ranked, version_current, version_history, asof_citation_lookup, nearest_version, status_note_case, resolve_subdivision,
        validate_versions, record_start_floor, coverage_warnings, changes_feed, contents_listing, contents_counts, compare_pair, statute_order_sort, sequence_places,
        paged_listing, corpus_info_rollup, corpus_info_top, number_normalise, range_expand, display_citation,
    )
}

SQL = {
    "snapshot_as_of": f"WITH {PROV} SELECT version_id, key FROM prov WHERE {LIVE.format(f"DATE '{DAY}'")}",
    "versions_ranked": f"WITH {PROV} SELECT version_id, key, row_number() OVER w::INTEGER AS version_rank FROM prov {_W}".replace("row_number() OVER w::INTEGER", "CAST(row_number() OVER w AS INTEGER)"),
    "version_current": f"WITH {PROV} SELECT key, version_id FROM prov WHERE in_force_to IS NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY in_force_from, version_id) = 1",
    "version_history": f"""WITH {PROV} SELECT key, CAST(row_number() OVER w AS INTEGER) AS version_rank, coalesce(strftime(in_force_from, '%Y-%m-%d'), '') AS in_force_from, coalesce(strftime(in_force_to, '%Y-%m-%d'), '') AS in_force_to,
      CASE WHEN manner <> '' THEN manner WHEN in_force_to IS NULL THEN 'in force' ELSE '' END AS manner, enacted_by, amended_by FROM prov {_W}""",
    "asof_citation_lookup": f"WITH {PROV}, {ASKED} SELECT item_id, asked.key, coalesce(version_id, 0) AS version_id FROM asked LEFT JOIN prov ON asked.key = prov.key AND {LIVE.format('as_of')}",
    "nearest_version": f"""WITH {PROV}, {ASKED} SELECT item_id, version_id FROM asked JOIN prov USING (key)
      QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY in_force_from <= as_of DESC, CASE WHEN in_force_from <= as_of THEN -epoch(in_force_from) ELSE epoch(in_force_from) END, CASE WHEN in_force_from <= as_of THEN -version_id ELSE version_id END) = 1""",
    "status_note_case": f"""WITH {PROV}, {ASKED} SELECT item_id, version_id, CASE WHEN {LIVE.format('as_of')} THEN ''
      WHEN as_of < in_force_from AND NOT coalesce(start_known, true) THEN 'before the record, which begins ' || strftime(in_force_from, '%Y-%m-%d')
      WHEN as_of < in_force_from THEN 'not in force until ' || strftime(in_force_from, '%Y-%m-%d')
      ELSE (CASE WHEN manner <> '' THEN manner ELSE 'ceased' END) || (CASE WHEN coalesce(end_known, true) THEN ' on ' ELSE ' on or after ' END) || strftime(in_force_to, '%Y-%m-%d') ||
        (CASE WHEN superseded_by <> '' THEN '; see ' || superseded_by ELSE '' END) END AS note FROM asked JOIN prov USING (key)""",
    "resolve_subdivision": f"""WITH {PROV}, {ASKED}, q AS (SELECT item_id, key || '(1)(A)' AS key FROM asked UNION ALL SELECT item_id, key FROM asked), k AS (SELECT DISTINCT key FROM prov)
      SELECT item_id, q.key, coalesce(e.key, p.key, q.key) AS resolved FROM q LEFT JOIN k e ON e.key = q.key LEFT JOIN k p ON p.key = regexp_replace(q.key, '(?:\\([0-9A-Za-z]+\\))+$', '')""",
    "validate_versions": f"""WITH {PROV}, s AS (SELECT statute, key, version_id, in_force_from AS f, in_force_to AS t, coalesce(start_known, true) AS sk, row_number() OVER w AS n, lead(in_force_from) OVER w AS nf, lead(enacted_by) OVER w AS nb FROM prov {_W})
      SELECT key, version_id, 'open version followed by another' AS problem FROM s WHERE nf IS NOT NULL AND t IS NULL
      UNION ALL SELECT key, version_id, 'overlaps the next version' FROM s WHERE nf < t UNION ALL SELECT key, version_id, 'gap before the next version' FROM s WHERE nf > t AND nb = ''
      UNION ALL SELECT key, version_id, 'unknown start behind the first version' FROM s WHERE n > 1 AND NOT sk
      UNION ALL SELECT key, min(version_id), 'several live versions' FROM prov WHERE in_force_to IS NULL GROUP BY key HAVING count(*) > 1
      UNION ALL SELECT statute, min(version_id), 'several record starts' FROM prov WHERE start_known = false GROUP BY statute HAVING count(DISTINCT in_force_from) > 1""",
    "record_start_floor": f"WITH {PROV} SELECT statute, strftime(max(in_force_from), '%Y-%m-%d') AS recorded_from FROM prov WHERE start_known = false GROUP BY statute",
    "coverage_warnings": f"""WITH {PROV}, {ASKED}, r AS (SELECT statute, max(in_force_from) AS recorded_from FROM prov WHERE start_known = false GROUP BY statute)
      SELECT item_id, statute, 'before the record' AS warning, strftime(recorded_from, '%Y-%m-%d') AS limit_on FROM asked JOIN r ON statute = split_part(key, ':', 1) WHERE as_of < recorded_from
      UNION ALL SELECT item_id, split_part(key, ':', 1), 'after the record', '{AS_AT}' FROM asked WHERE as_of > DATE '{AS_AT}'""",
    "changes_feed": f"""WITH {PROV}, l AS (SELECT *, row_number() OVER w AS n, lag(in_force_to) OVER w AS b, lag(amended_by) OVER w AS bb, lead(in_force_from) OVER w AS a FROM prov {_W}),
      e AS (SELECT in_force_from AS changed_on, key, version_id, CASE WHEN n = 1 THEN 'commenced' WHEN b = in_force_from THEN 'substituted' ELSE 'reinstated' END AS event,
              CASE WHEN enacted_by <> '' THEN enacted_by WHEN b = in_force_from THEN coalesce(bb, '') ELSE '' END AS instrument, heading FROM l
            UNION ALL SELECT in_force_to, key, version_id, CASE WHEN manner <> '' THEN manner ELSE 'repealed' END, amended_by, heading FROM l WHERE in_force_to IS NOT NULL AND a IS DISTINCT FROM in_force_to)
      SELECT * REPLACE (strftime(changed_on, '%Y-%m-%d') AS changed_on) FROM e WHERE changed_on BETWEEN DATE '1990-01-01' AND DATE '2016-12-31'""",
    "contents_listing": f"WITH {PROV}, {_CONTENTS} SELECT * FROM contents",
    "contents_counts": f"""WITH {PROV}, k AS (SELECT statute, key, max(CASE WHEN {LIVE.format(f"DATE '{DAY}'")} THEN 1 ELSE 0 END) AS live FROM prov GROUP BY ALL)
      SELECT statute, CAST(sum(live) AS BIGINT) AS in_force, CAST(sum(1 - live) AS BIGINT) AS not_in_force FROM k GROUP BY statute""",
    "compare_pair": f"""WITH {PROV} SELECT key, coalesce(min(version_id) FILTER ({LIVE.format(f"DATE '{EARLIER}'")}), 0) AS version_before, coalesce(min(version_id) FILTER ({LIVE.format(f"DATE '{DAY}'")}), 0) AS version_after,
      count(*) FILTER (in_force_from > DATE '{EARLIER}' AND in_force_from <= DATE '{DAY}') AS begun,
      count(DISTINCT amended_by) FILTER (in_force_to > DATE '{EARLIER}' AND in_force_to <= DATE '{DAY}' AND amended_by <> '') AS instruments,
      coalesce(array_to_string(list_sort(list(DISTINCT amended_by) FILTER (in_force_to > DATE '{EARLIER}' AND in_force_to <= DATE '{DAY}' AND amended_by <> '')), '; '), '') AS named FROM prov GROUP BY key""",
    "statute_order_sort": f"WITH {PROV} SELECT statute, number, {_ORDER} FROM (SELECT DISTINCT statute, number FROM prov)",
    "sequence_places": rf"""WITH {PROV} SELECT DISTINCT number, CAST(CASE WHEN regexp_matches(number, '^\d') THEN coalesce(try_cast(regexp_extract(number, '^(\d+)', 1) AS BIGINT), 0) WHEN regexp_matches(number, '^[IVXLC]+/\d+$') THEN CAST(split_part(number, '/', 2) AS BIGINT) ELSE -1 END AS BIGINT) AS n,
      CASE WHEN regexp_matches(number, '^\d') THEN regexp_extract(number, '^(\d+)([A-Z]*)', 2) ELSE '' END AS suffix FROM prov WHERE number IS NOT NULL""",
    "paged_listing": f"""WITH {PROV}, {_CONTENTS}, n AS (SELECT count(*) AS total FROM contents)
      SELECT statute, position, key, version_id, total, CASE WHEN total > 400 THEN 400::BIGINT END AS next_offset FROM (SELECT * FROM contents ORDER BY statute, position LIMIT 200 OFFSET 200), n""",
    "corpus_info_rollup": f"WITH {PROV}, {_INFO} SELECT * REPLACE (strftime(earliest, '%Y-%m-%d') AS earliest, strftime(latest_change, '%Y-%m-%d') AS latest_change, coalesce(strftime(recorded_from, '%Y-%m-%d'), '') AS recorded_from) FROM info",
    "corpus_info_top": f"WITH {PROV}, {_INFO} SELECT statute, versions FROM info ORDER BY versions DESC, statute LIMIT 50",
    "number_normalise": r"""WITH n AS (SELECT DISTINCT number, trim(translate(number, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')) AS m FROM sample_corpus)
      SELECT number, CASE WHEN regexp_matches(m, '^\d') THEN regexp_extract(m, '^(\d+)-?([A-Za-z]*)(.*)$', 1) || upper(regexp_extract(m, '^(\d+)-?([A-Za-z]*)(.*)$', 2)) || lower(regexp_extract(m, '^(\d+)-?([A-Za-z]*)(.*)$', 3)) ELSE upper(m) END AS normal FROM n""",
    "range_expand": f"""WITH {ASKED}, e AS (SELECT item_id, CAST(regexp_extract(split_part(key, ':', 3), '^(\\d+)', 1) AS INTEGER) AS a, CAST(item_id % 60 AS INTEGER) AS w FROM asked WHERE regexp_matches(split_part(key, ':', 3), '^\\d'))
      SELECT item_id, unnest(CASE WHEN w <= 50 THEN range(a, a + w + 1) ELSE [a, a + w] END)::INTEGER AS member FROM e""",
    "display_citation": f"""WITH {PROV} SELECT DISTINCT key, upper(unit[1]) || unit[2:] || ' ' || number || ' ' || statute AS citation FROM prov""",
}
