"""Queries of sources, Acts, differences and streams, with SQL twins where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempolex.functions import acts as a
from tempolex.functions.diffing import diff_rows
from tempolex.functions.keys import iso_date
from tempolex.operators import temporal as t
from tempolex.plans.problems import SQL as PROBLEM_SQL
from tempolex.plans.problems import p5_history
from tempolex.plans.temporal_queries import _CONTENTS, DAY, PROV
from tempolex.session import shared_dir, table
from tempolex.sources import cleaning, corpus_io, splitting
from tempolex.streaming import calls

LAST_YEAR = 2027


def repeal_title_dates(spark, d):
    on, exact = a.repealed_on(F.col("repeal_note"), LAST_YEAR)
    return table(spark, d, "acts").where("repeal_note is not null").select("statute", iso_date(on).alias("repealed_on"), exact)


def act_identity(spark, d):
    return table(spark, d, "acts").select("statute", F.coalesce(a.title_year(F.col("title")), F.lit(0)).alias("title_year"), a.act_number(F.col("act_number")).alias("number"), a.initials(F.col("title")).alias("initials"))


def act_keys(spark, d):
    return a.unique_keys(table(spark, d, "acts").select("statute", "title"), "title").select("statute", "act_key")


def _act_pages(spark, d, size: int) -> DataFrame:
    """(page_id, first, text): the provisions in force on a day printed as Acts, those of one unit among `size` to a page. page_id is the version of the first."""
    v = t.versions(table(spark, d, "sample_corpus"), ["heading", "text", "in_force_from", "in_force_to"])
    listing = t.contents(v, DAY)
    printed = listing.groupBy("key").agg(F.min("version_id").alias("version_id"))  # one version of a provision is printed
    listing = listing.join(printed, ["key", "version_id"], "left_semi").join(v.select("version_id", "unit", "number", "text"), "version_id")
    line = F.concat("number", F.lit(". "), F.regexp_replace(F.coalesce("heading", F.lit("")), r"[.\n:—–]", " "), F.lit(".— "), F.coalesce("text", F.lit("")))
    page = F.floor((F.col("position") - 1) / size)
    made = listing.groupBy("statute", "unit", page.alias("page")).agg(F.sort_array(F.collect_list(F.struct("position", "version_id", "number", line.alias("line")))).alias("l"))
    return made.select(F.col("l")[0]["version_id"].alias("page_id"), F.col("l")[0]["number"].alias("first"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def act_split(spark, d):
    """Pages of Acts split into their provisions again; what was printed must come back."""
    return splitting.split_acts(_act_pages(spark, d, 50), "page_id", "text").select("page_id", "number", "heading", "text")


def act_split_report(spark, d):
    """How the pages were read: candidate lines, provisions, what was omitted or is long, and the characters accounted for."""
    return splitting.split_reports(_act_pages(spark, d, 50), "page_id", "text").select("page_id", "provisions", "omitted", "too_long", "characters", "characters_kept")


def source_clean(spark, d):
    return cleaning.cleaned(table(spark, d, "documents"), "doc_id", "text")


def buried_numbers(spark, d):
    """Pages taken for the body of their first provision: the later headings inside."""
    return splitting.buried(_act_pages(spark, d, 8), "page_id", "first", "text").select("page_id", F.array_join("numbers", " ").alias("numbers"))


def swallowed_headings(spark, d):
    """Versions of the record whose text runs on into later provisions, with their numbers."""
    return splitting.buried(t.versions(table(spark, d, "sample_corpus"), ["text", "in_force_from", "in_force_to"]), "version_id", "number", "text").select("version_id", F.array_join("numbers", " ").alias("numbers"))


def swallowed_stars(spark, d):
    """Texts with a mark of omission put behind their first word and taken out again."""
    marked = F.regexp_replace("text", r"^(\S+)", "$1 * * *")
    return t.records(table(spark, d, "sample_corpus"), ["text"]).where("text is not null").select("version_id", F.length(cleaning.strip_stars(marked)).alias("length"))


def word_diff(spark, d):
    """Differences between consecutive recorded versions of every provision."""
    key = ["statute", "unit", "number"]
    history = p5_history(spark, d).withColumn("old", F.lag("text").over(Window.partitionBy(*key).orderBy("valid_from")))
    pairs = history.where("old is not null").withColumn("pair_id", F.xxhash64(*key, "valid_from"))
    names = pairs.select("pair_id", *key, "valid_from")
    return diff_rows(pairs, "pair_id", "old", "text").join(names, "pair_id").drop("pair_id")


def history_pages(spark, d):
    """Consecutive recorded versions printed as a page with one substitution, read as of the year before it was made: the older text must come back."""
    key = ["statute", "unit", "number"]
    history = p5_history(spark, d).withColumn("old", F.lag("text").over(Window.partitionBy(*key).orderBy("valid_from")))
    plain = lambda c: F.trim(F.regexp_replace(F.col(c), r"[\[\]\"“”\s\p{Z}]+", " "))
    year = F.substring("valid_from", 1, 4).cast("int")
    pages = history.where("old is not null and text is not null").select(
        F.xxhash64(*key, "valid_from").alias("page_id"), *key, "valid_from", F.concat(F.lit("Before. 1["), plain("text"), F.lit("]1 After.")).alias("page"),
        F.create_map(F.lit("1"), F.concat(F.lit("Substituted by Act I of "), year.cast("string"), F.lit(' for: "'), plain("old"), F.lit('"'))).alias("notes"), (year - 1).alias("year"),
    )
    then = cleaning.history_on(pages, "page_id", "page", "notes", "year")
    return then.join(pages.select("page_id", *key, "valid_from"), "page_id").select(*key, "valid_from", "text")


def assent_dates(spark, d):
    """The dates of assent of Acts, printed in a header and read again."""
    printed = F.concat(F.lit("ACT No. I\n[ "), F.date_format("assent_on", "d"), F.lit("th "), F.date_format("assent_on", "MMMM"), F.lit(", "), F.date_format("assent_on", "yyyy"), F.lit(" ]\nAn Act"))
    return table(spark, d, "acts").select("statute", iso_date(a.assent_date(printed)).alias("assent_on"))


def source_normalise(spark, d):
    """Length of every text after lookalike and invisible characters are normalised."""
    return t.records(table(spark, d, "sample_corpus"), ["text"]).where("text is not null").select("version_id", F.length(cleaning.normalise_source(F.col("text"))).alias("length"))


def row_problems(spark, d):
    """Rules the delivered rows break, read as text rows would be."""
    rows = table(spark, d, "sample_corpus")
    as_text = rows.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("in_force_from", "in_force_to")})
    return corpus_io.row_problems(as_text).groupBy("problem").agg(F.count("*").alias("n"))


def jsonl_round_trip(spark, d):
    """All versions written as gzip JSON Lines, read back and checked: counts of each statute, and how many of its rows break a rule."""
    rows = t.versions(table(spark, d, "sample_corpus"))
    path = f"{shared_dir(spark)}/round-trip-{uuid.uuid4().hex}"
    texts = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("statute", "unit", "number", "heading", "text")], "in_force_from", "in_force_to", "manner", "amended_by", "enacted_by", "start_known", "end_known")
    corpus_io.write_jsonl(texts, path)
    back = corpus_io.read_rows(spark, path)
    broken = corpus_io.row_problems(back).groupBy("statute").agg(F.count("*").alias("problems"))
    counts = back.groupBy("statute").agg(F.count("*").alias("versions"), F.sum(F.length("text")).alias("characters"))
    return counts.join(broken, "statute", "left").na.fill(0, ["problems"])


def _stream(spark: SparkSession, d: str, make) -> DataFrame:
    """A stream over the telemetry table, run to its end. The table is not in the order of time, so lateness up to its whole span is allowed for."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = calls.timed(calls.read_calls(spark, _as_folder(spark, d, at), "parquet"), "36500 days")
    query = make(source).writeStream.outputMode("complete").queryName("q" + uuid.uuid4().hex).format("memory").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(query.name)


def _as_folder(spark, d, at):
    path = f"{at}/in"
    table(spark, d, "telemetry").write.parquet(path)
    return path


def stream_tool_windows(spark, d):
    """Daily windows by tool of the call stream (an extension)."""
    out = _stream(spark, d, lambda s: calls.windows(s, "1 day"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "tool", "calls", "refused", F.round("ms", 2).alias("ms"))


QUERIES = {
    f.__name__: f
    for f in (repeal_title_dates, act_identity, act_keys, act_split, act_split_report, source_clean, buried_numbers, swallowed_headings, swallowed_stars, word_diff, history_pages, assent_dates, source_normalise, row_problems, jsonl_round_trip, stream_tool_windows)
}

_EFF = r"(?i)w\.?\s?e\.?\s?f\.?\s*(\d{1,2})[-./](\d{1,2})[-./](\d{2,4})"
_FOUR = "(CASE WHEN {0} >= 100 THEN {0} WHEN {0} <= 40 THEN {0} + 2000 ELSE {0} + 1900 END)"
P5_SQL = PROBLEM_SQL["p5_history"]
_SPACES = r"'[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+'"
_PAGES = f"""{PROV}, {_CONTENTS}, pr AS (SELECT c.*, p.unit, p.number, coalesce(p.text, '') AS text, (c.position - 1) // 50 AS page FROM contents c JOIN prov p USING (version_id) QUALIFY row_number() OVER (PARTITION BY c.key ORDER BY version_id) = 1),
pg AS (SELECT *, first_value(version_id) OVER (PARTITION BY statute, unit, page ORDER BY position) AS page_id FROM pr)"""
SQL = {
    "act_split": rf"""WITH {_PAGES} SELECT page_id, number, trim(regexp_replace(regexp_replace(coalesce(heading, ''), '[.\n:—–]', ' ', 'g'), {_SPACES}, ' ', 'g')) AS heading, trim(regexp_replace(text, {_SPACES}, ' ', 'g')) AS text FROM pg""",
    "act_keys": r"""WITH i AS (SELECT statute, title, upper(array_to_string(list_transform(list_filter(regexp_extract_all(regexp_replace(title, ',?\s*\d{4}$', ''), '[A-Za-z][0-9A-Za-z_''-]*'), lambda w: lower(w) NOT IN ('of', 'the', 'and', 'for', 'to', 'in', 'on', 'a', 'an')), lambda w: w[1]), '')) AS i,
        coalesce(list_last(regexp_extract_all(title, '(?:^|[^0-9])([0-9]{4})', 1)), '') AS y FROM acts),
      b AS (SELECT statute, title, y, CASE WHEN length(i) >= 3 THEN i ELSE rpad(i, 3, 'X') END AS b FROM i),
      n AS (SELECT *, count(*) OVER (PARTITION BY b) AS c, row_number() OVER (PARTITION BY b, y ORDER BY title, statute) AS k FROM b)
      SELECT statute, CASE WHEN c = 1 THEN b ELSE b || y || CASE WHEN k > 1 THEN '_' || k ELSE '' END END AS act_key FROM n""",
    "repeal_title_dates": f"""WITH n AS (SELECT statute, repeal_note AS r, try_cast(regexp_extract(repeal_note, '{_EFF}', 3) AS INTEGER) AS y, regexp_extract(repeal_note, '{_EFF}', 2) AS m, regexp_extract(repeal_note, '{_EFF}', 1) AS dd,
        list_transform(list_concat(regexp_extract_all(repeal_note, '(?:^|[^0-9])([0-9]{{4}})', 1), regexp_extract_all(repeal_note, '(?i)\\bof\\s+(\\d{{2}})(?:$|[^0-9])', 1)), lambda v: CAST(v AS INTEGER)) AS ys FROM acts WHERE repeal_note IS NOT NULL),
      e AS (SELECT statute, try_cast({_FOUR.format('y')} || '-' || lpad(m, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE) AS day, list_max(list_filter(list_transform(ys, lambda v: {_FOUR.format('v')}), lambda v: v BETWEEN 1800 AND {LAST_YEAR})) AS yr FROM n)
      SELECT statute, coalesce(strftime(day, '%Y-%m-%d'), yr || '-01-01', '') AS repealed_on, day IS NOT NULL AS exact FROM e""",
    "act_identity": r"""SELECT statute, CAST(coalesce(list_last(regexp_extract_all(title, '(?:^|[^0-9])([0-9]{4})', 1)), '0') AS INTEGER) AS title_year,
      coalesce(regexp_extract(act_number, '(?i)\b(?:act|ordinance|order|regulation|ord\.)\s+(?:no\.?\s*)?([IVXLCDM]+|\d+)\s+of\s+\d{2,4}', 1), '') AS number,
      upper(array_to_string(list_transform(list_filter(regexp_extract_all(regexp_replace(title, ',?\s*\d{4}$', ''), '[A-Za-z][0-9A-Za-z_''-]*'), lambda w: lower(w) NOT IN ('of', 'the', 'and', 'for', 'to', 'in', 'on', 'a', 'an')), lambda w: w[1]), '')) AS initials FROM acts""",
    "history_pages": rf"""WITH p5 AS ({P5_SQL}), h AS (SELECT statute, unit, number, valid_from, text, lag(text) OVER (PARTITION BY statute, unit, number ORDER BY valid_from) AS old FROM p5)
      SELECT statute, unit, number, valid_from, 'Before. ' || trim(regexp_replace(old, '[\[\]"“”\s\p{{Z}}]+', ' ', 'g')) || ' After.' AS text FROM h WHERE old IS NOT NULL AND text IS NOT NULL""",
    "assent_dates": "SELECT statute, coalesce(strftime(assent_on, '%Y-%m-%d'), '') AS assent_on FROM acts",
    "source_normalise": f"WITH {PROV} SELECT version_id, CAST(length(translate(text, chr(894) || chr(8722) || chr(160) || chr(173) || chr(8203) || chr(8288) || chr(65279), ';- ')) AS INTEGER) AS length FROM rec WHERE text IS NOT NULL",
    "swallowed_stars": f"""WITH {PROV} SELECT version_id, CAST(length(trim(regexp_replace(regexp_replace(text, '^(\\S+)', '\\1 * * *'), '(?:\\*\\s*){{2,}}', '', 'g'), ' ')) AS INTEGER) AS length FROM rec WHERE text IS NOT NULL""",
    "row_problems": """WITH p AS (SELECT unnest(list_filter([CASE WHEN statute IS NULL THEN 'no statute' END, CASE WHEN unit IS NULL THEN 'no unit' END, CASE WHEN number IS NULL THEN 'no number' END, CASE WHEN heading IS NULL THEN 'no heading' END,
      CASE WHEN text IS NULL THEN 'no text' END, CASE WHEN in_force_from IS NULL THEN 'no in_force_from' END, CASE WHEN lower(trim(unit)) NOT IN ('section', 'article', 'rule') THEN 'unknown unit' END,
      CASE WHEN in_force_to <= in_force_from THEN 'end not after start' END, CASE WHEN NOT coalesce(end_known, true) AND in_force_to IS NULL THEN 'unknown end without an end' END], lambda x: x IS NOT NULL)) AS problem FROM sample_corpus)
      SELECT problem, count(*) AS n FROM p GROUP BY problem""",
    "jsonl_round_trip": f"""WITH {PROV} SELECT coalesce(statute, '') AS statute, count(*) AS versions, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS characters,
      CAST(count(*) FILTER (coalesce(unit, '') NOT IN ('section', 'article', 'rule')) + count(*) FILTER (NOT coalesce(end_known, true) AND in_force_to IS NULL) AS BIGINT) AS problems FROM prov GROUP BY 1""",
    "stream_tool_windows": """WITH ev AS (SELECT DISTINCT event_id, at_s, tool, ms, refused FROM telemetry) SELECT strftime(make_timestamp(CAST(floor(at_s) AS BIGINT) * 1000000), '%Y-%m-%d') AS day, tool, count(*) AS calls,
      count(*) FILTER (refused) AS refused, round(sum(coalesce(ms, 0.0)), 2) AS ms FROM ev GROUP BY ALL""",
}
