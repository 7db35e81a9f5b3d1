"""Queries of the text index over sample_corpus and benchmark, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempolex.functions.analysis import STOPWORDS, SUFFIXES, expansion, related_words, stems, without_stopwords, words
from tempolex.functions.keys import iso_date
from tempolex.functions.naming import named_acts
from tempolex.operators import decide
from tempolex.operators import ranking as r
from tempolex.operators import temporal as t
from tempolex.plans.temporal_queries import LIVE, PROV
from tempolex.session import materialise, table

COLUMNS = ["heading", "text", "in_force_from", "in_force_to"]


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return t.versions(table(spark, d, "sample_corpus"), COLUMNS)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"), "as_of")


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    return r.build_index(_versions(spark, d))


def _postings(spark: SparkSession, d: str) -> DataFrame:
    """For queries that read the postings once: nothing is written."""
    v = _versions(spark, d)
    return r.postings(r.analysed(v, r.defined_stopwords(v)))


def term_frequency(spark, d):
    return _postings(spark, d).select("version_id", "token", "tf")


def document_frequency(spark, d):
    return r.document_frequency(_postings(spark, d))


def epoch_document_frequency(spark, d):
    return r.epoch_document_frequency(_postings(spark, d)).withColumn("day", iso_date(F.col("day")))


def snapshot_statistics(spark, d):
    docs, _, _ = _index(spark, d)
    stats = r.snapshot_statistics(docs, _questions(spark, d))
    return stats.select(iso_date(F.col("as_of")).alias("as_of"), "n", F.round("mean_len", 4).alias("mean_len"))


def bm25_coverage_sort(spark, d):
    """The five best versions per question by coverage, then score, asked words only."""
    docs, posts, defined = _index(spark, d)
    terms = r.question_terms(_questions(spark, d), defined)
    hits = r.scored(r.term_hits(r.question_forms(terms, posts, expand=False), posts, r.snapshot_statistics(docs, _questions(spark, d))), terms)
    score = F.round("score", 4)
    w = Window.partitionBy("item_id").orderBy(F.desc("matched"), F.desc(score), "version_id")
    top = hits.withColumn("position", F.row_number().over(w)).where("position <= 5")
    return top.select("item_id", "position", "version_id", score.alias("score"), "matched")


def bm25_top_k(spark, d):
    """The five best versions per question with stems, related words, heading and proximity."""
    top = r.top_hits(_questions(spark, d), _index(spark, d))
    return top.select("item_id", "position", "version_id", *[F.round(c, 4).alias(c) for c in ("score", "coverage", "heading_coverage", "tightness", "ranking")])


def _weighed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Weights of the questions' terms, and (item_id, version_id, matched) of their best hits."""
    index = docs, posts, defined = _index(spark, d)
    questions = _questions(spark, d)
    forms = r.question_forms(r.question_terms(questions, defined), posts)
    weights = materialise(r.term_weights(forms, posts, r.snapshot_statistics(docs, questions)), "weights")
    return weights, r.top_hits(questions, index, 1).select("item_id", "version_id", F.col("terms").alias("matched"))


def information_coverage(spark, d):
    """Of each question's best hit: the matched share of the weight of its terms."""
    weights, best = _weighed(spark, d)
    best = materialise(best, "best")
    return decide.information(weights, best).join(best, "item_id").select("item_id", "version_id", F.round("information", 4).alias("information_coverage"))


def key_term_missing(spark, d):
    """Questions whose heaviest term, frame words aside, is not matched by their best hit and not made up for by the rest, with that term."""
    weights, best = _weighed(spark, d)
    best = materialise(best, "best")
    judged = best.join(decide.key_terms(weights), "item_id").join(decide.information(weights, best), "item_id")
    missing = (F.col("weights") >= 2) & ~F.array_contains("matched", F.col("key_term")) & (F.round("information", 6) < decide.KEY_CEILING)
    return judged.where(missing).select("item_id", F.col("key_term").alias("term"))


def absent_terms(spark, d):
    return r.absent_terms(_questions(spark, d), _versions(spark, d))


def defined_terms(spark, d):
    return r.defined_terms(_versions(spark, d))


def stem_dictionary(spark, d):
    vocabulary = _versions(spark, d).select(F.explode(words(F.col("text"))).alias("term")).distinct()
    return vocabulary.select("term", F.explode(stems(F.col("term"))).alias("stem"))


def query_expansion(spark, d):
    terms = _questions(spark, d).select(F.explode(without_stopwords(words(F.col("question")))).alias("term")).distinct()
    return expansion(terms, spark)


def corpus_bigrams(spark, d):
    """(first, second, n): neighbouring words of a text."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.element_at("w", i).alias("first"), F.element_at("w", i + 1).alias("second")))
    texts = _versions(spark, d).select(words(F.col("text")).alias("w")).where(F.size("w") > 1)
    return texts.select(F.inline(pairs)).groupBy("first", "second").agg(F.count("*").alias("n"))


def _fold(x: str) -> str:
    bare = f"CASE WHEN replace({x}, '''', '') = '' THEN {x} ELSE replace({x}, '''', '') END"
    return f"(CASE WHEN length({bare}) >= 7 THEN regexp_replace({bare}, '([iy])s(e|ed|es|ing|ation|ations)$', '\\1z\\2') ELSE {bare} END)"


def _words(x: str) -> str:
    return f"list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_\\x{{0600}}-\\x{{06FF}}'']+'), lambda w: {_fold('w')})"


_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_BAG = f"""{PROV}, def AS (SELECT DISTINCT w[1] AS term FROM (SELECT {_words('heading')} AS w FROM prov) WHERE len(w) = 1),
drop AS (SELECT coalesce(list(x), []) AS stop FROM (SELECT unnest({_STOP}) AS x) WHERE x NOT IN (SELECT term FROM def)),
bag AS (SELECT version_id, in_force_from, in_force_to, list_filter({_words('text')}, lambda w: NOT list_contains(stop, w)) AS t, list_filter({_words('heading')}, lambda w: NOT list_contains(stop, w)) AS h,
  lower(coalesce(number, '')) AS num FROM prov, drop),
docs AS (SELECT version_id, in_force_from, in_force_to, t || h || h || [num, num, num] AS b FROM bag),
post AS (SELECT version_id, in_force_from, in_force_to, len(b) AS dl, x AS token, count(*) AS tf FROM (SELECT version_id, in_force_from, in_force_to, b, unnest(b) AS x FROM docs) GROUP BY ALL)"""
_STATS = f"""stat AS (SELECT as_of, count(version_id) AS n, coalesce(sum(len(b)) / count(version_id), 0.0) AS mean_len FROM (SELECT DISTINCT as_of FROM benchmark) LEFT JOIN docs ON {LIVE.format('as_of')} GROUP BY as_of)"""
_SUFFIX = ", ".join(f"('{s}')" for s in SUFFIXES)


def _stem_sql(source: str) -> str:
    """(term, stem) of a relation with a column term."""
    cut = f"SELECT term, term[1 : length(term) - length(s)] AS st FROM {source}, (VALUES {_SUFFIX}) v(s) WHERE regexp_full_match(term, '[a-z]+') AND ends_with(term, s) AND length(term) - length(s) >= 3"
    return f"(SELECT term, term AS stem FROM {source} UNION SELECT term, st FROM ({cut}) UNION SELECT term, st[1 : length(st) - 1] FROM ({cut}) WHERE st[-1] = st[-2])"


_FRAME = "[" + ", ".join(f"'{w}'" for w in decide.FRAME) + "]"
_RELATED = ", ".join(f"('{a}', '{b}')" for a, b in related_words())

_EXPANDED = f"""q AS (SELECT item_id, as_of, len(l) AS asked, unnest(l) AS term FROM (SELECT item_id, as_of, list_distinct(list_filter({_words('text')}, lambda w: NOT list_contains(stop, w))) AS l FROM benchmark, drop)), qt AS (SELECT DISTINCT term FROM q),
      own AS {_stem_sql('qt')}, rel(term, related) AS (VALUES {_RELATED}), rs AS {_stem_sql('(SELECT DISTINCT term FROM rel)')}, br AS (SELECT DISTINCT own.term AS q, rel.related AS term FROM own JOIN rs ON own.stem = rs.stem JOIN rel ON rel.term = rs.term),
      bs AS {_stem_sql('(SELECT DISTINCT term FROM br)')}, ex AS (SELECT term, stem FROM own UNION SELECT br.q, bs.stem FROM br JOIN bs USING (term)), vs AS {_stem_sql('(SELECT DISTINCT token AS term FROM post)')},
      tt AS (SELECT DISTINCT ex.term, vs.term AS token FROM ex JOIN vs ON ex.stem = vs.stem UNION SELECT term, term FROM qt),
      forms AS (SELECT item_id, as_of, asked, q.term, token FROM q JOIN tt ON tt.term = q.term),
      live AS (SELECT f.*, version_id, tf, dl, count(*) OVER (PARTITION BY item_id, f.term, f.token) AS df FROM forms f JOIN post ON f.token = post.token AND {LIVE.format('as_of')}),
      th AS (SELECT item_id, version_id, asked, term, max(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / CASE WHEN mean_len > 0 THEN mean_len ELSE 1 END))) AS w FROM live JOIN stat USING (as_of) GROUP BY ALL),
      sc AS (SELECT item_id, version_id, asked, sum(w) AS score, count(*) AS matched, count(*) / any_value(asked) AS coverage FROM th GROUP BY item_id, version_id, asked),
      hw AS (SELECT DISTINCT version_id, unnest(h) AS token FROM bag), hn AS (SELECT version_id, count(*) AS hs FROM hw GROUP BY ALL),
      hc AS (SELECT item_id, version_id, count(DISTINCT term) / any_value(asked) * count(DISTINCT token) / any_value(hs) AS hc FROM sc JOIN hw USING (version_id) JOIN hn USING (version_id) JOIN (SELECT item_id, term, token FROM forms) USING (item_id, token) GROUP BY ALL),
      pos AS (SELECT version_id, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM bag),
      pp AS (SELECT DISTINCT item_id, version_id, th.term, p FROM th JOIN (SELECT item_id, term, token FROM forms) USING (item_id, term) JOIN pos USING (version_id, token)),
      fo AS (SELECT item_id, version_id, count(DISTINCT term) AS found FROM pp GROUP BY ALL HAVING count(DISTINCT term) >= 2),
      en AS (SELECT a.item_id, a.version_id, a.p AS e, b.term, max(b.p) AS s FROM (SELECT DISTINCT item_id, version_id, p FROM pp SEMI JOIN fo USING (item_id, version_id)) a JOIN pp b ON a.item_id = b.item_id AND a.version_id = b.version_id AND b.p <= a.p GROUP BY ALL),
      wi AS (SELECT item_id, version_id, min(width) AS width FROM (SELECT item_id, version_id, e - min(s) AS width, count(*) AS c FROM en GROUP BY item_id, version_id, e) JOIN fo USING (item_id, version_id) WHERE c = found GROUP BY ALL),
      rk AS (SELECT sc.*, coalesce(hc, 0.0) AS heading_coverage, coalesce((found - 1) / greatest(width, found - 1) * found / matched, 0.0) AS tightness FROM sc LEFT JOIN hc USING (item_id, version_id) LEFT JOIN fo USING (item_id, version_id) LEFT JOIN wi USING (item_id, version_id)),
      top AS (SELECT *, score * (1 + 1.5 * heading_coverage) * (1 + 0.5 * tightness) AS ranking, row_number() OVER (PARTITION BY item_id ORDER BY coverage DESC, round(score * (1 + 1.5 * heading_coverage) * (1 + 0.5 * tightness), 6) DESC, version_id) AS position FROM rk),
      fd AS (SELECT item_id, as_of, term, token, any_value(df) AS df FROM live GROUP BY ALL),
      tw AS (SELECT f.item_id, f.term, max(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))) AS weight FROM forms f JOIN stat USING (as_of) LEFT JOIN fd USING (item_id, term, token) GROUP BY ALL HAVING sum(coalesce(df, 0)) > 0),
      inf AS (SELECT item_id, any_value(version_id) AS version_id, sum(CASE WHEN th.term IS NOT NULL THEN tw.weight ELSE 0 END) / sum(tw.weight) AS information FROM (SELECT item_id, version_id FROM top WHERE position = 1) JOIN tw USING (item_id) LEFT JOIN (SELECT item_id, version_id, term FROM th) th USING (item_id, version_id, term) GROUP BY item_id)"""

QUERIES = {
    f.__name__: f
    for f in (
        term_frequency, document_frequency, epoch_document_frequency, snapshot_statistics, bm25_coverage_sort, bm25_top_k, information_coverage, key_term_missing,
        absent_terms, defined_terms, stem_dictionary, query_expansion, corpus_bigrams,
    )
}

SQL = {
    "term_frequency": f"WITH {_BAG} SELECT version_id, token, tf FROM post",
    "document_frequency": f"WITH {_BAG} SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY token",
    "epoch_document_frequency": f"""WITH {_BAG}, s AS (SELECT token, in_force_from AS day, 1 AS d FROM post UNION ALL SELECT token, in_force_to, -1 FROM post WHERE in_force_to IS NOT NULL),
      g AS (SELECT token, day, sum(d) AS d FROM s GROUP BY ALL) SELECT token, strftime(day, '%Y-%m-%d') AS day, CAST(sum(d) OVER (PARTITION BY token ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS df FROM g""",
    "snapshot_statistics": f"WITH {_BAG}, {_STATS} SELECT strftime(as_of, '%Y-%m-%d') AS as_of, n, round(mean_len, 4) AS mean_len FROM stat",
    "bm25_coverage_sort": f"""WITH {_BAG}, {_STATS}, q AS (SELECT item_id, as_of, unnest(list_distinct(list_filter({_words('text')}, lambda w: NOT list_contains(stop, w)))) AS token FROM benchmark, drop),
      live AS (SELECT q.item_id, q.as_of, q.token, version_id, tf, dl, count(*) OVER (PARTITION BY item_id, q.token) AS df FROM q JOIN post ON q.token = post.token AND {LIVE.format('as_of')}),
      sc AS (SELECT item_id, version_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / CASE WHEN mean_len > 0 THEN mean_len ELSE 1 END))) AS score, count(*) AS matched FROM live JOIN stat USING (as_of) GROUP BY ALL),
      rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY matched DESC, round(score, 4) DESC, version_id) AS position FROM sc)
      SELECT item_id, CAST(position AS INTEGER) AS position, version_id, round(score, 4) AS score, matched FROM rk WHERE position <= 5""",
    "bm25_top_k": f"""WITH {_BAG}, {_STATS}, {_EXPANDED} SELECT item_id, CAST(position AS INTEGER) AS position, version_id, round(score, 4) AS score, round(coverage, 4) AS coverage, round(heading_coverage, 4) AS heading_coverage,
      round(tightness, 4) AS tightness, round(ranking, 4) AS ranking FROM top WHERE position <= 5""",
    "information_coverage": f"WITH {_BAG}, {_STATS}, {_EXPANDED} SELECT item_id, version_id, round(information, 4) AS information_coverage FROM inf",
    "key_term_missing": f"""WITH {_BAG}, {_STATS}, {_EXPANDED}, kt AS (SELECT item_id, max(struct_pack(w := weight, t := term)) FILTER (NOT list_contains({_FRAME}, term)) AS m, count(*) AS n FROM tw GROUP BY item_id)
      SELECT item_id, m.t AS term FROM kt JOIN inf USING (item_id) WHERE n >= 2 AND round(information, 6) < 0.6 AND m IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM th WHERE th.item_id = kt.item_id AND th.version_id = inf.version_id AND th.term = m.t)""",
    "absent_terms": f"""WITH {_BAG}, q AS (SELECT DISTINCT item_id, as_of, unnest(list_filter({_words('text')}, lambda w: NOT list_contains(stop, w))) AS term FROM benchmark, drop), qt AS (SELECT DISTINCT term FROM q),
      own AS {_stem_sql('qt')}, rel(term, related) AS (VALUES {_RELATED}), rs AS {_stem_sql('(SELECT DISTINCT term FROM rel)')}, br AS (SELECT DISTINCT own.term AS q, rel.related AS term FROM own JOIN rs ON own.stem = rs.stem JOIN rel ON rel.term = rs.term),
      bs AS {_stem_sql('(SELECT DISTINCT term FROM br)')}, ex AS (SELECT term, stem FROM own UNION SELECT br.q, bs.stem FROM br JOIN bs USING (term)),
      w AS (SELECT DISTINCT in_force_from, in_force_to, unnest({_words('text')} || {_words('heading')}) AS term FROM prov), ws AS {_stem_sql('(SELECT DISTINCT term FROM w)')},
      h AS (SELECT DISTINCT ex.term, in_force_from, in_force_to FROM ex JOIN ws ON ex.stem = ws.stem JOIN w ON w.term = ws.term)
      SELECT item_id, term FROM q WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.term = q.term AND {LIVE.format('q.as_of')})""",
    "defined_terms": f"WITH {_BAG} SELECT term FROM def",
    "stem_dictionary": f"WITH {PROV}, v AS (SELECT DISTINCT unnest({_words('text')}) AS term FROM prov) SELECT term, stem FROM {_stem_sql('v')}",
    "query_expansion": f"""WITH qt AS (SELECT DISTINCT term FROM (SELECT unnest({_words('text')}) AS term FROM benchmark) WHERE NOT list_contains({_STOP}, term)),
      own AS {_stem_sql('qt')}, rel(term, related) AS (VALUES {_RELATED}), rs AS {_stem_sql('(SELECT DISTINCT term FROM rel)')}, br AS (SELECT DISTINCT own.term AS q, rel.related AS term FROM own JOIN rs ON own.stem = rs.stem JOIN rel ON rel.term = rs.term),
      bs AS {_stem_sql('(SELECT DISTINCT term FROM br)')} SELECT term, stem FROM own UNION SELECT br.q, bs.stem FROM br JOIN bs USING (term)""",
    "corpus_bigrams": f"""WITH {PROV}, t AS (SELECT {_words('text')} AS w FROM prov), p AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: {{'first': w[i], 'second': w[i + 1]}})) AS p FROM t)
      SELECT p.first AS first, p.second AS second, count(*) AS n FROM p GROUP BY ALL""",
}


def _decided(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from tempolex.operators.decide import decisions

    v = t.versions(table(spark, d, "sample_corpus"), [*COLUMNS, "start_known"])
    keys = [row.statute for row in table(spark, d, "acts").select("statute").collect()]  # the fixed list of Acts
    return decisions(_questions(spark, d), v, r.build_index(v), keys), v


def answer_end_to_end(spark, d):
    """What becomes of every benchmark item asked as a question: answered, or why not."""
    return _decided(spark, d)[0]


def quality_scoreboard(spark, d):
    from tempolex.operators.decide import scoreboard

    decided, v = _decided(spark, d)
    return scoreboard(decided, table(spark, d, "benchmark").select("item_id", "suite", "expected_citation"), v)


def question_scope(spark, d):
    """Of every benchmark item asked as a question: the Act or country it names that is not held, and the held Act it keeps to."""
    keys = [row.statute for row in table(spark, d, "acts").select("statute").collect()]  # the fixed list of Acts
    return named_acts(_questions(spark, d), _versions(spark, d), keys).select("item_id", "unheld", F.coalesce("scope", F.lit("")).alias("scope"))


def answers_written(spark, d):
    """What is served to every benchmark item: the citation written out, its heading, and what the record says of it on the date."""
    decided, _ = _decided(spark, d)
    v = t.versions(table(spark, d, "sample_corpus"), [*COLUMNS, "superseded_by", "manner", "start_known", "end_known"])
    served = decide.answers(decided, _questions(spark, d), v)
    return served.select("item_id", "status", *[F.coalesce(c, F.lit("")).alias(c) for c in ("citation", "heading", "status_note")])


QUERIES |= {f.__name__: f for f in (answer_end_to_end, quality_scoreboard, question_scope, answers_written)}
