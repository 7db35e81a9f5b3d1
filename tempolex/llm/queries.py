"""Registered queries of the training-text operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempolex.functions.keys import token_text
from tempolex.llm.arrow import last_delivery
from tempolex.llm.elite import term_scores
from tempolex.llm.encoding import garbled_fields
from tempolex.llm.leakage import leaked_items, without_leaks
from tempolex.llm.neardup import components, members, record_pairs, similar_texts, with_text_id
from tempolex.llm.ngrams import mark_terms, ngram_counts
from tempolex.llm.residue import residue
from tempolex.llm.tokenize import encode_texts
from tempolex.session import materialise, table


def _records(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "sample_corpus").select(F.count_distinct("version_id")).first()[0]


def _corpus(spark: SparkSession, sf_dir: str, heading: bool) -> DataFrame:
    """(version_id, joined): the tokens of each record's text, with those of its heading in front if asked."""
    text = F.concat_ws("\n", F.col("heading"), F.col("text")) if heading else F.col("text")
    return last_delivery(table(spark, sf_dir, "sample_corpus"), {"joined": token_text(text)})


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_fields(table(spark, sf_dir, "sample_corpus"), "version_id", ["text", "heading"]).select("version_id", "field").distinct()


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled fields with their restored wording."""
    return garbled_fields(table(spark, sf_dir, "sample_corpus"), "version_id", ["text", "heading"]).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = term_scores(_corpus(spark, sf_dir, True), "version_id", "joined", _records(spark, sf_dir), min_tf=3, min_chars=4, records_between=(2, 8))
    return scores.select("version_id", "term")


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elite probability and score of every term of every record."""
    return term_scores(_corpus(spark, sf_dir, True), "version_id", "joined", _records(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_terms(ngram_counts(_corpus(spark, sf_dir, False), "joined"), _records(spark, sf_dir))
    return marked.where(F.col("mark") != "").select("term", "mark")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every n-gram of one to four tokens, with marks."""
    return mark_terms(ngram_counts(_corpus(spark, sf_dir, False), "joined", max_n=4), _records(spark, sf_dir))


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery with its tokens, written once: five stages read it."""
    joined = table(spark, sf_dir, "sample_corpus").select("version_id", "loaded_at", token_text(F.col("text")).alias("joined"))
    return materialise(with_text_id(joined, "joined"), "tokens")


def _members(deliveries: DataFrame) -> DataFrame:
    """The class of each record, by its last delivery."""
    last = F.max(F.struct("loaded_at", "text_id", "tokens"))
    records = deliveries.groupBy("version_id").agg(last.alias("r")).select("version_id", "r.text_id", "r.tokens")
    return members(records, "version_id", 20)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    deliveries = _deliveries(spark, sf_dir)
    pairs = similar_texts(deliveries, threshold=0.5, width=3)
    return record_pairs(pairs, _members(deliveries), "version_id").toDF("version_id_a", "version_id_b")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(version_id, class_id, links) of every record with a near-duplicate at five words and 0.8.

    links is the number of different texts linked with the record's; class_id is the smallest version of its group.
    """
    deliveries = _deliveries(spark, sf_dir)
    pairs = materialise(similar_texts(deliveries).select("a", "b"), "pairs")
    belongs = _members(deliveries)
    roots = components(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("text_id")).groupBy("text_id").agg(F.count("*").alias("links"))
    placed = belongs.join(roots.withColumnRenamed("node", "text_id"), "text_id", "left").join(degree, "text_id", "left")
    placed = placed.where((F.col("of") > 1) | F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "text_id"))
    heads = placed.groupBy("root").agg(F.min("version_id").alias("class_id"))
    return placed.join(heads, "root").select("version_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long and how much of each item a document holds."""
    return _leaks(spark, sf_dir).drop("spans")


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with leaks, the leaked spans cut out or the document dropped."""
    return without_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", _leaks(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id").distinct()


def p9_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds, number and coverage of the findings of each document, and whether it is to be excluded."""
    return residue(table(spark, sf_dir, "documents"), "doc_id", "text")


_TOKENS = "regexp_extract_all(lower(regexp_replace({0}, '[\\x{{AD}}\\x{{200B}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')), '[\\p{{L}}\\p{{N}}]+')"
_RECORDS = "rec AS (SELECT version_id, arg_max(heading, loaded_at) AS heading, arg_max(text, loaded_at) AS text FROM sample_corpus GROUP BY version_id)"

QUERIES = {
    "p1_found": p1_found, "p1_restored": p1_restored,
    "p3_found": p3_found, "p3_scores": p3_scores, "p4_found": p4_found, "p4_counts": p4_counts, "p6_found": p6_found, "p6_groups": p6_groups, "p7_ids": p7_ids,
    "p8_found": p8_found, "p8_runs": p8_runs, "p8_cleaned": p8_cleaned, "p9_found": p9_found, "p9_residue": p9_residue,
}

SQL = {
    "p3_found": f"""
WITH {_RECORDS}, tok AS (SELECT version_id, unnest({_TOKENS.format("concat_ws(chr(10), heading, text)")}) AS term FROM rec),
tf AS (SELECT version_id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL)
SELECT version_id, term FROM tf JOIN df USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 8 AND length(term) >= 4""",
    "p4_found": f"""
WITH {_RECORDS}, tok AS (SELECT DISTINCT version_id, unnest({_TOKENS.format("text")}) AS term FROM rec),
df AS (SELECT term, count(*) AS records FROM tok GROUP BY ALL), n AS (SELECT count(DISTINCT version_id) AS n FROM sample_corpus)
SELECT term, CASE WHEN records <= 2 THEN 'rare' ELSE 'common' END AS mark FROM df, n WHERE records <= 2 OR records > 0.3 * n""",
    "p4_counts": f"""
WITH {_RECORDS}, t AS (SELECT version_id, {_TOKENS.format("text")} AS l FROM rec WHERE text IS NOT NULL),
g AS (SELECT version_id, n::INTEGER AS n, unnest(list_transform(range(1, len(l) - n + 2), lambda i: array_to_string(l[i : i + n - 1], ' '))) AS term FROM t, range(1, 5) k(n)),
c AS (SELECT n, term, count(*) AS occurrences, count(DISTINCT version_id) AS records FROM g GROUP BY ALL),
a AS (SELECT count(DISTINCT version_id) AS al FROM sample_corpus)
SELECT n, term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.3 * al THEN 'common' ELSE '' END AS mark FROM c, a""",
    "p8_found": f"""
WITH d AS (SELECT doc_id, {_TOKENS.format("text")} AS l FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_TOKENS.format("text")} AS l FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(l) - 11), lambda k: array_to_string(l[k : k + 12], ' '))) AS g FROM d WHERE len(l) >= 13),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(l) - 11), lambda k: array_to_string(l[k : k + 12], ' '))) AS g FROM i WHERE len(l) >= 13)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
