"""Answer or refuse: every gate of a question is computed as a column, one CASE picks the first that holds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempolex.functions.analysis import QUALIFIERS, plain_words
from tempolex.functions.citations import citations
from tempolex.functions.naming import named_acts
from tempolex.operators import ranking as r
from tempolex.operators.audit import checked
from tempolex.operators.temporal import status_note
from tempolex.session import materialise
from tempolex.sources.splitting import buried_numbers, buried_offset

# The least score, the least share of information, the share above which a missing key term does not matter, the most passages shown.
MIN_SCORE, MIN_COVERAGE, KEY_CEILING, SHOWN = 1.0, 0.5, 0.60, 3
# Words that frame a question and are never its subject.
FRAME = """many much count counts long often exactly actually really mean means meaning meanings definition definitions happens called regarding concerning about
say says said tell tells told ask asks asked asking explain explains describe describes summarise summarize list lists show shows find finds look looks know knows
wondering wonder please get gets got getting do does did doing someone somebody something anything anyone everyone happen happened meant else instead whether never
always ever simply merely""".split()


def cited_status(questions: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """(item_id, cited, found): of questions that cite provisions, what the lookup says and the first cited version in force; a question that cites is never searched."""
    cited = citations(questions, "item_id", "question", keys).where("kind = 'statutory'").join(questions.select("item_id", "as_of"), "item_id")
    seen = checked(cited.select("item_id", "seq", "key", "kind", "statute", "named_statute", "as_of"), versions).groupBy("item_id").agg(
        F.collect_set("status").alias("s"), F.min(F.when(F.col("version_id").isNotNull(), F.struct("seq", "version_id"))).alias("f")
    )
    has = lambda *names: F.arrays_overlap("s", F.array(*[F.lit(n) for n in names]))
    return seen.select(
        "item_id",
        F.when(has("in_force", "amended_since"), "answered").when(has("not_in_force", "not_yet_in_force", "before_record"), "not_in_force")
        .when(has("unknown_provision"), "unknown_provision").when(has("act_not_recognised", "statute_not_loaded"), "act_not_recognised").otherwise("no_act_named").alias("cited"),
        F.col("f.version_id").alias("found"),
    )


def missing_qualifiers(asked: Column, matched: Column) -> Column:
    """Whether a question has a word that sets an offence apart which the hit does not match."""
    return F.size(F.array_except(F.array_intersect(asked, F.array(*[F.lit(q) for q in QUALIFIERS])), matched)) > 0


def _own_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, position, version_id, buried): of hits, the later headings inside the text where the words of the hit's own part do not carry the match."""
    for b in batches:
        rows = []
        for i, at, v, number, heading, text, forms in zip(*(c.to_pylist() for c in b.columns)):
            buried, cut = buried_numbers(number, text), buried_offset(number, text)
            own = set(plain_words(f"{heading or ''} {(text or '')[:cut]}")) if buried else set()
            supported = sum(1 for f in forms if own.intersection(f))
            rows.append((i, at, v, buried, not buried or supported > MIN_COVERAGE * len(forms)))
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["item_id", "position", "version_id", "buried", "supported"])


def passages(hits: DataFrame, forms: DataFrame, asked: DataFrame, versions: DataFrame) -> DataFrame:
    """(item_id, position, version_id, buried, supported) of the hits that may be shown.

    The first hit is always among them; others only if they reach the least score and more than the least share of the
    question's terms and miss no qualifier. A hit whose text runs on into later provisions names them in buried;
    supported says whether its own part and heading carry the match.
    """
    kept = hits.join(asked, "item_id").where((F.col("position") == 1) | ((F.col("coverage") > MIN_COVERAGE) & (F.col("score") >= MIN_SCORE) & ~missing_qualifiers(F.col("asked_terms"), F.col("terms"))))
    by_term = forms.groupBy("item_id", "term").agg(F.collect_set("token").alias("tokens")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "tokens"))).alias("forms"))
    rows = kept.join(by_term, "item_id").join(versions.select("version_id", "number", "heading", "text"), "version_id")
    rows = rows.select("item_id", F.col("position").cast("int"), "version_id", "number", "heading", "text", F.transform("terms", lambda t: F.element_at("forms", t)).alias("f"))
    return rows.mapInArrow(_own_share, "item_id bigint, position int, version_id bigint, buried array<string>, supported boolean")


def key_terms(weights: DataFrame) -> DataFrame:
    """(item_id, key_term, weights): the heaviest term that is no frame word, and how many terms have a weight."""
    own = F.when(~F.col("term").isin(FRAME), F.struct("weight", "term"))
    return weights.groupBy("item_id").agg(F.max(own).getField("term").alias("key_term"), F.count("*").alias("weights"))


def information(weights: DataFrame, best: DataFrame) -> DataFrame:
    """(item_id, information): the share of the weight of a question's terms that its best hit (item_id, matched) matches."""
    held = F.when(F.array_contains("matched", F.col("term")), F.col("weight")).otherwise(0.0)
    return weights.join(best.select("item_id", "matched"), "item_id").groupBy("item_id").agg((F.sum(held) / F.sum("weight")).alias("information"))


def decisions(questions: DataFrame, versions: DataFrame, index: tuple, keys: list[str]) -> DataFrame:
    """(item_id, status, version_id) of every question (item_id, question, as_of); version_id is the version served, 0 if none is.

    versions carries key, statute, number, heading, text, the period and start_known; index is ranking.build_index of
    it. A question that names an Act or country the record does not answer for is refused before anything else; one that
    cites is looked up; one that names a held Act is searched in that Act only, without the words of its name. A question
    without words refuses as nothing_matched.
    """
    docs, posts, defined = index
    named = materialise(named_acts(questions, versions, keys), "named")
    searched = questions.drop("question").join(named.select("item_id", "scope", F.col("rest").alias("question")), "item_id")
    terms = r.question_terms(searched, defined)
    forms = materialise(r.question_forms(terms, posts), "question-forms")
    weights = materialise(r.term_weights(forms, posts, r.snapshot_statistics(docs, questions)), "term-weights")
    hits = materialise(r.top_hits(searched, index, SHOWN), "hits")
    best = hits.where("position = 1").select("item_id", "version_id", "score", F.col("terms").alias("matched"))
    absent = r.absent_terms(searched, versions).where(~F.col("term").isin(FRAME)).select("item_id").distinct().withColumn("absent", F.lit(True))
    asked = terms.groupBy("item_id").agg(F.collect_list("term").alias("asked_terms"))
    shown = passages(hits, forms, asked, versions).where("supported").groupBy("item_id").agg(F.min(F.struct("position", "version_id")).alias("shown"))
    all_of = questions.select("item_id").join(named.select("item_id", "unheld"), "item_id", "left").join(cited_status(questions, versions, keys), "item_id", "left")
    for part in (best, absent, asked, information(weights, best), key_terms(weights), shown):
        all_of = all_of.join(part, "item_id", "left")
    is_absent = F.coalesce("absent", F.lit(False))
    missing_key = (F.col("weights") >= 2) & ~F.array_contains("matched", F.col("key_term")) & (F.col("information") < KEY_CEILING)
    status = (
        F.when(F.coalesce("unheld", F.lit("")) != "", "act_not_recognised")
        .when(F.col("cited").isNotNull(), F.col("cited"))
        .when(F.col("version_id").isNull() & is_absent, "subject_not_in_corpus")
        .when(F.col("version_id").isNull(), "nothing_matched")
        .when(F.col("score") < MIN_SCORE, "weak_match")
        .when(missing_qualifiers(F.col("asked_terms"), F.col("matched")), "different_offence")
        .when(is_absent, "subject_not_in_corpus")
        .when(missing_key, "weak_match")
        .when(F.coalesce("information", F.lit(0.0)) <= MIN_COVERAGE, "weak_match")
        .when(F.col("shown").isNull(), "citation_unreliable")
        .otherwise("answered")
    )
    served = F.when(F.col("status") != "answered", F.lit(0)).when(F.col("cited").isNotNull(), F.coalesce("found", F.lit(0))).otherwise(F.col("shown.version_id"))
    return all_of.withColumn("status", status).select("item_id", "status", served.cast("bigint").alias("version_id"))


def answers(decided: DataFrame, questions: DataFrame, versions: DataFrame) -> DataFrame:
    """(item_id, status, citation, heading, text, status_note) of every question: what was served, and what the record says of it on the date.

    citation is written out (Section 302 PPC, Order IX Rule 3 CPC); refused questions have nulls. versions carries
    statute, unit and number beside what status_note reads.
    """
    label = F.when((F.col("unit") == "rule") & F.col("number").contains("/"), F.concat(F.lit("Order "), F.split_part("number", F.lit("/"), F.lit(1)), F.lit(" Rule "), F.split_part("number", F.lit("/"), F.lit(2))))
    label = F.concat_ws(" ", F.coalesce(label, F.concat_ws(" ", F.initcap("unit"), "number")), "statute")
    served = decided.join(questions.select("item_id", "as_of"), "item_id").join(versions, "version_id", "left")
    held = F.col("statute").isNotNull()
    return served.select("item_id", "status", F.when(held, label).alias("citation"), "heading", "text", F.when(held, status_note(F.col("as_of"))).alias("status_note"))


def scoreboard(decided: DataFrame, expected: DataFrame, versions: DataFrame) -> DataFrame:
    """(suite, n, right, wrong, refused): expected(item_id, suite, expected_citation) against what was served; null expects a refusal."""
    named = decided.join(versions.select("version_id", "key"), "version_id", "left").join(expected, "item_id")
    answered = F.col("status") == "answered"
    right = F.when(F.col("expected_citation").isNull(), ~answered).otherwise(answered & F.coalesce(F.col("key") == F.col("expected_citation"), F.lit(False)))
    wrong = answered & ~right
    return named.groupBy("suite").agg(F.count("*").alias("n"), F.count_if(right).alias("right"), F.count_if(wrong).alias("wrong"), F.count_if(~right & ~wrong).alias("refused"))
