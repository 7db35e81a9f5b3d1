"""Full-text ranking of versions for many questions and dates at once.

One index holds every version with its period. A question sees the versions in force on its date: document
frequencies, their number and their mean length are those of that snapshot, whatever filter applies to the documents.
Words a heading of one word defines stay in questions and texts although they are stop words; they are taken over the
whole record rather than anew for each date.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempolex.functions.analysis import expansion, stems, without_stopwords, words
from tempolex.operators.temporal import in_force
from tempolex.session import materialise

# The constants of the ranking.
K1, B = 1.5, 0.75
HEADING_REPEAT, NUMBER_REPEAT = 2, 3
HEADING_WEIGHT, PROXIMITY_WEIGHT = 1.5, 0.5


def defined_terms(versions: DataFrame) -> DataFrame:
    """(term): the only word of a heading of one word."""
    return versions.select(words(F.col("heading")).alias("w")).where(F.size("w") == 1).select(F.col("w")[0].alias("term")).distinct()


def defined_stopwords(versions: DataFrame) -> list[str]:
    """The defined terms that are stop words: at most as many as there are stop words."""
    from tempolex.functions.analysis import STOPWORDS

    return sorted(r.term for r in defined_terms(versions).where(F.col("term").isin(STOPWORDS)).collect())


def analysed(versions: DataFrame, defined: list[str]) -> DataFrame:
    """Adds text_tokens, heading_tokens and bag: the text, the heading twice and the number three times."""
    t, h = without_stopwords(words(F.col("text")), defined), without_stopwords(words(F.col("heading")), defined)
    number = F.array_repeat(F.lower(F.coalesce("number", F.lit(""))), NUMBER_REPEAT)
    return versions.withColumns({"text_tokens": t, "heading_tokens": h}).withColumn("bag", F.concat("text_tokens", F.flatten(F.array_repeat("heading_tokens", HEADING_REPEAT)), number))


def postings(docs: DataFrame) -> DataFrame:
    """(version_id, statute, token, tf, len, in_force_from, in_force_to) of the bags. Rows of one version are placed together before the words are spread out."""
    statute = F.col("statute") if "statute" in docs.columns else F.lit(None).cast("string").alias("statute")
    rows = docs.select("version_id", statute, F.size("bag").alias("len"), "in_force_from", "in_force_to", F.explode("bag").alias("token"))
    return rows.groupBy("version_id", "statute", "token", "len", "in_force_from", "in_force_to").agg(F.count("*").alias("tf"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def epoch_document_frequency(posts: DataFrame) -> DataFrame:
    """(token, day, df): how many versions in force hold the token from each of its own boundaries on."""
    steps = posts.select("token", F.explode(F.array(F.struct(F.col("in_force_from").alias("day"), F.lit(1).alias("d")), F.struct(F.col("in_force_to").alias("day"), F.lit(-1).alias("d")))).alias("s")).where("s.day is not null")
    daily = steps.groupBy("token", F.col("s.day").alias("day")).agg(F.sum("s.d").alias("d"))
    return daily.select("token", "day", F.sum("d").over(Window.partitionBy("token").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("df"))


def snapshot_statistics(docs: DataFrame, dates: DataFrame) -> DataFrame:
    """(as_of, n, mean_len) for each date: running sums over the days on which anything begins or ends.

    The window runs over calendar days, a bounded number however large the record.
    """
    size = F.size("bag").cast("bigint")
    begin = docs.select(F.col("in_force_from").alias("day"), F.lit(1).alias("n"), size.alias("s"))
    end = docs.where("in_force_to is not null").select(F.col("in_force_to").alias("day"), F.lit(-1).alias("n"), -size)
    daily = begin.union(end).groupBy("day").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.lit(False).alias("asked"))
    asked = dates.select(F.col("as_of").alias("day"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("s"), F.lit(True).alias("asked")).distinct()
    w = Window.orderBy("day", "asked").rowsBetween(Window.unboundedPreceding, 0)
    sums = daily.union(asked).select("day", "asked", F.sum("n").over(w).alias("n"), F.sum("s").over(w).alias("s"))
    return sums.where("asked").select(F.col("day").alias("as_of"), "n", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.lit(0.0)).alias("mean_len"))


def question_terms(questions: DataFrame, defined: list[str]) -> DataFrame:
    """(item_id, as_of, scope, asked, t, term): the distinct terms of each question, their number and their places. scope is the statute a question keeps to, null for all."""
    terms = F.array_distinct(without_stopwords(words(F.col("question")), defined))
    scope = F.col("scope") if "scope" in questions.columns else F.lit(None).cast("string").alias("scope")
    q = questions.select("item_id", "as_of", scope, terms.alias("terms"))
    return q.select("item_id", "as_of", "scope", F.size("terms").alias("asked"), F.posexplode("terms").alias("t", "term"))


def question_forms(terms: DataFrame, posts: DataFrame, expand: bool = True) -> DataFrame:
    """(item_id, as_of, scope, asked, t, term, token): the indexed tokens that count as each term."""
    if not expand:
        return terms.withColumn("token", F.col("term"))
    vocabulary = posts.select("token").distinct().select("token", F.explode(stems(F.col("token"))).alias("stem"))
    forms = expansion(terms, terms.sparkSession).join(vocabulary, "stem").select("term", "token").distinct()
    own = terms.select("term", F.col("term").alias("token")).distinct()
    return terms.join(forms.unionByName(own).distinct(), "term")


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def live_frequency(asked: DataFrame, posts: DataFrame) -> DataFrame:
    """(as_of, token, df): versions in force on each date that hold the token, of the asked (as_of, token). Counted before the shuffle."""
    held = posts.select("token", "in_force_from", "in_force_to")
    return asked.select("as_of", "token").distinct().join(held, "token").where(in_force(F.col("as_of"))).groupBy("as_of", "token").agg(F.count("*").alias("df"))


def term_hits(forms: DataFrame, posts: DataFrame, statistics: DataFrame) -> DataFrame:
    """(item_id, version_id, t, weight): BM25 of each term, by its place, in each version in force; the best form counts.

    Frequencies are those of the whole snapshot, whatever statute a question keeps to: that filter comes behind them.
    Rows are placed by question and version, where they also stay for scored.
    """
    rated = materialise(forms.join(live_frequency(forms, posts), ["as_of", "token"]).join(statistics, "as_of"), "forms-rated")
    rated = rated.select("item_id", "as_of", "scope", "t", "token", idf(F.col("n"), F.col("df")).alias("idf"), F.when(F.col("mean_len") > 0, F.col("mean_len")).otherwise(1.0).alias("mean"))
    live = rated.join(posts, "token").where(in_force(F.col("as_of")) & (F.col("scope").isNull() | (F.col("scope") == F.col("statute"))))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    placed = live.select("item_id", "version_id", "t", weight.alias("weight")).repartition("item_id", "version_id")
    return placed.groupBy("item_id", "version_id", "t").agg(F.max("weight").alias("weight"))


#: Places of terms that one number of a mask holds.
MASK = 63


def scored(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """(item_id, version_id, score, matched, asked, coverage, mask): summed weights and the share of the question's terms.

    mask has a bit for the place of each matched term: numbers only, for these are the rows of every hit.
    """
    asked = terms.select("item_id", "asked").distinct()
    most = terms.agg(F.max("asked")).first()[0] or 1
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("t") % MASK)
    masks = [F.bit_or(F.when(F.floor(F.col("t") / MASK) == k, bit).otherwise(F.lit(0).cast("bigint"))) for k in range(-(-most // MASK))]
    sums = hits.groupBy("item_id", "version_id").agg(F.sum("weight").alias("score"), F.count("*").alias("matched"), *[m.alias(f"m{k}") for k, m in enumerate(masks)])
    named = sums.select("item_id", "version_id", "score", "matched", F.array(*[f"m{k}" for k in range(len(masks))]).alias("mask"))
    return named.join(asked, "item_id").withColumn("coverage", F.col("matched") / F.col("asked"))


def with_terms(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """Puts the matched terms, in order of the alphabet, in the place of the mask."""
    all_of = terms.groupBy("item_id").agg(F.collect_list(F.struct("t", "term")).alias("_all"))
    held = F.filter("_all", lambda x: F.call_function("shiftright", F.element_at("mask", (F.floor(x["t"] / MASK) + 1).cast("int")), x["t"] % MASK).bitwiseAND(1) == 1)
    return hits.join(all_of, "item_id").withColumn("terms", F.sort_array(F.transform(held, lambda x: x["term"]))).drop("mask", "_all")


#: The ranking is the score times at least 1 and at most this.
MOST_BOOST = (1 + HEADING_WEIGHT) * (1 + PROXIMITY_WEIGHT)


def leading(hits: DataFrame, k: int) -> DataFrame:
    """The hits that can be among the k best of their question, by coverage and then ranking.

    The k-th by coverage and score is a bar: a hit of less coverage is out, and one of the same coverage whose score
    stays below the bar's even with the largest boosts. The k first of each task go into the shuffle, no more.
    """
    kth = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("coverage"), F.desc("score"), "version_id"))
    bar = hits.select("item_id", "coverage", "score", "version_id").withColumn("r", kth).where(F.col("r") <= k).groupBy("item_id").agg(F.min(F.struct("coverage", "score")).alias("bar"))
    near = (F.col("coverage") > F.col("bar.coverage")) | ((F.col("coverage") == F.col("bar.coverage")) & (F.col("score") * MOST_BOOST + 1e-5 >= F.col("bar.score")))
    return hits.join(bar, "item_id").where(near).drop("bar")


def smallest_window(places: list[list[int]]) -> int | None:
    """Width of the smallest stretch with one place of every list."""
    ends = sorted((p, k) for k, ps in enumerate(places) for p in ps)
    last: dict[int, int] = {}
    best = None
    for p, k in ends:
        last[k] = p
        if len(last) == len(places):
            width = p - min(last.values())
            best = width if best is None else min(best, width)
    return best


def tightness(places: list[list[int]], matched: int) -> float:
    """1.0 where all matched terms stand side by side; 0 for fewer than two with a place in the text."""
    found = [list(p) for p in places if len(p)]
    if len(found) < 2:
        return 0.0
    nearest = len(found) - 1
    return nearest / max(smallest_window(found), nearest) * len(found) / matched


def with_proximity(hits: DataFrame, forms: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds tightness, heading_coverage and ranking. Only the places of matched words leave the JVM."""
    by_term = forms.groupBy("item_id", "term").agg(F.collect_set("token").alias("tokens")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "tokens"))).alias("forms"))
    placed = hits.join(by_term, "item_id").join(docs.select("version_id", "text_tokens", F.array_distinct("heading_tokens").alias("heading_set")), "version_id")
    asked_forms = F.flatten(F.map_values("forms"))
    in_heading = F.size(F.filter(F.map_values("forms"), lambda ts: F.arrays_overlap(ts, F.col("heading_set"))))
    heading_hits = F.size(F.filter("heading_set", lambda h: F.array_contains(asked_forms, h)))
    heading_coverage = F.when(F.size("heading_set") > 0, in_heading / F.col("asked") * heading_hits / F.size("heading_set")).otherwise(F.lit(0.0))
    at = F.filter(F.transform("text_tokens", lambda x, i: F.when(F.array_contains("held", x), F.struct(i.alias("at"), x.alias("token")))), lambda x: x.isNotNull())

    rows = placed.withColumns({"heading_coverage": heading_coverage, "term_forms": F.transform("terms", lambda t: F.element_at("forms", t))})
    rows = rows.withColumn("held", F.flatten("term_forms")).withColumn("places", at)
    rows = rows.select("item_id", "version_id", "score", "coverage", "matched", "terms", "heading_coverage", "term_forms", F.col("places.at").alias("at"), F.col("places.token").alias("token"))
    out = rows.mapInArrow(_add_tightness, "item_id bigint, version_id bigint, score double, coverage double, matched bigint, terms array<string>, heading_coverage double, tightness double")
    return out.withColumn("ranking", F.col("score") * (1 + HEADING_WEIGHT * F.col("heading_coverage")) * (1 + PROXIMITY_WEIGHT * F.col("tightness")))


def _add_tightness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tight = []
        for forms, at, tokens, matched in zip(*(b.column(c).to_pylist() for c in ("term_forms", "at", "token", "matched"))):
            terms_of: dict[str, list[int]] = {}
            for k, words_of_term in enumerate(forms):
                for w in words_of_term:
                    terms_of.setdefault(w, []).append(k)
            places: list[list[int]] = [[] for _ in forms]
            for place, w in zip(at, tokens):
                for k in terms_of[w]:
                    places[k].append(place)
            tight.append(tightness(places, matched))
        yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(tight, pa.float64())], names=[*b.schema.names[:-3], "tightness"])


def build_index(versions: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """(analysed versions, postings, defined stop words), written once to the shared folder: every question reads them."""
    defined = defined_stopwords(versions)
    docs = materialise(analysed(versions.select("version_id", *[c for c in ("statute",) if c in versions.columns], "number", "heading", "text", "in_force_from", "in_force_to"), defined).drop("text", "heading"), "index")
    return docs, materialise(postings(docs), "postings"), defined


def top_hits(questions: DataFrame, index: tuple[DataFrame, DataFrame, list[str]], k: int = 5, expand: bool = True) -> DataFrame:
    """(item_id, position, version_id, score, coverage, heading_coverage, tightness, ranking): the k best versions per question.

    Sorted by coverage, then ranking to the sixth decimal (sums of fractions depend on their order), then version_id.
    Questions without terms or hits give no rows; null texts and headings hold no words.
    """
    docs, posts, defined = index
    terms = materialise(question_terms(questions, defined), "terms")
    forms = materialise(question_forms(terms, posts, expand), "forms")
    hits = materialise(scored(term_hits(forms, posts, snapshot_statistics(docs, questions)), terms), "scored")
    ranked = with_proximity(with_terms(leading(hits, k), terms), forms, docs)
    w = Window.partitionBy("item_id").orderBy(F.desc("coverage"), F.desc(F.round("ranking", 6)), "version_id")
    return ranked.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def why(hits: DataFrame, weights: DataFrame) -> DataFrame:
    """(item_id, version_id, why) of hits with terms: 'n of m terms' and the five heaviest matched ones, or that one alone where the question has one."""
    each = hits.select("item_id", "version_id", "asked", F.explode("terms").alias("term")).join(weights, ["item_id", "term"])
    heavy = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term"))), 1, 5)
    named = F.array_join(F.transform("h", lambda x: F.format_string("%s (%.2f)", x["term"], -x["w"])), ", ")
    listed = each.groupBy("item_id", "version_id", "asked").agg(heavy.alias("h"), F.count("*").alias("n"))
    return listed.select("item_id", "version_id", F.when(F.col("asked") > 1, F.concat(F.format_string("%d of %d terms: ", "n", "asked"), named)).otherwise(named).alias("why"))


def term_weights(forms: DataFrame, posts: DataFrame, statistics: DataFrame) -> DataFrame:
    """(item_id, term, weight): the largest idf over a term's forms, of terms with a form in force; unseen spellings have df 0."""
    live = forms.join(posts, "token", "left")
    seen = live.groupBy("item_id", "as_of", "term", "token").agg(F.count_if(in_force(F.col("as_of")) & F.col("version_id").isNotNull()).alias("df")).join(statistics, "as_of")
    return seen.groupBy("item_id", "term").agg(F.max(idf(F.col("n"), F.col("df"))).alias("weight"), F.sum("df").alias("held")).where("held > 0").drop("held")


def absent_terms(questions: DataFrame, versions: DataFrame) -> DataFrame:
    """(item_id, term): question terms of which no form, stem or related word occurs in any version in force on the date."""
    terms = question_terms(questions, defined_stopwords(versions))
    asked = materialise(expansion(terms, terms.sparkSession), "asked-stems")  # as many rows as the questions have stems
    spoken = versions.select("in_force_from", "in_force_to", F.explode(F.array_distinct(F.concat(words(F.col("text")), words(F.col("heading"))))).alias("w"))
    stemmed = spoken.groupBy("w", "in_force_from", "in_force_to").agg(F.lit(1)).select("in_force_from", "in_force_to", F.explode(stems(F.col("w"))).alias("stem"))
    held = stemmed.join(asked, "stem").select("term", "in_force_from", "in_force_to").distinct()
    seen = terms.join(held, "term").where(in_force(F.col("as_of"))).select("item_id", "term").distinct()
    return terms.join(seen, ["item_id", "term"], "left_anti").select("item_id", "term")
