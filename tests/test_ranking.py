import datetime as dt
import math
import random

import pytest

from tempolex.operators import ranking as r

D = dt.date(2000, 1, 1)
SCHEMA = "version_id bigint, number string, heading string, text string, in_force_from date, in_force_to date"


def versions(spark, rows):
    return spark.createDataFrame([(i, n, h, x, D, None) for i, n, h, x in rows], SCHEMA)


def ask(spark, questions):
    return spark.createDataFrame([(i, q, dt.date(2010, 1, 1)) for i, q in enumerate(questions)], "item_id bigint, question string, as_of date")


def test_worked_example(spark):
    v = versions(spark, [(1, "1", "kado milu", "kado tano milu vopu kado"), (2, "2", "tano zulu", "milu vopu tano tano zulu kado milu"), (3, "3", "vopu zulu", "zulu vopu zulu")])
    got = r.top_hits(ask(spark, ["kado milu zulu"]), r.build_index(v)).orderBy("position").collect()
    want = [(2, 1.8265, 1.0, 0.1667, 1.0, 3.4247), (1, 1.6379, 0.6667, 0.6667, 0.5, 4.0947), (3, 0.8847, 0.3333, 0.1667, 0.0, 1.1059)]
    assert [(x.version_id, round(x.score, 4), round(x.coverage, 4), round(x.heading_coverage, 4), round(x.tightness, 4), round(x.ranking, 4)) for x in got] == want


@pytest.mark.parametrize("seed", range(3))
def test_scores_by_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocabulary = "kado milu tano vopu zulu".split()
    rows = [(i, str(i), "", " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 12)))) for i in range(1, 25)]
    question = "kado zulu"
    bags = {i: x.split() + [n] * 3 for i, n, _, x in rows}
    mean = sum(map(len, bags.values())) / len(bags)
    want = {}
    for i, bag in bags.items():
        for term in question.split():
            df = sum(term in b for b in bags.values())
            tf = bag.count(term)
            if tf:
                want[i] = want.get(i, 0) + math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(bag) / mean))
    got = {x.version_id: x.score for x in r.top_hits(ask(spark, [question]), r.build_index(versions(spark, rows)), k=100).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_related_words_and_nulls(spark):
    v = versions(spark, [(1, "302", "Qatl", "whoever causes qatl"), (2, "5", None, None), (3, "6", "", "")])
    got = r.top_hits(ask(spark, ["murder", None, "", "unknownword"]), r.build_index(v)).collect()
    assert [(x.item_id, x.version_id) for x in got] == [(0, 1)]
    assert {(x.item_id, x.term) for x in r.absent_terms(ask(spark, ["murder unknownword"]), v).collect()} == {(0, "unknownword")}
    assert r.top_hits(ask(spark, ["murder"]), r.build_index(v.where("false"))).count() == 0


def test_smallest_window():
    assert r.smallest_window([[0, 9], [5], [7]]) == 4
    assert r.tightness([[3], [3]], 2) == 1.0
    assert r.tightness([[1], []], 2) == 0.0


def test_a_scope_keeps_the_statistics_of_the_whole_snapshot(spark):
    rows = [(1, "A", "1", "", "kado milu", D, None), (2, "B", "1", "", "kado milu", D, None), (3, "B", "2", "", "kado zulu", D, None)]
    v = spark.createDataFrame(rows, "version_id bigint, statute string, number string, heading string, text string, in_force_from date, in_force_to date")
    q = ask(spark, ["kado milu", "kado milu"]).selectExpr("*", "case when item_id = 1 then 'A' end scope")
    got = {(x.item_id, x.version_id): x.score for x in r.top_hits(q, r.build_index(v)).collect()}
    assert set(got) == {(0, 1), (0, 2), (0, 3), (1, 1)} and got[0, 1] == got[1, 1]


def test_more_terms_than_a_mask_holds(spark):
    terms = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(150)]
    v = versions(spark, [(1, "1", "", " ".join(terms[::2])), (2, "2", "", " ".join(terms[:5]))])
    got = r.top_hits(ask(spark, [" ".join(terms)]), r.build_index(v)).orderBy("position").collect()
    assert [(x.version_id, x.matched, x.coverage) for x in got] == [(1, 75, 0.5), (2, 5, 5 / 150)] and got[0].terms == sorted(terms[::2])


def test_defined_terms_stay(spark):
    v = versions(spark, [(1, "1", "Person", "a person means"), (2, "2", "Of sales", "sales"), (3, "3", None, "x")])
    assert {x.term for x in r.defined_terms(v).collect()} == {"person"} and r.defined_stopwords(v) == ["person"]
    assert [x.version_id for x in r.top_hits(ask(spark, ["person"]), r.build_index(v)).collect()] == [1]


def test_why(spark):
    hits = spark.createDataFrame([(1, 7, 3, ["a", "b"]), (2, 8, 1, ["c"])], "item_id bigint, version_id bigint, asked int, terms array<string>")
    weights = spark.createDataFrame([(1, "a", 0.5), (1, "b", 2.0), (1, "z", 9.0), (2, "c", 1.0)], "item_id bigint, term string, weight double")
    assert {x.item_id: x.why for x in r.why(hits, weights).collect()} == {1: "2 of 3 terms: b (2.00), a (0.50)", 2: "c (1.00)"}
