import datetime as dt

import pytest
from pyspark.sql import functions as F

from tempolex.operators import amend
from tempolex.operators import temporal as t

D = dt.date
SCHEMA = """version_id bigint, statute string, unit string, number string, key string, heading string, in_force_from date, in_force_to date, superseded_by string,
manner string, amended_by string, enacted_by string, start_known boolean, end_known boolean"""


def row(i, key, a, b=None, manner="", by="", enacted="", known=True, end_known=True):
    s, u, n = key.split(":")
    return (i, s, u, n, key, f"H{i}", a, b, "", manner, by, enacted, known, end_known)


@pytest.fixture(scope="module")
def v(spark):
    return spark.createDataFrame(
        [
            row(1, "PECA:section:20", D(2016, 8, 19), D(2022, 2, 20), "substituted", "Ordinance I of 2022"),
            row(2, "PECA:section:20", D(2022, 2, 20)),
            row(3, "PPC:section:302", D(1997, 4, 11), known=False),
            row(4, "PPC:section:9", D(1990, 1, 1), D(1995, 1, 1), "omitted", "Act II of 1995"),
            row(5, "PPC:section:9", D(2001, 1, 1), None, enacted="Act V of 2001"),
        ],
        SCHEMA,
    )


def test_boundary_day_belongs_to_the_new_version(v):
    assert [r.version_id for r in t.as_of(v.where("key = 'PECA:section:20'"), "2022-02-20").collect()] == [2]
    assert [r.version_id for r in t.as_of(v.where("key = 'PECA:section:20'"), "2022-02-19").collect()] == [1]


def test_changes(v):
    got = {(str(r.changed_on), r.key, r.event, r.instrument) for r in t.changes(v, "1990-01-01", "2030-01-01").collect()}
    assert got == {
        ("2016-08-19", "PECA:section:20", "commenced", ""), ("2022-02-20", "PECA:section:20", "substituted", "Ordinance I of 2022"), ("1997-04-11", "PPC:section:302", "commenced", ""),
        ("1990-01-01", "PPC:section:9", "commenced", ""), ("1995-01-01", "PPC:section:9", "omitted", "Act II of 1995"), ("2001-01-01", "PPC:section:9", "reinstated", "Act V of 2001"),
    }


def test_nearest_resolve_and_notes(spark, v):
    asked = spark.createDataFrame([(1, "PPC:section:9", D(1996, 1, 1)), (2, "PPC:section:302", D(1980, 1, 1)), (3, "PPC:section:302(1)(a)", D(2000, 1, 1)), (4, "X:section:1", D(2000, 1, 1))], "i int, key string, as_of date")
    assert {(r.i, r.version_id) for r in t.nearest(asked, "i", v).collect()} == {(1, 4), (2, 3)}
    assert {r.i: r.resolved for r in t.resolve(asked, v).collect()} == {1: "PPC:section:9", 2: "PPC:section:302", 3: "PPC:section:302", 4: "X:section:1"}
    notes = {r.version_id: r.note for r in v.select("version_id", t.status_note(F.lit("1996-06-01").cast("date")).alias("note")).collect()}
    assert notes[4] == "omitted on 1995-01-01" and notes[3].startswith("before the record") and notes[5] == "not in force until 2001-01-01"


def test_order_and_roman(spark):
    df = spark.createDataFrame([(n,) for n in ("11", "10A", "2", "IX/3", "Schedule", "10", "IV/12")], "number string")
    order = df.select("number", *t.provision_order(F.col("number"))).orderBy("order_scheme", "order_n", "order_suffix", "order_rule")
    assert [r.number for r in order.collect()] == ["2", "10", "10A", "11", "IV/12", "IX/3", "Schedule"]
    assert spark.range(1).select(t.roman(F.lit("XLIX"))).first()[0] == 49


def test_amendments_chain_and_refuse(spark, v):
    base = v.select("key", "heading", F.lit("old").alias("text"), "in_force_from", "in_force_to", "manner", "amended_by", "enacted_by", "superseded_by")
    rows = [
        (1, "PECA:section:20", "substitute", D(2023, 1, 1), "A", None, "new", None), (2, "PECA:section:20", "repeal", D(2024, 1, 1), "B", None, None, None),
        (3, "PECA:section:20", "repeal", D(2025, 1, 1), "C", None, None, None), (4, "PPC:section:302", "repeal", D(1990, 1, 1), "D", None, None, None),
        (5, "NEW:section:1", "insert", D(2020, 1, 1), "E", "Heading", "text", None), (6, "PPC:section:302", "insert", D(2020, 1, 1), "F", None, None, None),
    ]
    amendments = spark.createDataFrame(rows, "amendment_id bigint, key string, action string, on date, by string, heading string, text string, manner string")
    after, refused = amend.apply(base, amendments)
    assert {(r.amendment_id, r.refusal) for r in refused.collect()} == {(3, "no version in force"), (4, "ends before it begins"), (6, "already in force")}
    peca = sorted((str(r.in_force_from), str(r.in_force_to), r.manner, r.heading) for r in after.where("key = 'PECA:section:20'").collect())
    assert peca == [("2016-08-19", "2022-02-20", "substituted", "H1"), ("2022-02-20", "2023-01-01", "substituted", "H2"), ("2023-01-01", "2024-01-01", "repealed", "H2")]
    assert after.where("key = 'NEW:section:1' and in_force_to is null").count() == 1
