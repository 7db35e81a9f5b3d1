import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tempolex.functions import acts
from tempolex.functions.diffing import word_diff
from tempolex.operators import temporal as t
from tempolex.sources import cleaning, corpus_io
from tempolex.sources.cleaning import clean_pages, html_text, text_on
from tempolex.sources.splitting import alike, buried_numbers, buried_offset, division_of, heaviest_chain, is_trailer, split_act, tail_run

ACT = """THE WIDGET ACT, 1990
CONTENTS
1. Short title
2. Definitions
3. Offences
CHAPTER I
1. Short title.—This Act may be called the Widget Act.
2. Definitions.—In this Act a widget is
10. a thing of ten parts, or
a part of one.
CHAPTER II
3. Offences.—Whoever breaks a widget is fined.
4. [Omitted by Act II of 1995.]
THE SCHEDULE
5. Not a provision.—Of the Act."""


def test_split():
    got, report = split_act(ACT)
    assert [(p.number, p.heading, p.chapter) for p in got if not p.note] == [("1", "Short title", "I"), ("2", "Definitions", "I"), ("3", "Offences", "II")]
    assert got[-1].note == "omitted" and [ACT[p.start : p.end].split(".")[0] for p in got] == ["1", "2", "3", "4"]
    assert "10. a thing of ten parts" in got[1].text and report["omitted"] == 1 and report["missing_from_contents"] == 0
    assert split_act(None) == split_act("")
    assert split_act("")[0] == []


def test_long_bodies_stay():
    long = "word " * 5_000
    got, report = split_act(f"1. Short title.—Yes.\n2. Long one.—{long}\n3. Last.—Done.")
    assert [(p.number, p.note) for p in got] == [("1", ""), ("2", "too_long"), ("3", "")] and got[1].text == long.strip() and report["too_long"] == 1


def test_numbers_behind_the_contents():
    body = "".join(f"{n}. Heading {n}.—Body {n}.\n" for n in range(1, 9))
    got, report = split_act("CONTENTS\n" + "".join(f"{n}. Heading {n}\n" for n in range(1, 5)) + body)
    assert len(got) == 8 and report["unlisted"] == 4 and report["tail_run"] == 4 and report["missing_from_contents"] == 0
    assert tail_run("4", ["5", "6"]) == 0 and tail_run("4", ["5", "6", "8", "7"]) == 3


def test_headings_and_contents():
    assert alike("Punishment for theft", "Punishment for the theft") and not alike("Theft", "Robbery") and not alike("", "")
    assert [division_of(t) for t in ("CHAPTER IV", "PART 2.— GENERAL", "CHAPTER", "PARTY II", "Part I", "CHAPTER XVI-A")] == ["IV", "2", None, None, None, "XVI"]
    assert [is_trailer(t) for t in ("SCHEDULE I", "THE FIRST SCHEDULE", "APPENDIX", "The Schedule", "THE ACT")] == [True, True, True, False, False]
    assert buried_offset("57", "Body. 58. Another heading. 59. And one. 60. A third.") == 6 and buried_offset("57", "") is None


@pytest.mark.parametrize("seed", range(20))
def test_chain_by_brute_force(seed):
    rnd = random.Random(seed)
    keys, weights = [rnd.randrange(8) for _ in range(9)], [rnd.choice([0.5, 1.0, 3.0]) for _ in range(9)]
    best = 0.0
    for mask in range(1 << 9):
        picked = [i for i in range(9) if mask >> i & 1]
        if all(keys[a] < keys[b] for a, b in zip(picked, picked[1:])):
            best = max(best, sum(weights[i] for i in picked))
    chain = heaviest_chain(keys, weights)
    assert all(keys[a] < keys[b] for a, b in zip(chain, chain[1:])) and sum(weights[i] for i in chain) == best


def test_buried():
    assert buried_numbers("57", "Body. 58. Another heading. 59. And one. 60. A third.") == ["58", "59", "60"]
    assert buried_numbers("57", "See 58. Only one.") == [] and buried_numbers(None, None) == []


def test_pages():
    s = clean_pages("Page 1 of 2\n1. Text 1[new words] stands.\n\n1 Subs. by Act II of 1990 for old words\f2. More 9[kept].\nUpdated to 3.4.2015\n")
    assert s.text.startswith("1. Text new words stands.") and "9[kept]" in s.text and s.as_at == "2015-04-03"
    assert [(n.number, n.page) for n in s.notes] == [(1, 1)] and len(s.amended) == 1
    assert text_on(s, {1: "old words"}, {1: 1990}, 1980).startswith("1. Text old words stands.")
    assert clean_pages(None).text.strip() == ""


def test_html():
    text, notes = html_text("<p>300. Culpable<sup>1</sup> homicide &amp; more</p><script>x</script><h2>Notes</h2><p>1. Replaced words</p>")
    assert text == "300. Culpable homicide & more" and notes == {1: "Replaced words"}


def test_diff():
    assert word_diff("a b c.", "a x c.") == [("replaced", "b", "x")]
    assert word_diff("same", "same") == [] and word_diff(None, "") == []
    assert word_diff("", "new words") == [("added", "", "new words")]
    one, two = " ".join(f"w{i}" for i in range(3000)), " ".join(f"v{i}" for i in range(3000))
    assert [r[0] for r in word_diff(one, two)] == ["approximate"]
    prose = ". ".join(f"The clause numbered {i} stands as it was" for i in range(2000))
    assert word_diff(prose, prose.replace("numbered 77 stands", "numbered 77 falls")) == [("replaced", "stands", "falls")]


def test_diff_compares_whole_texts():
    long = ". ".join(f"The clause numbered {i} stands as it was" for i in range(8000))
    assert len(long) > 200_000
    assert word_diff(long, long + ". At the end") == [("replaced", "was", "was. At the end")]
    many = ". ".join(f"Clause {i} of the said Act stands. Entry {i} says old" for i in range(700))
    assert word_diff(many, many.replace("says old", "says new")).count(("replaced", "old.", "new.")) == 699
    wide = " ".join(f"w{i}" for i in range(1000))
    assert word_diff("", wide) == [("added", "", wide)]


def test_diff_beyond_the_budget_is_coarse():
    one = [f"w{i}" for i in range(3000)]
    two = ["first", *one[:1500], "middle", *one[1501:], "last"]
    assert word_diff(" ".join(one), " ".join(two)) == [("approximate", "", "first"), ("approximate", "w1500", "middle"), ("approximate", "", "last")]


def test_acts(spark):
    notes = {"Repealed w.e.f. 23-6-2020": ("2020-06-23", True), "Repealed by Ord. 7 of 26": ("2026-01-01", False), "Repealed by Act XIV of 2010": ("2010-01-01", False), "Repealed": (None, False), "w.e.f. 31-2-1999 by Act I of 1998": ("1999-01-01", False)}
    df = spark.createDataFrame([(n,) for n in notes], "n string")
    got = {r.n: (str(r.repealed_on) if r.repealed_on else None, r.exact) for r in df.select("n", *acts.repealed_on(F.col("n"), 2027)).collect()}
    assert got == notes
    titles = spark.createDataFrame([("The Widget Control Act, 1990",), ("Wheat Crop Act, 1990",), ("Wool Cess Act, 1999",), ("Tea Act, 2001",)], "title string")
    assert {r.title: r.act_key for r in acts.unique_keys(titles, "title").collect()} == {"The Widget Control Act, 1990": "WCA1990", "Wheat Crop Act, 1990": "WCA1990_2", "Wool Cess Act, 1999": "WCA1999", "Tea Act, 2001": "TAX"}


def test_files(spark, tmp_path):
    rows = [{"statute": "A", "unit": "section", "number": "1", "heading": "h", "text": "ا", "in_force_from": "2000-01-01"}, {"statute": "A", "unit": "clause", "number": "2", "heading": "h", "text": "t", "in_force_from": "2000-13-01"}]
    path = tmp_path / "rows.jsonl.gz"
    path.write_bytes(gzip.compress(("\n".join(map(json.dumps, [{"_corpus": {"as_at": "2020-01-01"}}, *rows])) + "\n{broken\n").encode()))
    read = corpus_io.read_rows(spark, str(path))
    problems = {(r.number, r.problem) for r in corpus_io.row_problems(read).collect() if r.problem.startswith(("bad", "unknown"))}
    assert problems == {("2", "unknown unit"), ("2", "bad start")}
    assert corpus_io.read_meta(spark, str(path)).first().as_at == "2020-01-01"
    with pytest.raises(corpus_io.BadRows):
        corpus_io.checked_rows(read)
    good = corpus_io.checked_rows(read.where("number = '1'"))
    with pytest.raises(corpus_io.BadRows):
        corpus_io.merged(good, good)
    corpus_io.write_jsonl(good, str(tmp_path / "out"))
    assert [r.text for r in corpus_io.read_rows(spark, str(tmp_path / "out")).collect()] == ["ا"]


def test_stream(spark, tmp_path):
    from tempolex.streaming import calls

    line = lambda i, at, tool: json.dumps({"event_id": i, "at_s": at, "tool": tool, "ms": 1.0})
    (tmp_path / "a.json").write_text("\n".join([line(1, 36e5, "x"), line(1, 36e5, "x"), line(2, 36e5 + 4000, "x"), "{broken", line(3, 36e5 + 4100, "y")]))
    source = calls.timed(calls.read_calls(spark, str(tmp_path)))
    for name, df, want in (("w", calls.windows(source), {("x", 1), ("y", 1)}), ("s", calls.sessions(source), {("x", 1), ("y", 1)})):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"_{name}")).trigger(availableNow=True).start()
        q.awaitTermination()
        out = spark.table(name).collect()
        assert {(r.tool, r.calls) for r in out} == want and len(out) == 3


def test_acts_end_to_end(spark):
    from tempolex.sources.building import provisions

    body = "1. Short title.— Yes.\n2. Effect.— It binds.\n3. [Omitted by Act II of 1995.]"
    rows = [(1, "The Widget Act, 1990", f"ACT No. V\n[16th August, 1990]\n{body}"), (2, "Old Fees Act, 1950 (repealed w.e.f. 3-4-1999)", body), (3, "Tolls Order", body), (4, "Empty Act, 1970", "nothing"),
            (5, "Tea Act, 1960", f"1. Short title.— {'word ' * 13000}\n2. Effect.— Yes."), (6, None, None), (7, "The Widget Act, 1990", body)]
    made, reasons = provisions(spark.createDataFrame(rows, "act_id bigint, title string, text string"), 2027)
    got = {(r.act_id, r.number): (r.statute, str(r.in_force_from), str(r.in_force_to), r.start_known, r.manner) for r in made.collect()}
    assert got == {(1, "1"): ("WAX", "1990-08-16", "None", True, ""), (1, "2"): ("WAX", "1990-08-16", "None", True, ""), (2, "1"): ("OFA", "1950-01-01", "1999-04-03", False, "repealed"), (2, "2"): ("OFA", "1950-01-01", "1999-04-03", False, "repealed")}
    assert {r.act_id: r.reason for r in reasons.collect()} == {3: "no date", 4: "no provisions", 5: "runs away", 6: "no date"}


def test_dates_and_titles(spark):
    texts = {"x [2nd July 2016] y": "2016-07-02", "[31st June, 1997]\n  [ 16 August, 1997 ]  \n": "1997-08-16", "head [1st May, 1950]\n[2nd May, 1951]": "1951-05-02", "none": "None", None: "None"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: str(r.d) for r in df.select("t", acts.assent_date(F.col("t")).alias("d")).collect()} == texts
    titles = {"Order, 1984 (QSO)": "Order, 1984 (QSO)", "Fees Act, 1950 (repealed w.e.f. 3-4-1999)": "Fees Act, 1950", "Tolls Act (part": "Tolls Act", "Act) of 1990": "Act of 1990"}
    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", acts.without_annotations(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == titles
    one = spark.createDataFrame([("a\u037eb\u00a0c\u2212d\u00ade",)], "t string").select(cleaning.normalise_source(F.col("t")).alias("x")).first()
    assert one.x == "a;b c-de"
    n = spark.createDataFrame([("302A",), ("IX/3",), ("Schedule",)], "n string").select("n", t.sequence_within(F.col("n")).alias("s")).collect()
    assert {r.n: tuple(r.s) if r.s else None for r in n} == {"302A": (302, "A"), "IX/3": (3, ""), "Schedule": None}


def test_history_pages(spark):
    notes = {"1": 'Substituted by Ordinance II of 1980 for: "old 3[words]3"', "2": "Ins. by Act V of 1990", "3": 'Subs. by Act I of 1970 for: "older"'}
    rows = [(1, "a 1[new 2[inner]2 words]1 z", notes, y) for y in (1960, 1975, 1985, 1995)] + [(2, None, None, 1990), (3, "stray ]9 and 8[open", {}, 1990)]
    df = spark.createDataFrame(rows, "id bigint, text string, notes map<string,string>, year int")
    got = {(r.id, r.year): r.text for r in cleaning.history_on(df, "id", "text", "notes", "year").collect()}
    assert got == {(1, 1960): "a old older z", (1, 1975): "a old words z", (1, 1985): "a new  words z", (1, 1995): "a new inner words z", (2, 1990): "", (3, 1990): "stray  and open"}
    pages = spark.createDataFrame([(1, "<p>Text</p><h2>Notes</h2><p>1. Words</p>"), (2, None)], "id bigint, page string")
    assert {r.id: (r.text, r.notes) for r in cleaning.html_texts(pages, "id", "page").collect()} == {1: ("Text", {"1": "Words"}), 2: ("", {})}


def test_corpus_is_refused(spark, tmp_path, monkeypatch):
    row = {"statute": "A", "unit": "section", "number": "1", "heading": "h", "text": "t", "in_force_from": "2000-01-01"}
    path = tmp_path / "c.jsonl"
    write = lambda *rows: path.write_text("\n".join(map(json.dumps, rows)))
    write({"_corpus": {"as_at": "2020-01-01"}}, row)
    monkeypatch.setenv(corpus_io.CORPUS_ENV, str(path))
    rows, as_at = corpus_io.load_corpus(spark)
    assert rows.count() == 1 and as_at == "2020-01-01"
    for bad in ([row, {"_corpus": {}}], [{**row, "colour": "red"}], [{"_corpus": {}}], [{**row, "unit": "clause"}]):
        write(*bad)
        with pytest.raises(corpus_io.BadRows):
            corpus_io.load_corpus(spark, str(path))


def test_recorded_calls(spark, tmp_path, monkeypatch):
    from tempolex.streaming import calls

    path = str(tmp_path / "log" / "calls.jsonl")
    monkeypatch.setattr(calls, "MOST_BYTES", 200)
    assert not calls.record({"event_id": 0}, None)
    for i in range(6):
        assert calls.record({"event_id": i, "at_s": float(i), "tool": "x" * 40}, path)
    with open(path, "a") as f:
        f.write('{"event_id": 9, "at')
    got = [r.event_id for r in calls.recorded(spark, path).orderBy("at_s").collect()]
    assert got == sorted(got) and got[-1] == 5 and 9 not in got and len(got) >= 3
    assert [r.event_id for r in calls.recorded(spark, path, 2).collect()] == [5, 4] and calls.recorded(spark, path + "x").count() == 0


def test_arrays_and_byte_order_marks(spark, tmp_path):
    row = {"statute": "A", "unit": "section", "number": "1", "heading": "h", "text": "t", "in_force_from": "2000-01-01"}
    (tmp_path / "a.json").write_bytes(b"\xef\xbb\xbf" + json.dumps([row, {**row, "number": "2"}]).encode())
    (tmp_path / "b.jsonl").write_bytes(b"\xef\xbb\xbf" + "\n".join([json.dumps(row), json.dumps({**row, "number": "2"})]).encode())
    for name, array in (("a.json", True), ("b.jsonl", False)):
        assert sorted(r.number for r in corpus_io.read_rows(spark, str(tmp_path / name), array).collect()) == ["1", "2"]
