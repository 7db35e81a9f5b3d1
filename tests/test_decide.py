import datetime as dt

from tempolex.functions.naming import Names
from tempolex.operators.decide import decisions, scoreboard
from tempolex.operators.ranking import build_index

SCHEMA = "version_id bigint, statute string, number string, key string, heading string, text string, in_force_from date, in_force_to date, start_known boolean"
D, DAY = dt.date(2000, 1, 1), dt.date(2010, 1, 1)


def test_decisions(spark):
    rows = [
        (1, "PPC", "302", "PPC:section:302", "Punishment of qatl amd", "whoever causes qatl amd suffers death", D, None, True),
        (2, "PPC", "378", "PPC:section:378", "Theft", "whoever moves property dishonestly is guilty of theft", D, None, True),
        (3, "PPC", "9", "PPC:section:9", "Number", "words of number carry another number", D, dt.date(2005, 1, 1), True),
        (4, "PPC", "49", "PPC:section:49", "Month", "reckoned according to the British calendar", D, None, True),
        (5, "PPC", "57", "PPC:section:57", "Fractions", "Terms are counted. 58. Of zigzag. 59. Of plover. 60. Of others.", D, None, True),
    ]
    v = spark.createDataFrame(rows, SCHEMA)
    questions = {
        1: ("dishonestly moves property", "answered"), 2: ("section 302 PPC", "answered"), 3: ("section 9 PPC", "not_in_force"), 4: ("section 999 PPC", "unknown_provision"),
        5: ("zebra giraffe", "subject_not_in_corpus"), 6: ("", "nothing_matched"), 7: (None, "nothing_matched"), 8: ("attempted theft of property dishonestly", "different_offence"), 9: ("see section 5", "no_act_named"),
        10: ("moves property dishonestly in India", "act_not_recognised"), 11: ("moving property under the Widget Act", "act_not_recognised"), 12: ("dishonestly moves property in the Penal Code", "answered"),
        13: ("reckoned by the British calendar", "answered"), 14: ("zigzag and plover", "citation_unreliable"), 15: ("section 302 of the Indian Penal Code", "act_not_recognised"),
    }
    q = spark.createDataFrame([(i, t, DAY) for i, (t, _) in questions.items()], "item_id bigint, question string, as_of date")
    decided = decisions(q, v, build_index(v), ["PPC"])
    got = {r.item_id: (r.status, r.version_id) for r in decided.collect()}
    assert {i: s for i, (s, _) in got.items()} == {i: s for i, (_, s) in questions.items()}
    assert got[1][1] == 2 and got[2][1] == 1 and got[12][1] == 2 and got[13][1] == 4 and got[14][1] == 0
    expected = spark.createDataFrame([(1, "a", "PPC:section:378"), (5, "a", None), (8, "a", "PPC:section:378"), (2, "a", "PPC:section:302")], "item_id bigint, suite string, expected_citation string")
    r = scoreboard(decided, expected, v).first()
    assert (r.n, r.right, r.wrong, r.refused) == (4, 3, 0, 1)


def test_names():
    n = Names(("HRNC", "A"))
    assert n.unheld_title("under the Companies Act") == "" and n.unheld_title("under the Arms Act, 1965") == "Arms Act"
    assert n.unheld_title("Prevention of Electronic Crimes Act") == "" and n.unheld_title("the Indian Penal Code") == "Indian Penal Code"
    assert n.places("murder in India?") == [("india", "")] and n.places("British calendar; anindian") == [("british", "calendar")]
    assert n.scope("what is a word in the Penal  Code?")[0] == "PPC" and n.scope("a word") == ("", "a word")
    assert n.scope("hrnc fees") == ("HRNC", "  fees")
