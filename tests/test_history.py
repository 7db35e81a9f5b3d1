import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tempolex.operators.history import attribute_history, collapsed

DAYS = [dt.date(2020, m, 1) for m in (1, 4, 7, 10)] + [dt.date(2021, 1, 1)]
SCHEMA = "row_id bigint, k string, on_ date, at timestamp, text string, change string"


def brute(rows):
    held = {}
    for rid, k, on, at, text, _ in rows:
        if on is not None and (at, rid) >= held.get((k, on), ((dt.datetime.min, -1), None))[0]:
            held[k, on] = ((at, rid), " ".join(text.split()) if text is not None else None)
    days = sorted({r[2] for r in rows if r[2] is not None})
    out = []
    for k in {r[1] for r in rows}:
        i = 0
        while i < len(days):
            if (k, days[i]) in held:
                j = i
                while j + 1 < len(days) and (k, days[j + 1]) in held and held[k, days[j + 1]][1] == held[k, days[i]][1]:
                    j += 1
                out.append((k, days[i], days[j + 1] if j + 1 < len(days) else None))
                i = j + 1
            else:
                i += 1
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(5))
def test_against_runs(spark, seed):
    rnd = random.Random(seed)
    rows = [
        (i, rnd.choice(["a", "b", "c", None]), rnd.choice([*DAYS, None]), dt.datetime(2022, 1, rnd.randint(1, 3)), rnd.choice(["x  y", "x y\t", "z", None, ""]), "clash")
        for i in range(50)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = attribute_history(df, ["k"], "on_", "at", "row_id", [collapsed(F.col("text"))])
    assert sorted([(r.k, r.valid_from, r.valid_to) for r in got.collect()], key=str) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert attribute_history(df, ["k"], "on_", "at", "row_id", [F.col("text")]).count() == 0
