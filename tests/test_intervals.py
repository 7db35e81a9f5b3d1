import datetime as dt
import random

import pytest

from tempolex.operators.intervals import coverage

D0 = dt.date(2000, 1, 1)
SCHEMA = "k string, a date, b date, kind string, _day int"


def brute(rows):
    """Day by day, over the days any interval touches; open ends are held as a far day."""
    out, far = [], 400
    for key in {r[0] for r in rows}:
        spans = [((a - D0).days, far if b is None else (b - D0).days) for k, a, b in rows if k == key and a is not None]
        spans = [s for s in spans if s[0] < s[1]]
        depth = [sum(a <= d < b for a, b in spans) for d in range(far)]
        day = lambda d: None if d >= far else D0 + dt.timedelta(d)
        d, last = 0, None
        while d < far:
            if depth[d]:
                start = d
                while d < far and depth[d]:
                    d += 1
                if last is not None:
                    out.append((key, "gap", day(last), day(start), 0))
                out.append((key, "period", day(start), day(d), max(depth[start:d])))
                last = d
            else:
                d += 1
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(k, a, b, "x", 1) for k, a, b in rows], SCHEMA)  # extra columns with clashing names
    return sorted([(r.k, r.kind, r.date_from, r.date_to, r.deepest) for r in coverage(df, ["k"], "a", "b").collect()], key=str)


@pytest.mark.parametrize("seed", range(6))
def test_against_day_sets(spark, seed):
    rnd = random.Random(seed)
    day = lambda: D0 + dt.timedelta(rnd.randrange(60))
    rows = [(rnd.choice(["a", "b", None]), None if rnd.random() < 0.1 else day(), None if rnd.random() < 0.1 else day()) for _ in range(60)]
    assert run(spark, rows + rows[:5]) == brute(rows + rows[:5])


def test_touching_is_one_period_and_empty_is_empty(spark):
    d = lambda n: D0 + dt.timedelta(n)
    assert run(spark, [("a", d(0), d(5)), ("a", d(5), d(9))]) == [("a", "period", d(0), d(9), 1)]
    assert run(spark, [("a", d(5), d(5)), ("a", None, d(5))]) == []
    assert coverage(spark.createDataFrame([], SCHEMA), ["k"], "a", "b").count() == 0


def test_hot_key(spark):
    df = spark.range(30_000).selectExpr("'hot' as k", "date_add(date'2000-01-01', cast(id % 50 * 10 as int)) a", "date_add(date'2000-01-01', cast(id % 50 * 10 + 4 as int)) b")
    out = coverage(df, ["k"], "a", "b").groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in out} == {"period": 50, "gap": 49}
