import random

import pytest

from tempolex.operators.telemetry import events, overall, percentiles, result_statuses

SCHEMA = "event_id bigint, at_s double, tool string, outcome string, ms double, refused boolean, refusal_status string, error string, is_sample boolean, statuses map<string,bigint>"


@pytest.mark.parametrize("n", [1, 2, 19, 20, 22, 57])
def test_nearest_rank(spark, n):
    rnd = random.Random(n)
    values = [float(rnd.randrange(20)) for _ in range(n)]
    df = spark.createDataFrame([("t", v) for v in values], "tool string, ms double")
    got = percentiles(df, ["tool"], "ms", {"p50": 0.5, "p95": 0.95}).first()
    pick = lambda f: sorted(values)[min(n - 1, max(0, round(f * n + 0.5) - 1))]
    assert (got.p50, got.p95) == (pick(0.5), pick(0.95))


def test_events_are_counted_once(spark):
    e = (1, 1.0, None, None, None, None, None, None, False, None)
    df = spark.createDataFrame([e, e, (2, *e[1:])], SCHEMA)
    assert [(r.tool, r.outcome, r.ms) for r in events(df).collect()] == [("unknown", "unknown", 0.0)] * 2
    assert events(df.where("false")).count() == 0


def test_overall_and_statuses(spark):
    rows = [(i, float(i), "t", "ok", float(i), i % 2 == 0, None, None, True, None) for i in range(1, 5)]
    r = overall(events(spark.createDataFrame(rows, SCHEMA))).first()
    assert (r.calls, r.first_at, r.last_at, r.refused, r.refusal_rate, r.p50, r.longest, r["sample"]) == (4, 1.0, 4.0, 2, 0.5, 2.0, 4.0, True)
    assert overall(events(spark.createDataFrame([], SCHEMA))).first().calls == 0
    got = result_statuses(spark.createDataFrame([(1, "in_force"), (1, "in_force"), (1, None), (2, "x")], "c bigint, s string"), "c", "s").collect()
    assert {x.c: x.statuses for x in got} == {1: {"in_force": 2}, 2: {"x": 1}}
