"""Every registered query of the core beside its SQL twin on the smallest tables."""

import importlib

import duckdb
import pytest
from conftest import SF

from compare import canon
from tempolex.plans import registry

MODULES = [importlib.import_module(m) for m in registry.MODULES]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("sample_corpus", "corpus_snapshots", "acts", "telemetry", "benchmark", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_registry_without_llm(monkeypatch):
    monkeypatch.setattr(registry, "OPTIONAL", ("tempolex.absent.queries",))
    assert set(registry.queries()) == set(QUERIES)
