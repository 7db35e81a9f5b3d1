"""Every registered query of the subpackage beside its SQL twin on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from compare import canon  # noqa: E402
from conftest import SF  # noqa: E402

from tempolex.llm.queries import _RECORDS, _TOKENS, QUERIES, SQL  # noqa: E402


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        con = duckdb.connect()
        for t in ("sample_corpus", "documents", "benchmark"):
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        want = con.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


COLUMNS = {
    "p1_found": ["version_id", "field"], "p3_found": ["version_id", "term"], "p4_found": ["term", "mark"], "p6_found": ["version_id_a", "version_id_b"],
    "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert QUERIES[name](spark, SF).columns == COLUMNS[name]


def test_every_term_of_a_record_is_scored(spark):
    con = duckdb.connect()
    con.execute(f"create view sample_corpus as select * from read_parquet('{SF}/sample_corpus.parquet')")
    terms = f"SELECT version_id, unnest({_TOKENS.format('concat_ws(chr(10), heading, text)')}) AS term FROM rec"
    want = con.execute(f"WITH {_RECORDS}, tok AS ({terms}) SELECT version_id, term, count(*) AS tf FROM tok GROUP BY ALL").fetchall()
    got = [(r.version_id, r.term, r.tf) for r in QUERIES["p3_scores"](spark, SF).select("version_id", "term", "tf").collect()]
    assert len(got) == len(want) and set(got) == set(want) and any(tf == 1 for _, _, tf in got)
