"""The registered corpus queries on small tables, against DuckDB where they have SQL."""

import duckdb
import pytest

from barwright.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    want = duck.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*want.columns)
    rows = want.fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows) and len(rows) > 0


@pytest.mark.parametrize("name", ["op3_quality", "op7_token_counts", "op8_pii", "op9_toxicity", "op10_bpe_codec"])
def test_query_has_a_row_for_each_document(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(r[0] for r in duck.sql("SELECT doc_id FROM documents").fetchall())
