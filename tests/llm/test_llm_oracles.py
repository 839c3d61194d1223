"""Registered queries that SQL can express, against it."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op4_warc_round_trip", "op5_line_dedup", "op11_importance_resampling", "op12_ranked_search", "op13_embedding_near_dedup"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from folio.llm.oracles import ORACLES
    from folio.llm.queries import QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.select(", ".join(columns)).fetchall(), key=repr)
