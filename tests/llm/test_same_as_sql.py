"""The queries of this folder's operators that SQL can express, on the given tables."""

import duckdb
import pytest

from tamiz.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_source_divergence", "op13_exact_topk"])
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries()[name](spark, sf)
    want = con.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
