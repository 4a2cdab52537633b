"""The queries of this package against their SQL on the smallest test tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from tickloom.llm import queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", queries.ORACLES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    mine = queries.QUERIES[name](spark, DATA).toArrow()
    columns = ", ".join(f'"{c}"' for c in sorted(mine.schema.names))
    con.register("mine", mine)
    con.execute(f"CREATE TEMP TABLE theirs AS {queries.ORACLES[name]}").fetchall()
    for a, b in (("mine", "theirs"), ("theirs", "mine")):
        assert con.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 3").fetchall() == []


def test_split_documents_are_the_long_ones(spark):
    pytest.importorskip("tokenizers")
    ids = queries.QUERIES["p7_ids"](spark, DATA)
    long = {r["doc_id"] for r in ids.where("size(ids) > 2048").collect()}
    assert {r["doc_id"] for r in queries.QUERIES["p8_found"](spark, DATA).collect()} == long


def test_merged_percentiles_enclose_the_exact_ones(spark):
    exact = {(r["run_id"], r["line"], r["station"]): (r["n"], r["p50"], r["p95"]) for r in queries.QUERIES["p4_percentiles"](spark, DATA).collect()}
    merged = queries.QUERIES["p4_mergeable"](spark, DATA).collect()
    assert len(merged) == len(exact)
    for r in merged:
        n, p50, p95 = exact[r["run_id"], r["line"], r["station"]]
        assert r["n"] == n and r["p50_lo"] <= p50 <= r["p50_hi"] and r["p95_lo"] <= p95 <= r["p95_hi"]
