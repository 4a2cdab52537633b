"""Agent memory: scoring, context, cache and eviction."""

import math
import random

import numpy as np
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.memory import ann, store

HOUR = 3600 * 10**9
NOW = 1_000_000 * HOUR
NAMES = [c.split()[0] for c in store.RECORD.replace("\n", " ").split(", ")]


def record(i, **k):
    base = dict(memory_id=str(i), tenant_id="t", namespace_id="n", user_id="u", session_id="s", agent_id="a", type="note", content=f"c{i}", metadata_json="{}", embedding=[1.0, 0.0], token_count=5, created_at_ns=NOW, last_accessed_ns=0, expires_at_ns=0, access_count=0, importance=0.0, pinned=False)
    return tuple({**base, **k}[n.strip()] for n in NAMES)


def frame(spark, rows):
    return spark.createDataFrame(rows, store.RECORD)


def test_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0]), ([1.0, 0.0], [0.0, 1.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(store.cosine("a", "b")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_tokens_and_prompts(spark):
    df = spark.createDataFrame([("abcd",), ("abcde",), ("é",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(store.estimated_tokens("t")).collect()] == [1, 2, 1, 0, None]
    df = spark.createDataFrame([("  Hello \n World ",)], "t string")
    assert df.select(store.normalised_prompt("t")).first()[0] == "hello world"


def test_search_order_filter_and_expiry(spark):
    rows = [record(1), record(2, importance=0.7), record(3, pinned=True), record(4, embedding=[0.0, 1.0]), record(5, expires_at_ns=NOW), record(6, tenant_id="x"), record(7, created_at_ns=NOW - HOUR, access_count=500)]
    got = store.search(frame(spark, rows), [1.0, 0.0], 9, NOW, tenant_id="t").collect()
    assert [r["memory_id"] for r in got] == ["3", "2", "7", "1", "4"]
    assert math.isclose(got[2]["score"], 10 + 0.5 + 1.0)
    hit = store.touched(frame(spark, rows), store.search(frame(spark, rows), [1.0, 0.0], 1, NOW, tenant_id="t"), NOW)
    assert {r["memory_id"]: r["access_count"] for r in hit.collect()}["3"] == 1


def test_put_replaces_and_completes(spark):
    old = frame(spark, [record(1), record(2)])
    new = frame(spark, [record(2, content="new", token_count=0, namespace_id=""), record(0, memory_id=None, content="made")])
    got = {r["content"]: r for r in store.put(old, new).collect()}
    assert set(got) == {"c1", "new", "made"}
    assert got["new"]["token_count"] == 1 and got["new"]["namespace_id"] == "default"
    assert got["made"]["memory_id"].startswith("mem_")


def test_context_skips_what_does_not_fit(spark):
    rows = [(1, 1, "a", 50), (1, 2, "a", 10), (1, 3, "b", 60), (1, 4, "c", 40), (1, 5, "d", 10), (2, 1, "z", 500)]
    out = store.context(spark.createDataFrame(rows, "r int, rank int, content string, n bigint"), "r", "rank", "content", "n", 100)
    assert [(r["rank"], r["used"]) for r in out.orderBy("rank").collect()] == [(1, 50), (4, 90), (5, 100)]


def test_cache(spark):
    entry = lambda i, prompt, e, t=1, tenant="t": (str(i), tenant, "n", prompt, f"r{i}", "", e, 1, t, 0, 0, 0)
    entries = spark.createDataFrame([entry(1, "Hello  World", [1.0, 0.0]), entry(2, "hello world", [0.0, 1.0], 5), entry(3, "other", [0.6, 0.8]), entry(4, "hello world", [1.0, 0.0], 9, "x")], store.ENTRY)
    asked = spark.createDataFrame([("a", "t", "n", " HELLO world ", [0.0, 0.0]), ("b", "t", "n", "zzz", [0.59, 0.81]), ("c", "t", "n", "yyy", [-1.0, 0.0])], "request string, tenant_id string, namespace_id string, prompt string, embedding array<float>")
    got = {r["request"]: (r["response"], r["exact"]) for r in store.cache_lookup(entries, asked, NOW).collect()}
    assert got == {"a": ("r2", True), "b": ("r3", False)}


def test_eviction(spark):
    rows = [record(i, importance=i / 10) for i in range(6)] + [record(9, pinned=True, importance=-5.0), record(10, expires_at_ns=NOW - 1, importance=9.0)]
    assert {r["memory_id"] for r in store.evict(frame(spark, rows), NOW, 3).collect()} == {"9", "5", "4"}


def test_save_and_load(spark, tmp_path):
    store.save(frame(spark, [record(1)]), f"file://{tmp_path}/m")
    assert store.load(spark, f"file://{tmp_path}/m").count() == 1


def test_neighbour_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 16))).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<float>")
    queries = df.where("id % 100 = 0").withColumnRenamed("id", "q")
    got = {}
    for r in ann.nearest(df, queries, "id", "q", "v", 10, lists=16, probes=5).collect():
        got.setdefault(r["q"], set()).add(r["id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    recall = []
    for q, ids in got.items():
        best = set(np.argsort(-(unit @ unit[q]))[:10].tolist())
        recall.append(len(best & ids) / 10)
    assert len(got) == 9 and np.mean(recall) >= 0.9


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.01/embeddings.parquet"), reason="no test tables here")
def test_neighbour_recall_on_the_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    rows = e.collect()
    unit = np.array([r["embedding"] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ids = [r["vec_id"] for r in rows]
    got = {}
    for r in ann.nearest(e, queries, "vec_id", "query_id", "embedding", 10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = [len({ids[j] for j in np.argsort(-(unit @ unit[ids.index(q)]))[:10]} & found) / 10 for q, found in got.items()]
    assert np.mean(recall) >= 0.9


def test_a_requests_own_entry_does_not_answer_it(spark):
    entry = lambda i, prompt, e: (str(i), "t", "n", prompt, f"r{i}", "", e, 1, 1, 0, 0, 0)
    entries = spark.createDataFrame([entry(1, "a", [1.0, 0.0]), entry(2, "b", [0.9, 0.1]), entry(3, "c", [0.0, 1.0])], store.ENTRY)
    asked = spark.createDataFrame([(1, "t", "n", "a", [1.0, 0.0]), (3, "t", "n", "z", [0.0, 1.0])], "request bigint, tenant_id string, namespace_id string, prompt string, embedding array<float>")
    got = {r["request"]: r["response"] for r in store.cache_lookup(entries, asked, NOW, 0.5, "request").collect()}
    assert got == {1: "r2"}


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.001/embeddings.parquet"), reason="no test tables here")
def test_cache_queries_over_the_whole_index(spark):
    from tickloom.plans import registry

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in e}
    x = {i: v / np.linalg.norm(v) for i, v in x.items()}
    best = {i: max(float(x[i] @ v) for k, v in x.items() if k != i) for i in x if i % 100 == 0}
    got = {r["request"]: r["similarity"] for r in registry.QUERIES["mem_cache_semantic_all"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {i for i, s in best.items() if s >= 0.2} and all(math.isclose(s, best[i], abs_tol=1e-5) for i, s in got.items())
    prompts = spark.read.parquet("/root/testdata/sf0.001/fleet_decision_table.parquet").where("robot_code IS NOT NULL").selectExpr("selected_action", "robot_code").distinct()
    assert registry.QUERIES["mem_cache_exact_all"](spark, "/root/testdata/sf0.001").count() == prompts.count()


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.001/embeddings.parquet"), reason="no test tables here")
def test_exact_neighbours_with_ids_and_ranking_by_similarity(spark):
    from tickloom.plans import registry

    d = "/root/testdata/sf0.001"
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    x = {i: v / np.linalg.norm(v) for i, v in x.items()}
    got = {}
    for r in registry.QUERIES["mem_cosine_topk"](spark, d).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    best = {i: sorted((k for k in x if k != i), key=lambda k: (-round(float(x[i] @ x[k]), 9), k))[:10] for i in x if i % 100 == 0}
    assert {i: [k for _, k in sorted(v)] for i, v in got.items()} == best
    assert len({r["similarity"] for r in registry.QUERIES["mem_search_rank"](spark, d).collect()}) > 1


@pytest.mark.parametrize("block", [1024, 3])
def test_exact_neighbours_in_blocks(spark, block):
    from tickloom.memory import exact

    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=5).tolist() for _ in range(60)] + [None, [], [0.0] * 5, [1.0, 2.0]]
    vectors[7] = vectors[3]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "id bigint, v array<double>, similarity string")
    asked = df.where("id % 9 = 0 OR id >= 60").selectExpr("id AS q", "v")
    got = {(r["q"], r["rank"]): (r["id"], r["similarity"]) for r in exact.nearest(df, asked, "id", "q", "v", 4, others=True, block=block).collect()}

    def cosine(a, b):
        return 0.0 if not a or not b or len(a) != len(b) or not any(a) or not any(b) else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))

    for q in [i for i in range(64) if i % 9 == 0 or i >= 60]:
        want = sorted((-round(cosine(vectors[q], v), 12), i) for i, v in enumerate(vectors) if i != q)[:4]
        assert [got[q, n + 1][0] for n in range(4)] == [i for _, i in want]
    assert exact.nearest(df.limit(0), asked, "id", "q", "v", 4).count() == 0
    assert exact.nearest(df, asked.limit(0), "id", "q", "v", 4).count() == 0


@pytest.mark.parametrize("clusters", [0, 12])
def test_probes_follow_the_wanted_recall(spark, clusters):
    from tickloom.memory import ann, exact

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 4
    vectors = rng.normal(size=(1500, 16)) + (centres[rng.integers(0, 12, 1500)] if clusters else 0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, v array<double>")
    asked = df.where("id % 20 = 0").selectExpr("id AS q", "v")
    true = {(r["q"], r["id"]) for r in exact.nearest(df, asked, "id", "q", "v", 10).collect()}
    found = {(r["q"], r["id"]) for r in ann.nearest(df, asked, "id", "q", "v", 10).collect()}
    assert len(true & found) >= 0.9 * len(true)
    assert ann.nearest(df.limit(0), asked, "id", "q", "v", 10).count() == 0
