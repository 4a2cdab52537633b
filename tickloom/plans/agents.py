"""Queries of the agents' memory, over embeddings, documents and the fleet's decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.memory import ann, exact, store
from tickloom.plans import relational

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str, *tables: str):
    def put(f):
        relational.query(name, sql, *tables)(f)
        QUERIES[name] = relational.QUERIES.pop(name)
        if sql:
            ORACLES[name] = relational.ORACLES.pop(name)
        return f

    return put


NOW_NS = 1_750_000_000_000_000_000
_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
#: Every 100th vector is a query.
_PAIRS = f"""p AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, {_COS.format(a='e.embedding', b='q.embedding')} AS s
    FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)"""


@query("mem_cosine_best", f"WITH {_PAIRS} SELECT query_id, round(max(s), 5) AS best FROM p GROUP BY 1", "embeddings")
def _(e):
    return exact.nearest(e, _requests(e), "vec_id", "query_id", "embedding", 1, others=True).select("query_id", F.round("similarity", 5).alias("best"))


def _requests(e):
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("mem_cosine_topk", f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(s, 5) AS similarity, rank FROM r WHERE rank <= 10", "embeddings")
def _(e):
    ranked = exact.nearest(e, _requests(e), "vec_id", "query_id", "embedding", 10, others=True)
    return ranked.select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


_MEM = f"""m AS (SELECT vec_id, {NOW_NS} - (vec_id % 5000) * 3600000000000 AS created, (vec_id % 7) / 7.0 AS importance, vec_id % 50 = 0 AS pinned, vec_id % 300 AS hits,
    't' || (vec_id % 4) AS tenant FROM embeddings),
  s AS (SELECT *, importance + CASE WHEN pinned THEN 5.0 ELSE 0.0 END + 1.0 / (1.0 + ({NOW_NS} - created) / 3.6e12) + least(1.0, 0.01 * hits) AS score FROM m)"""


def _records(e):
    text = lambda v: F.lit(v).cast("string")
    return e.select(
        F.col("vec_id").cast("string").alias("memory_id"), F.concat(F.lit("t"), F.col("vec_id") % 4).alias("tenant_id"), text("default").alias("namespace_id"),
        text(None).alias("user_id"), text(None).alias("session_id"), text(None).alias("agent_id"), text("note").alias("type"),
        F.concat(F.lit("content "), F.col("vec_id") % 400).alias("content"), text(None).alias("metadata_json"), "embedding",
        (F.col("vec_id") % 90 + 10).cast("bigint").alias("token_count"), (F.lit(NOW_NS) - (F.col("vec_id") % 5000) * F.lit(3_600_000_000_000)).alias("created_at_ns"),
        F.lit(0).cast("bigint").alias("last_accessed_ns"), F.lit(0).cast("bigint").alias("expires_at_ns"), (F.col("vec_id") % 300).cast("bigint").alias("access_count"),
        ((F.col("vec_id") % 7) / 7.0).alias("importance"), (F.col("vec_id") % 50 == 0).alias("pinned"),
    )


@query("mem_score_rank", f"WITH {_MEM} SELECT CAST(vec_id AS VARCHAR) AS memory_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, created DESC, CAST(vec_id AS VARCHAR) LIMIT 40", "embeddings")
def _(e):
    return store.search(_records(e), None, 40, NOW_NS).select("memory_id", F.round("score", 6).alias("score"))


#: A query vector for embeddings of 64 numbers.
_ASKED = [((i * 7) % 13 - 6) / 6.0 for i in range(64)]


@query(
    "mem_search_rank",
    f"WITH {_MEM}, t AS (SELECT s.vec_id, created, {_COS.format(a='e.embedding', b=_ASKED)} AS similarity, score FROM s JOIN embeddings e USING (vec_id)) "
    "SELECT CAST(vec_id AS VARCHAR) AS memory_id, round(similarity, 5) AS similarity, round(10 * similarity + score, 5) AS score FROM t ORDER BY 10 * similarity + t.score DESC, created DESC, CAST(vec_id AS VARCHAR) LIMIT 40",
    "embeddings",
)
def _(e):
    found = store.search(_records(e), _ASKED, 40, NOW_NS)
    return found.select("memory_id", F.round("similarity", 5).alias("similarity"), F.round("score", 5).alias("score"))


@query(
    "mem_evict_quota",
    f"WITH {_MEM}, r AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY pinned DESC, score DESC, created DESC, CAST(vec_id AS VARCHAR)) AS rn FROM s) "
    "SELECT CAST(vec_id AS VARCHAR) AS memory_id FROM r WHERE rn <= 60 OR pinned",
    "embeddings",
)
def _(e):
    return store.evict(_records(e), NOW_NS, 60).select("memory_id")


@query("mem_context_budget", "", "fleet_decision_table")
def _(d):
    ranked = d.where("edge_latency_ms IS NOT NULL AND robot_code IS NOT NULL").select("robot_code", F.col("query_id").alias("item"), F.col("selected_action").alias("content"), F.col("edge_latency_ms").alias("tokens"))
    return store.context(ranked, "robot_code", "item", "content", "tokens", 60)


_PROMPTS = "SELECT DISTINCT lower(selected_action) || ' ' || robot_code AS prompt, robot_code % 5 AS tenant FROM fleet_decision_table WHERE robot_code IS NOT NULL"


@query("mem_cache_exact", f"WITH p AS ({_PROMPTS}), e AS (SELECT prompt, tenant FROM p WHERE length(prompt) % 3 <> 0) SELECT prompt AS request, 'answer to ' || prompt AS response FROM p JOIN e USING (prompt, tenant)", "fleet_decision_table")
def _(d):
    prompts = _prompts(d)
    return _exact(prompts.where(F.length("prompt") % 3 != 0), prompts)


@query("mem_cache_exact_all", f"SELECT prompt AS request, 'answer to ' || prompt AS response FROM ({_PROMPTS})", "fleet_decision_table")
def _(d):
    prompts = _prompts(d)
    return _exact(prompts, prompts)


def _prompts(d):
    return d.where("robot_code IS NOT NULL").select(F.concat_ws(" ", F.lower("selected_action"), "robot_code").alias("prompt"), (F.col("robot_code") % 5).cast("string").alias("tenant_id")).distinct()


def _exact(cached, prompts):
    none = F.lit(None).cast("array<float>")
    entries = cached.select(
        F.sha2("prompt", 256).alias("cache_id"), "tenant_id", F.lit("default").alias("namespace_id"), F.upper("prompt").alias("prompt"),
        F.concat(F.lit("answer to "), "prompt").alias("response"), none.alias("embedding"), F.lit(0).cast("bigint").alias("expires_at_ns"), F.lit(1).cast("bigint").alias("created_at_ns"),
    )
    asked = prompts.select(F.col("prompt").alias("request"), "tenant_id", F.lit("default").alias("namespace_id"), F.concat(F.lit("  "), F.regexp_replace("prompt", " ", "   ")).alias("prompt"), none.alias("embedding"))
    return store.cache_lookup(entries, asked, NOW_NS).where("exact").select("request", "response")


@query(
    "mem_cache_semantic",
    f"""WITH p AS (SELECT q.vec_id AS request, e.vec_id AS id, {_COS.format(a='e.embedding', b='q.embedding')} AS s FROM embeddings e, embeddings q
    WHERE q.vec_id % 100 = 0 AND e.vec_id % 2 = 1)
SELECT request, round(max(s), 5) AS similarity FROM p WHERE s >= 0.2 GROUP BY 1""",
    "embeddings",
)
def _(e):
    return _semantic(e.where("vec_id % 2 = 1"), e)


@query(
    "mem_cache_semantic_all",
    f"WITH {_PAIRS} SELECT query_id AS request, round(max(s), 5) AS similarity FROM p WHERE s >= 0.2 GROUP BY 1",
    "embeddings",
)
def _(e):
    return _semantic(e, e)


def _semantic(cached, e):
    entries = cached.select(
        F.col("vec_id").cast("string").alias("cache_id"), F.lit("t").alias("tenant_id"), F.lit("n").alias("namespace_id"), F.concat(F.lit("e"), "vec_id").alias("prompt"),
        F.lit("r").alias("response"), "embedding", F.lit(0).cast("bigint").alias("expires_at_ns"), F.lit(1).cast("bigint").alias("created_at_ns"),
    )
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("request"), F.lit("t").alias("tenant_id"), F.lit("n").alias("namespace_id"), F.concat(F.lit("q"), "vec_id").alias("prompt"), "embedding", F.col("vec_id").alias("own"))
    return store.cache_lookup(entries, asked, NOW_NS, 0.2, "own").select("request", F.round("similarity", 5).alias("similarity"))


@query("mem_token_estimate", "SELECT doc_id, (strlen(text) + 3) // 4 AS tokens FROM documents", "documents")
def _(d):
    return d.select("doc_id", store.estimated_tokens("text").cast("bigint").alias("tokens"))


@query("mem_ann", "", "embeddings")
def _(e):
    return ann.nearest(e, _requests(e), "vec_id", "query_id", "embedding", 10)


@query(
    "action_outcomes",
    """WITH o AS (SELECT query_id, count(*) FILTER (action_class IS NOT NULL) AS outcomes, CAST(coalesce(sum(CASE WHEN outcome_label = 'success' THEN 1 ELSE 0 END), 0) AS BIGINT) AS good
    FROM edge_outbox_table GROUP BY 1)
SELECT d.query_id, d.selected_action, coalesce(outcomes, 0) AS outcomes, CASE WHEN coalesce(outcomes, 0) = 0 THEN 'no evidence' WHEN good * 2 >= outcomes THEN 'allow' ELSE 'suppress' END AS decision
FROM fleet_decision_table d LEFT JOIN o USING (query_id)""",
    "fleet_decision_table", "edge_outbox_table",
)
def _(d, o):
    evidence = o.groupBy("query_id").agg(
        F.count("action_class").alias("outcomes"), F.sum(F.when(F.col("outcome_label") == "success", 1).otherwise(0)).alias("good")
    )
    n = F.coalesce("outcomes", F.lit(0))
    decision = F.when(n == 0, "no evidence").when(F.col("good") * 2 >= n, "allow").otherwise("suppress")
    return d.select("query_id", "selected_action").join(evidence, "query_id", "left").select("query_id", "selected_action", n.alias("outcomes"), decision.alias("decision"))
