"""Operations on memory records and cache entries.

Record columns: memory_id, tenant_id, namespace_id, user_id, session_id, agent_id, type, content, metadata_json (strings), embedding
(array of floats), token_count, created_at_ns, last_accessed_ns, expires_at_ns, access_count (longs), importance (double), pinned (boolean).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECORD = """memory_id string, tenant_id string, namespace_id string, user_id string, session_id string, agent_id string, type string,
  content string, metadata_json string, embedding array<float>, token_count bigint, created_at_ns bigint, last_accessed_ns bigint,
  expires_at_ns bigint, access_count bigint, importance double, pinned boolean"""
ENTRY = """cache_id string, tenant_id string, namespace_id string, prompt string, response string, metadata_json string, embedding array<float>,
  token_count bigint, created_at_ns bigint, last_accessed_ns bigint, expires_at_ns bigint, access_count bigint"""
#: Least cosine at which a cached prompt answers another one.
SEMANTIC_THRESHOLD = 0.92


def estimated_tokens(text: Column | str) -> Column:
    """A token for every four bytes, rounded up."""
    text = F.col(text) if isinstance(text, str) else text
    return F.call_function("div", F.octet_length(text) + F.lit(3), F.lit(4))


def normalised_prompt(text: Column | str) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 for a missing, empty or zero vector and for vectors of different sizes."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    norm = F.sqrt(dot(a, a) * dot(b, b))
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(F.coalesce(fits & (norm > 0), F.lit(False)), dot(a, b) / F.when(norm > 0, norm)).otherwise(F.lit(0.0))


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<float>")


def put(records: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (tenant, id): new records replace old ones; of several new ones the latest created stays.

    Missing ids are made from the content's hash, missing namespaces are ``default``, missing token counts estimated.
    """
    ready = new.select(
        F.coalesce("memory_id", F.concat(F.lit("mem_"), F.sha2(F.concat_ws("\x01", "tenant_id", "namespace_id", "content"), 256))).alias("memory_id"),
        *[F.col(c) for c in ("tenant_id",)],
        F.coalesce(F.nullif(F.col("namespace_id"), F.lit("")), F.lit("default")).alias("namespace_id"),
        *[F.col(c) for c in ("user_id", "session_id", "agent_id", "type", "content", "metadata_json", "embedding")],
        F.when(F.coalesce(F.col("token_count"), F.lit(0)) == 0, estimated_tokens("content")).otherwise(F.col("token_count")).alias("token_count"),
        *[F.col(c) for c in ("created_at_ns", "last_accessed_ns", "expires_at_ns", "access_count", "importance", "pinned")],
    )
    rows = records.withColumn("age_", F.lit(0)).unionByName(ready.withColumn("age_", F.lit(1)))
    latest = Window.partitionBy("tenant_id", "memory_id").orderBy(F.desc("age_"), F.desc_nulls_last("created_at_ns"))
    return rows.withColumn("rn_", F.row_number().over(latest)).where("rn_ = 1").drop("rn_", "age_")


def visible(records: DataFrame, now_ns: int, **fields: str | None) -> DataFrame:
    """Records that haven't expired and match the given fields (None matches everything)."""
    expired = (F.coalesce(F.col("expires_at_ns"), F.lit(0)) > 0) & (F.col("expires_at_ns") <= now_ns)
    rows = records.where(~expired)
    for name, value in fields.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def score(similarity: Column, now_ns: int) -> Column:
    """Rank of a record: similarity first, then importance, pinning, age in hours and use."""
    age_h = F.greatest(F.lit(0.0), (F.lit(now_ns) - F.coalesce(F.col("created_at_ns"), F.lit(now_ns))) / F.lit(3.6e12))
    return (
        F.lit(10.0) * similarity
        + F.coalesce(F.col("importance"), F.lit(0.0))
        + F.when(F.col("pinned"), F.lit(5.0)).otherwise(F.lit(0.0))
        + F.lit(1.0) / (F.lit(1.0) + age_h)
        + F.least(F.lit(1.0), F.lit(0.01) * F.coalesce(F.col("access_count"), F.lit(0)))
    )


def search(records: DataFrame, query: Sequence[float] | None, k: int, now_ns: int, **fields: str | None) -> DataFrame:
    """The k best visible records with ``similarity`` and ``score``; ties by creation (newest first), then id."""
    rows = visible(records, now_ns, **fields)
    similarity = cosine(F.col("embedding"), vector(query)) if query is not None else F.lit(0.0)
    ranked = rows.withColumn("similarity", similarity).withColumn("score", score(F.col("similarity"), now_ns))
    return ranked.orderBy(F.desc("score"), F.desc_nulls_last("created_at_ns"), "memory_id").limit(k)


def touched(records: DataFrame, found: DataFrame, now_ns: int) -> DataFrame:
    """The records with use counted for those found."""
    hit = found.select("tenant_id", "memory_id", F.lit(1).alias("hit_"))
    rows = records.join(hit, ["tenant_id", "memory_id"], "left")
    return rows.withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("hit_", F.lit(0))).withColumn(
        "last_accessed_ns", F.when(F.col("hit_") == 1, F.lit(now_ns)).otherwise(F.col("last_accessed_ns"))
    ).drop("hit_").select(*records.columns)


def context(ranked: DataFrame, request: str, rank: str, content: str, tokens: str, budget: int) -> DataFrame:
    """Greedy choice by rank within a token budget, per request.

    Repeated contents are skipped, and so is an item that no longer fits: later, smaller ones may still go in.
    ``ranked`` holds the candidates of each request, which are few by construction (the k of a search). Adds ``used`` (tokens so far).
    """
    first = Window.partitionBy(request, content).orderBy(rank)
    rows = ranked.withColumn("dup_", F.row_number().over(first)).where("dup_ = 1").drop("dup_")
    schema = rows.withColumn("used", F.lit(0).cast("bigint")).schema

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rank, kind="stable")
        used, take, at = 0, [], []
        for i, n in enumerate(pdf[tokens].tolist()):
            if used + n <= budget:
                used += int(n)
                take.append(i)
                at.append(used)
        out = pdf.iloc[take].copy()
        out["used"] = at
        return out

    return rows.groupBy(request).applyInPandas(choose, schema)


def cache_lookup(entries: DataFrame, asked: DataFrame, now_ns: int, threshold: float = SEMANTIC_THRESHOLD, own: str | None = None) -> DataFrame:
    """Answers of a prompt cache: ``asked`` has request, tenant_id, namespace_id, prompt and embedding.

    The same normalised prompt of the tenant and namespace answers exactly; else the entry of the greatest cosine at
    or above the threshold, the newest first among equals. Requests without answer have no row. Columns:
    request, cache_id, response, similarity, exact. The entries of a request's tenant and namespace are compared; they
    are never gathered: the best one is kept by an aggregate that combines before the shuffle. ``own`` names a column of
    ``asked`` with the cache_id of a request's own entry, which doesn't answer it.
    """
    live = visible(entries, now_ns).withColumn("key_", normalised_prompt("prompt"))
    wanted = asked.withColumn("key_", normalised_prompt("prompt")).withColumn("own_", F.col(own).cast("string") if own else F.lit(None).cast("string"))
    other = ~F.col("cache_id").eqNullSafe(F.col("own_"))
    pick = F.struct(F.col("created_at_ns").alias("c"), F.col("cache_id"), F.col("response"))
    exact = wanted.select("request", "tenant_id", "namespace_id", "key_", "own_").join(live.select("tenant_id", "namespace_id", "key_", "cache_id", "response", "created_at_ns"), ["tenant_id", "namespace_id", "key_"])
    exact = exact.where(other).groupBy("request").agg(F.max(pick).alias("m")).select("request", "m.cache_id", "m.response", F.lit(1.0).alias("similarity"), F.lit(True).alias("exact"))
    rest = wanted.join(exact.select("request"), "request", "left_anti").select("request", "tenant_id", "namespace_id", F.col("embedding").alias("q_"), "own_")
    pairs = rest.join(live, ["tenant_id", "namespace_id"]).withColumn("s_", cosine("embedding", "q_")).where(other & (F.col("s_") >= threshold))
    near = pairs.groupBy("request").agg(F.max(F.struct("s_", F.col("created_at_ns").alias("c"), F.col("cache_id"), F.col("response"))).alias("m"))
    return exact.unionByName(near.select("request", "m.cache_id", "m.response", F.col("m.s_").alias("similarity"), F.lit(False).alias("exact")))


def evict(records: DataFrame, now_ns: int, per_tenant: int) -> DataFrame:
    """What stays: nothing expired, and of each tenant the records of greatest retention, pinned ones always.

    Retention is the score without similarity; ties go to the newer, then the smaller id. Pinned records count
    towards the tenant's quota but never leave.
    """
    rows = visible(records, now_ns).withColumn("pin_", F.coalesce("pinned", F.lit(False)))
    pinned, rest = rows.where("pin_").drop("pin_"), rows.where("NOT pin_").drop("pin_")
    taken = pinned.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("taken_"))
    by = Window.partitionBy("tenant_id").orderBy(F.desc("keep_"), F.desc_nulls_last("created_at_ns"), "memory_id")
    # the constant limit is applied in every task before the shuffle, the tenant's own one after it
    ranked = rest.withColumn("keep_", score(F.lit(0.0), now_ns)).withColumn("rn_", F.row_number().over(by)).where(F.col("rn_") <= per_tenant)
    room = F.lit(per_tenant) - F.coalesce("taken_", F.lit(0))
    kept = ranked.join(taken, "tenant_id", "left").where(F.col("rn_") <= room)
    return pinned.unionByName(kept.select(*records.columns))


def save(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
