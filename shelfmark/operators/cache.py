"""Two-tier result cache as tables: exact by hash, then nearest by cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import query_hash
from shelfmark.functions.windows import first_per_key
from shelfmark.operators.nearest import vector_topk

# Fixed values of the cache policy.
SIMILARITY = 0.95
MIN_SCORE = 0.5
TTL_SECONDS = 3600
EMPTY_TTL_SECONDS = 300
CAPACITY = 2000


def live(cache: DataFrame, now: Column) -> DataFrame:
    return cache.filter(F.col("expires_at") > now)


def latest_entries(cache: DataFrame) -> DataFrame:
    """One entry per query hash: a later write replaces an earlier one."""
    return first_per_key(cache, ["query_hash"], [F.col("created_at"), F.col("entry_id")], last=True)


def exact_probe(queries: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """``(query_id, query_hash, entry_id)``; ``entry_id`` is NULL on a miss."""
    entries = live(latest_entries(cache), now).select("query_hash", "entry_id")
    hashed = queries.select("query_id", query_hash(F.col("query")).alias("query_hash"))
    return hashed.join(entries, "query_hash", "left").select("query_id", "query_hash", "entry_id")


def semantic_probe(
    misses: DataFrame, cache: DataFrame, now: Column, threshold: float = SIMILARITY
) -> DataFrame:
    """Nearest live entry per missed query ``(query_id, vec)``, if similar enough.

    Entries written to the exact tier only (``write_semantic`` false, or no vector) never answer here.
    """
    current = live(latest_entries(cache), now).filter(F.col("vec").isNotNull())
    if "write_semantic" in cache.columns:
        current = current.filter("write_semantic")
    entries = current.select(F.col("entry_id").alias("chunk_id"), "vec")
    best = vector_topk(misses.select("query_id", "vec"), entries, k=1, least=threshold)
    return best.filter(F.col("score") >= threshold).select(
        "query_id", F.col("chunk_id").alias("entry_id"), F.col("score").alias("similarity")
    )


def probe(queries: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Both tiers: ``(query_id, entry_id, tier)``; the dear tier sees only exact misses.

    ``queries(query_id, query, vec)``.
    """
    exact = exact_probe(queries, cache, now)
    missed = queries.join(exact.filter(F.col("entry_id").isNull()).select("query_id"), "query_id", "left_semi")
    near = semantic_probe(missed, cache, now)
    return exact.filter(F.col("entry_id").isNotNull()).select("query_id", "entry_id", F.lit("exact").alias("tier")).unionByName(
        near.select("query_id", "entry_id", F.lit("semantic").alias("tier"))
    )


def admit(results: DataFrame, now: Column) -> DataFrame:
    """What to write for each finished query ``(query_id, n_docs, top_score)``.

    No documents: exact tier only, short life. Weak best score: nothing. Else both tiers.
    """
    none = F.col("n_docs") == 0
    weak = F.col("top_score") < MIN_SCORE
    ttl = F.when(none, EMPTY_TTL_SECONDS).when(weak, None).otherwise(TTL_SECONDS)
    return results.select(
        "query_id",
        (none | ~weak).alias("write_exact"),
        (~none & ~weak).alias("write_semantic"),
        ttl.alias("ttl_seconds"),
        (now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ttl.cast("decimal(18,6)"))).alias("expires_at"),
    )


def orphans(index: DataFrame, vectors: DataFrame) -> DataFrame:
    """Index ids whose vector is gone."""
    return index.select("entry_id").join(vectors.select("entry_id"), "entry_id", "left_anti")


def evict(index: DataFrame, vectors: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Index rows left before a write: below capacity all; else orphans go, and if that is
    not enough the oldest tenth of the capacity goes too."""
    sound = index.join(vectors.select("entry_id"), "entry_id", "left_semi")
    full = index.agg(F.count("*") >= capacity).scalar()
    still_full = sound.agg(F.count("*") >= capacity).scalar()
    oldest = sound.orderBy("created_at", "entry_id").limit(max(1, capacity // 10)).select("entry_id")
    kept = sound.join(oldest.filter(still_full), "entry_id", "left_anti")
    return kept.unionByName(index.join(vectors.select("entry_id"), "entry_id", "left_anti").filter(~full)).select(index.columns)
