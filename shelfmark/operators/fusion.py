"""Merging ranked lists and reranking the merged pool."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.sizing import broadcast_if_bounded
from shelfmark.functions.text import tokens
from shelfmark.operators.lexical import CorpusStats, corpus_stats, query_terms, tokenise

# Fixed values of the retrieval pipeline.
RRF_K = 60
POOL = 20
RERANK_THRESHOLD = 0.1
RERANK_TOP = 3


def result_key(chunk_id: Column, content: Column) -> Column:
    """Identity of a result: its id (an empty one counts), else the start of its text."""
    return F.coalesce(chunk_id, F.substring(content, 1, 100))


def rrf_fuse(lexical: DataFrame | None, dense: DataFrame | None, pool: int = POOL, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two lists ``(query_id, chunk_id, rank)``, ``content`` optional.

    A result without an id is known by the start of its text; without both it stands alone. Either list may be missing; the other then stands alone. Ties keep the order in which
    results are first seen: the lexical list first, then the dense one.
    """
    lists = [(lexical, "bm25_rank", "vec_rank"), (dense, "vec_rank", "bm25_rank")]
    parts = [
        df.select(
            "query_id", "chunk_id", F.col("rank").alias(mine), F.lit(None).cast("int").alias(other),
            F.coalesce(
                result_key(F.col("chunk_id").cast("string"), F.col("content") if "content" in df.columns else F.lit(None).cast("string")),
                F.concat(F.lit(f"{mine} "), F.col("rank").cast("string")),
            ).alias("_key"),
        )
        for df, mine, other in lists
        if df is not None
    ]
    if not parts:
        raise ValueError("both lists are missing")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    share = F.coalesce(1.0 / (k + F.col("bm25_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("vec_rank")), F.lit(0.0))
    fused = both.groupBy("query_id", "_key").agg(
        F.min("chunk_id").alias("chunk_id"),
        F.round(F.sum(share), 9).alias("score"),
        F.min("bm25_rank").alias("bm25_rank"),
        F.min("vec_rank").alias("vec_rank"),
    )
    best = Window.partitionBy("query_id").orderBy(
        F.col("score").desc(), F.col("bm25_rank").asc_nulls_last(), F.col("vec_rank").asc_nulls_last()
    )
    ranked = fused.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= pool)
    return ranked.select("query_id", "chunk_id", "score", "bm25_rank", "vec_rank", "rank")


def coverage_scores(
    pairs: DataFrame, queries: DataFrame, chunks: DataFrame, tokenizer=tokens, stats: CorpusStats | None = None
) -> DataFrame:
    """Default pair scorer: the idf-weighted share of distinct query terms found in the chunk."""
    stats = stats or corpus_stats(tokenise(chunks, tokenizer))
    weighted = query_terms(queries, tokenizer).join(stats.terms, "term", "left")
    weighted = weighted.select("query_id", "term", F.coalesce("idf", F.lit(0.0)).alias("idf"))
    total = weighted.groupBy("query_id").agg(F.sum("idf").alias("total"))
    wanted = broadcast_if_bounded(pairs)
    # Only candidate chunks are split into terms.
    candidates = chunks.select("chunk_id", "content").join(wanted.select("chunk_id"), "chunk_id", "left_semi")
    found = (
        tokenise(candidates, tokenizer).join(wanted.select("query_id", "chunk_id"), "chunk_id")
        .select("query_id", "chunk_id", F.explode_outer(F.array_distinct("terms")).alias("term"))
        .join(weighted, ["query_id", "term"])
        .groupBy("query_id", "chunk_id")
        .agg(F.sum("idf").alias("covered"))
    )
    share = F.when(F.col("total") > 0, F.coalesce("covered", F.lit(0.0)) / F.col("total")).otherwise(F.lit(0.0))
    return (
        pairs.join(found, ["query_id", "chunk_id"], "left").join(total, "query_id", "left")
        .select(*[pairs[c] for c in pairs.columns if c not in ("score",)], F.round(share, 6).alias("score"))
    )


def udf_scores(pairs: DataFrame, queries: DataFrame, chunks: DataFrame, fn: Callable[[Column, Column], Column]) -> DataFrame:
    """Pair scorer backed by a caller's (iterator pandas) UDF over query and content."""
    joined = pairs.drop("score").join(queries.select("query_id", "query"), "query_id").join(
        chunks.select("chunk_id", "content"), "chunk_id"
    )
    return joined.withColumn("score", fn(F.col("query"), F.col("content"))).drop("query", "content")


def rerank_topk(scored: DataFrame, top_n: int = RERANK_TOP, threshold: float = RERANK_THRESHOLD) -> DataFrame:
    """Keep pairs scoring above ``threshold``, best ``top_n`` per query.

    ``scored(query_id, chunk_id, score, rank)`` where ``rank`` is the position before
    reranking; equal scores keep that order. ``top_score`` is the best score per query.
    """
    top_n = max(1, min(10, top_n))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rank").asc())
    kept = (
        scored.filter(F.col("score") > threshold)
        .withColumn("final_rank", F.row_number().over(best))
        .filter(F.col("final_rank") <= top_n)
    )
    return kept.select(
        "query_id", "chunk_id", "score", F.col("final_rank").alias("rank"),
        F.max("score").over(Window.partitionBy("query_id")).alias("top_score"),
    )


def rerank_fallback(reranked: DataFrame, fused: DataFrame, top_n: int = RERANK_TOP) -> DataFrame:
    """Queries with no surviving reranked row take the first ``min(3, top_n)`` fused rows."""
    missing = fused.filter(F.col("rank") <= min(3, top_n)).join(reranked.select("query_id"), "query_id", "left_anti")
    return reranked.select("query_id", "chunk_id", "rank", F.lit(False).alias("fallback")).unionByName(
        missing.select("query_id", "chunk_id", "rank", F.lit(True).alias("fallback"))
    )
