"""The flagship: answer a table of questions from a table of chunks, with a result cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.session import materialize
from shelfmark.functions.text import strip
from shelfmark.operators import cache as result_cache
from shelfmark.operators.embedding import embed
from shelfmark.operators.fusion import coverage_scores, rerank_topk, rrf_fuse
from shelfmark.operators.lexical import CorpusStats, bm25_topk, corpus_stats, tokenise
from shelfmark.operators.nearest import vector_topk
from shelfmark.operators.postings import Index, corpus_stats_of, index_topk
from shelfmark.operators.results import result_rows

COLUMNS = [
    "query_id", "rank", "content", "source", "page", "industry",
    "stage", "retrieved_count", "candidates_count", "has_relevant_content",
]


def retrieve(
    queries: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame, query_vectors: DataFrame, stats: CorpusStats | None = None,
    index: Index | None = None,
) -> DataFrame:
    """Both retrievers, fused: ``(query_id, chunk_id, score, bm25_rank, vec_rank, rank)``. With an ``index`` no text is read.

    The list (20 rows per query at most) is written once, as scoring and shaping read it again.
    """
    lexical = index_topk(queries, index) if index else bm25_topk(queries, chunks, stats=stats)
    return materialize(rrf_fuse(lexical, vector_topk(query_vectors, chunk_vectors)), "fused")


def knowledge_query(
    queries: DataFrame,
    chunks: DataFrame,
    chunk_vectors: DataFrame | None = None,
    cache: DataFrame | None = None,
    now: Column | None = None,
    top_n: int = 3,
    index: Index | None = None,
) -> DataFrame:
    """``queries(query_id, query)`` to shaped result rows; a query without results keeps one row.

    ``cache(entry_id, query_hash, vec, chunk_ids, created_at, expires_at)`` answers repeated
    and near-repeated questions first; the others go through both retrievers, fusion and
    rerank. With a stored ``index`` of the chunks (``postings``) only the texts of candidates are read.
    """
    clean = queries.withColumn("query", strip(F.coalesce("query", F.lit(""))))
    blank = clean.filter(F.col("query") == "")
    asked = materialize(embed(clean.filter(F.col("query") != ""), "query"), "questions")
    if chunk_vectors is None:
        chunk_vectors = embed(chunks.select("chunk_id", "content"), "content").select("chunk_id", "vec")
    if cache is not None:
        hits = materialize(result_cache.probe(asked, cache, now), "cache-hits")
        asked_now = asked.join(hits, "query_id", "left_anti")
    else:
        asked_now = asked
    stats = corpus_stats_of(queries.sparkSession, index) if index else corpus_stats(tokenise(chunks))
    fused = retrieve(asked_now, chunks, chunk_vectors, asked_now.select("query_id", "vec"), stats, index)
    pairs = coverage_scores(fused.select("query_id", "chunk_id", "rank"), asked_now, chunks, stats=stats)
    ranked = materialize(rerank_topk(pairs, top_n), "ranked")
    answers = ranked.select("query_id", "chunk_id", "rank")
    stages = asked_now.select("query_id").join(
        fused.groupBy("query_id").agg(F.count("*").alias("candidates_count")), "query_id", "left"
    ).select(
        "query_id",
        F.when(F.col("candidates_count").isNull(), "dual_retrieve_empty").otherwise("dual_retrieve + rerank").alias("stage"),
        F.coalesce("candidates_count", F.lit(0).cast("bigint")).alias("candidates_count"),
    )
    zero = F.lit(0).cast("bigint").alias("candidates_count")
    stages = stages.unionByName(blank.select("query_id", F.lit("BAD_INPUT").alias("stage"), zero))
    if cache is not None:
        listed = hits.join(result_cache.latest_entries(cache), "entry_id").select("query_id", F.posexplode("chunk_ids"))
        answers = answers.unionByName(
            listed.select("query_id", F.col("col").alias("chunk_id"), (F.col("pos") + 1).alias("rank")).filter(F.col("rank") <= top_n)
        )
        stages = stages.unionByName(hits.select("query_id", F.lit("semantic_cache_hit").alias("stage"), zero))
    rows = result_rows(answers, chunks)
    counted = rows.groupBy("query_id").agg(F.count("*").alias("retrieved_count"))
    return (
        stages.join(counted, "query_id", "left").join(rows, "query_id", "left")
        .withColumn("retrieved_count", F.coalesce("retrieved_count", F.lit(0).cast("bigint")))
        .withColumn("has_relevant_content", F.col("retrieved_count") > 0)
        .select(*COLUMNS)
    )
