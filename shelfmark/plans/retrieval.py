"""Bound queries: retrieval, fusion, rerank, result cache, shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.session import materialize, work_dir
from shelfmark.operators import cache as result_cache
from shelfmark.operators.cells import cell_topk
from shelfmark.operators.embedding import embed
from shelfmark.operators.fusion import coverage_scores, rerank_fallback, rerank_topk, rrf_fuse
from shelfmark.operators.lexical import bm25_topk, corpus_stats, tokenise
from shelfmark.operators.nearest import semantic_dedup, vector_topk
from shelfmark.operators.postings import index_topk, update_index
from shelfmark.operators.results import result_flat, result_rows
from shelfmark.plans.bindings import (
    CACHE, CACHE_NOW, CHUNKS, DENSE, FUSED, LEXICAL, QUERIES_SQL, RERANKED, RETRIEVAL, WS_SQL,
    asked_before, asked_now, cache_now, strip_sql, with_sql, _slots,
)
from shelfmark.plans.knowledge import knowledge_query as run_knowledge_query, retrieve
from shelfmark.plans.registry import query

TRIM3 = "CASE WHEN length({s}) <= {n} THEN {s} ELSE substr({s}, 1, {n} - 3) || '...' END"


def _shaped(s: str) -> str:
    return ("'[来源：' || source || '  第 ' || CAST(page AS VARCHAR) || ' 页]' || chr(10) || "
            + TRIM3.format(s=s, n=800))


@query("bm25_topk", with_sql(CHUNKS, QUERIES_SQL, LEXICAL) + "\nSELECT query_id, chunk_id, score, rank FROM bm25")
def bm25(t):
    return bm25_topk(t.queries, t.chunks)


@query("bm25_index_topk", with_sql(CHUNKS, QUERIES_SQL, LEXICAL) + "\nSELECT query_id, chunk_id, score, rank FROM bm25")
def bm25_index(t):
    """The same ranking from a stored index that came about in three updates: a first state with stale and dropped sources, then the present one."""
    root, source = work_dir(t.spark, "index"), F.col("source")
    early = t.chunks.filter(F.xxhash64("source") % 3 != 0)
    old = early.select("chunk_id", "source", F.concat(F.lit("old "), "content").alias("content"))
    gone = t.chunks.select(F.concat("chunk_id", F.lit("?")).alias("chunk_id"), F.concat(source, F.lit("?")).alias("source"), "content")
    update_index(old.unionByName(gone), root)
    update_index(t.chunks.filter(F.xxhash64("source") % 3 == 0), root, removed=gone.select("source"))
    return index_topk(t.queries, update_index(early, root))


@query("result_rows", with_sql(CHUNKS, QUERIES_SQL, LEXICAL) + f"""
SELECT query_id, chunk_id, rank, {_shaped(strip_sql('content'))} AS content, source, page, industry
FROM bm25 JOIN chunks USING (chunk_id)""")
def shaped(t):
    return result_rows(bm25_topk(t.queries, t.chunks).select("query_id", "chunk_id", "rank"), t.chunks)


@query("hash_embed", with_sql(CHUNKS, f"s AS {_slots('chunks', 'chunk_id', 'content')}",
    "z AS (SELECT chunk_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS size FROM s GROUP BY ALL)") + """
SELECT chunk_id, slot, round(n / size, 6) AS weight FROM s JOIN z USING (chunk_id) WHERE n <> 0""")
def hash_embed(t):
    """Vector of each chunk, non-zero entries as rows."""
    rows = t.chunk_vectors.select("chunk_id", F.posexplode("vec").alias("slot", "weight"))
    return rows.filter(F.col("weight") != 0).withColumn("weight", F.round("weight", 6))


VECTORS = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sims AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS want, c.label AS got,
                round(list_inner_product(q.e, c.e), 6) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
        FROM sims) WHERE rank <= 10)"""


def vector_hits(t):
    return vector_topk(t.vectors.withColumnRenamed("chunk_id", "query_id"), t.vectors, exclude_self=True)


@query("vector_topk", with_sql(VECTORS) + " SELECT query_id, chunk_id, score, rank FROM top")
def vectors(t):
    """Every vector against all others."""
    return vector_hits(t)


@query("cell_topk", with_sql(VECTORS) + " SELECT query_id, chunk_id, score, rank FROM top")
def vectors_by_cells(t):
    """Every vector against all others as a join of cells, with more and smaller cells than the default has for tables of this size."""
    return cell_topk(t.vectors.withColumnRenamed("chunk_id", "query_id"), t.vectors, exclude_self=True, pivots=16, slice_rows=256)


@query("dense_topk", with_sql(CHUNKS, QUERIES_SQL, DENSE) + " SELECT query_id, chunk_id, score, rank FROM dense")
def dense(t):
    """Text questions against chunk vectors."""
    return vector_topk(t.query_vectors, t.chunk_vectors)


def fused_lists(t, stats=None):
    return retrieve(t.queries, t.chunks, t.chunk_vectors, t.query_vectors, stats)


@query("rrf_fuse", with_sql(CHUNKS, QUERIES_SQL, LEXICAL, DENSE, FUSED) +
       " SELECT query_id, chunk_id, score, bm25_rank, vec_rank, rank FROM fused")
def fuse(t):
    return fused_lists(t)


@query("rrf_single", with_sql(CHUNKS, QUERIES_SQL, LEXICAL) +
       " SELECT query_id, chunk_id, round(1.0::DOUBLE / (60 + rank), 9) AS score, rank FROM bm25")
def fuse_one(t):
    """One retriever missing: the other list stands alone."""
    return rrf_fuse(bm25_topk(t.queries, t.chunks), None).select("query_id", "chunk_id", "score", "rank")


def fused_and_scored(t):
    """The fused lists and their reranking scores, from one count of the corpus."""
    stats = corpus_stats(tokenise(t.chunks))
    fused = fused_lists(t, stats)
    return fused, coverage_scores(fused.select("query_id", "chunk_id", "rank"), t.queries, t.chunks, stats=stats)


@query("rerank_topk", RETRIEVAL + " SELECT query_id, chunk_id, score, rank, top_score FROM reranked")
def rerank(t):
    return rerank_topk(fused_and_scored(t)[1])


@query("rerank_fallback", RETRIEVAL.replace("score > 0.1)", "score > 0.9)") + """
SELECT query_id, chunk_id, rank, false AS fallback FROM reranked
UNION ALL SELECT query_id, chunk_id, rank, true FROM fused
WHERE rank <= 3 AND query_id NOT IN (SELECT query_id FROM reranked)""")
def fallback(t):
    """A strict threshold leaves some questions empty, so that the fallback shows."""
    fused, pairs = fused_and_scored(t)
    return rerank_fallback(rerank_topk(pairs, threshold=0.9), fused)


@query("knowledge_query", with_sql(
    CACHE, CHUNKS,
    "all_queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)",
    f"lookup AS (SELECT query_id, query, entry_id FROM all_queries LEFT JOIN live ON query_hash = md5(lower({strip_sql('query')})))",
    f"lslot AS {_slots('(SELECT entry_id, text FROM live)', 'entry_id', 'text')}",
    f"mslot AS {_slots('(SELECT query_id, query FROM lookup WHERE entry_id IS NULL)', 'query_id', 'query')}",
    "lnorm AS (SELECT entry_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS size FROM lslot GROUP BY ALL)",
    "mnorm AS (SELECT query_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS size FROM mslot GROUP BY ALL)",
    """near AS (SELECT query_id, entry_id FROM (
      SELECT query_id, entry_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS n FROM (
        SELECT query_id, entry_id, round(CAST(sum(m.n * l.n) AS DOUBLE) / (any_value(mn.size) * any_value(ln.size)), 6) AS score
        FROM mslot m JOIN lslot l USING (slot) JOIN mnorm mn USING (query_id) JOIN lnorm ln USING (entry_id) GROUP BY ALL))
      WHERE n = 1 AND score >= 0.95)""",
    """hits AS (SELECT query_id, entry_id FROM lookup WHERE entry_id IS NOT NULL UNION ALL SELECT * FROM near)""",
    "queries AS (SELECT * FROM all_queries WHERE query_id NOT IN (SELECT query_id FROM hits))",
    LEXICAL, DENSE, FUSED, RERANKED,
    """answers AS (SELECT query_id, chunk_id, rank FROM reranked
      UNION ALL SELECT query_id, chunk_id, 1 FROM hits JOIN chunks ON doc_id = entry_id)""",
    f"shaped AS (SELECT query_id, rank, {_shaped(strip_sql('content'))} AS content, source, page, industry FROM answers JOIN chunks USING (chunk_id))",
    """stages AS (SELECT query_id, CASE WHEN count(chunk_id) = 0 THEN 'dual_retrieve_empty' ELSE 'dual_retrieve + rerank' END AS stage,
        count(chunk_id) AS candidates_count FROM queries LEFT JOIN fused USING (query_id) GROUP BY query_id
      UNION ALL SELECT query_id, 'semantic_cache_hit', 0 FROM hits)""",
    "counted AS (SELECT query_id, count(*) AS n FROM shaped GROUP BY ALL)") + """
SELECT query_id, rank, content, source, page, industry, stage, coalesce(n, 0) AS retrieved_count, candidates_count,
       coalesce(n, 0) > 0 AS has_relevant_content
FROM stages LEFT JOIN counted USING (query_id) LEFT JOIN shaped USING (query_id)""")
def knowledge(t):
    """The whole pipeline over all benchmark questions, with the cache of labelled documents."""
    return run_knowledge_query(t.queries, t.chunks, t.chunk_vectors, asked_before(t), cache_now())


@query("result_flat", with_sql(CHUNKS) + f"""
SELECT chunk_id, CASE WHEN length(s) <= 800 THEN s ELSE regexp_replace(substr(s, 1, 800), '{WS_SQL}+$', '') || '...' END AS content,
       split_part(chunk_id, '::', 1) AS source, page, doc_type, industry
FROM (SELECT *, {strip_sql('content')} AS s FROM chunks) WHERE s <> ''""")
def flat(t):
    return result_flat(t.chunks)


# --- cache -----------------------------------------------------------------------------


@query("cache_exact", with_sql(CACHE) + " SELECT query_id, query_hash, entry_id FROM exact")
def cache_exact(t):
    return result_cache.exact_probe(asked_now(t), asked_before(t), cache_now())


@query("cache_semantic", with_sql(CACHE,
    f"lslot AS {_slots('live', 'entry_id', 'text')}",
    f"mslot AS {_slots('(SELECT query_id, query FROM asked_now WHERE query_id IN (SELECT query_id FROM exact WHERE entry_id IS NULL))', 'query_id', 'query')}",
    "lnorm AS (SELECT entry_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS size FROM lslot GROUP BY ALL)",
    "mnorm AS (SELECT query_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS size FROM mslot GROUP BY ALL)",
    """sims AS (SELECT query_id, entry_id, round(CAST(sum(m.n * l.n) AS DOUBLE) / (any_value(mn.size) * any_value(ln.size)), 6) AS similarity
      FROM mslot m JOIN lslot l USING (slot) JOIN mnorm mn USING (query_id) JOIN lnorm ln USING (entry_id) GROUP BY ALL)""") + """
SELECT query_id, entry_id, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) AS n FROM sims)
WHERE n = 1 AND similarity >= 0.95""")
def cache_semantic(t):
    """Only exact misses are compared by vector."""
    now, cache = cache_now(), asked_before(t)
    asked = materialize(embed(asked_now(t), "query"), "questions")
    exact = result_cache.exact_probe(asked, cache, now)
    missed = asked.join(exact.filter(F.col("entry_id").isNull()), "query_id", "left_semi")
    return result_cache.semantic_probe(missed, cache, now)


@query("cache_live", with_sql(CACHE) + " SELECT entry_id, query_hash, created_at, expires_at FROM live")
def cache_live(t):
    entries = result_cache.latest_entries(asked_before(t).drop("vec", "chunk_ids"))
    return result_cache.live(entries, cache_now()).select("entry_id", "query_hash", "created_at", "expires_at")


@query("cache_admit", f"""
SELECT event_id AS query_id, n = 0 OR s >= 0.5 AS write_exact, n <> 0 AND s >= 0.5 AS write_semantic,
       CASE WHEN n = 0 THEN 300 WHEN s < 0.5 THEN NULL ELSE 3600 END AS ttl_seconds,
       TIMESTAMP '{CACHE_NOW}' + to_seconds(CASE WHEN n = 0 THEN 300 WHEN s < 0.5 THEN NULL ELSE 3600 END) AS expires_at
FROM (SELECT event_id, value / 100 AS s, CAST(props->>'$.k' AS BIGINT) AS n FROM events)""")
def cache_admit(t):
    """Scores and result counts taken from the event log."""
    done = t["events"].select(
        F.col("event_id").alias("query_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("n_docs"),
        (F.col("value") / 100).alias("top_score"),
    )
    return result_cache.admit(done, cache_now())


def _cache_index(t):
    index = t["events"].select(F.col("event_id").alias("entry_id"), F.col("ts").alias("created_at"))
    vectors = t["events"].filter(F.col("event_type") != "error").select(F.col("event_id").alias("entry_id"))
    return index, vectors


@query("cache_orphans", "SELECT event_id AS entry_id FROM events WHERE event_type = 'error'")
def cache_orphans(t):
    return result_cache.orphans(*_cache_index(t))


@query("cache_evict", """
WITH sound AS (SELECT event_id AS entry_id, ts AS created_at,
                      row_number() OVER (ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'error')
SELECT entry_id, created_at FROM sound
WHERE (SELECT count(*) FROM events) >= 2000 AND ((SELECT count(*) FROM sound) < 2000 OR n > 200)
UNION ALL SELECT event_id, ts FROM events WHERE (SELECT count(*) FROM events) < 2000""")
def cache_evict(t):
    index, vectors = _cache_index(t)
    return result_cache.evict(index, vectors)


@query("semantic_dedup")
def dedup(t):
    """Documents in id order, later near copies removed; compared with brute force in the tests."""
    records = t.chunks.select("doc_id", "chunk_id", "content")
    rows = embed(records, "content").select(F.col("doc_id").alias("ord"), "chunk_id", "vec")
    return semantic_dedup(rows).select("ord", "chunk_id")
