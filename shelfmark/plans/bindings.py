"""Logical tables derived from the given ones, and the same derivations as SQL text."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.session import materialize
from shelfmark.functions.sizing import spread
from shelfmark.operators.embedding import embed


class Tables:
    """Opens the parquet tables of one folder; every property is lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        return spread(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    @cached_property
    def chunks(self) -> DataFrame:
        d = self["documents"]
        page = F.col("doc_id") % 10 + 1
        return d.select(
            F.concat(
                "source", F.lit("::page_"), page.cast("string"), F.lit("::chunk_"), F.col("doc_id").cast("string")
            ).alias("chunk_id"),
            "source",
            page.alias("page"),
            F.when(F.col("doc_id") % 7 == 0, "table").otherwise("text").alias("doc_type"),
            F.col("lang").alias("industry"),
            F.col("text").alias("content"),
            "doc_id",
        )

    @cached_property
    def queries(self) -> DataFrame:
        return self["benchmark"].select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

    @cached_property
    def chunk_vectors(self) -> DataFrame:
        """The vector store: written once, read by every search."""
        rows = embed(self.chunks.select("chunk_id", "content"), "content").select("chunk_id", "vec")
        return materialize(rows, "chunk-vectors")

    @cached_property
    def query_vectors(self) -> DataFrame:
        return embed(self.queries, "query").select("query_id", "vec")

    @cached_property
    def vectors(self) -> DataFrame:
        return self["embeddings"].select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "label")


# --- the same tables for the check SQL ------------------------------------------------

WS_SQL = (
    r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"


def tokens_sql(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '{WS_SQL}+'), lambda t: t <> '')"


CHUNKS = """chunks AS (
  SELECT source || '::page_' || CAST(doc_id % 10 + 1 AS VARCHAR) || '::chunk_' || CAST(doc_id AS VARCHAR) AS chunk_id,
         source, doc_id % 10 + 1 AS page,
         CASE WHEN doc_id % 7 = 0 THEN 'table' ELSE 'text' END AS doc_type,
         lang AS industry, text AS content, doc_id
  FROM documents)"""

QUERIES_SQL = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"

LEXICAL = f"""docs AS (SELECT chunk_id, {tokens_sql('content')} AS terms FROM chunks),
toks AS (SELECT chunk_id, unnest(terms) AS term FROM docs),
dl AS (SELECT chunk_id, len(terms) AS dl FROM docs),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM toks GROUP BY ALL),
rawidf AS (SELECT term, ln((SELECT count(*) FROM docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf GROUP BY term),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM rawidf) ELSE raw END AS idf FROM rawidf),
qt AS (SELECT query_id, term, count(*) AS qtf FROM
       (SELECT query_id, unnest({tokens_sql('query')}) AS term FROM queries) GROUP BY ALL),
bm25_all AS (
  SELECT query_id, chunk_id,
         round(sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (chunk_id) GROUP BY ALL),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
         FROM bm25_all) WHERE rank <= 10)"""


def _slots(table: str, key: str, text: str) -> str:
    return f"""(SELECT {key}, slot, sum(sign) AS n FROM (
      SELECT {key}, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS slot,
             CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1 ELSE -1 END AS sign
      FROM (SELECT {key}, unnest({tokens_sql(text)}) AS term FROM {table})) GROUP BY ALL)"""


DENSE = f"""dslot AS {_slots('chunks', 'chunk_id', 'content')},
qslot AS {_slots('queries', 'query_id', 'query')},
dnorm AS (SELECT chunk_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS size FROM dslot GROUP BY ALL),
qnorm AS (SELECT query_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS size FROM qslot GROUP BY ALL),
dots AS (SELECT query_id, chunk_id, CAST(sum(q.n * d.n) AS DOUBLE) AS dot FROM qslot q JOIN dslot d USING (slot) GROUP BY ALL),
dense_all AS (
  SELECT q.query_id, c.chunk_id,
         round(coalesce(CASE WHEN qn.size * dn.size > 0 THEN dot / (qn.size * dn.size) END, 0.0), 6) AS score
  FROM queries q CROSS JOIN chunks c LEFT JOIN dots USING (query_id, chunk_id)
       LEFT JOIN qnorm qn USING (query_id) LEFT JOIN dnorm dn USING (chunk_id)),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
          FROM dense_all) WHERE rank <= 10)"""

FUSED = """fused_all AS (
  SELECT query_id, chunk_id, round(sum(share), 9) AS score, min(bm25_rank) AS bm25_rank, min(vec_rank) AS vec_rank FROM (
    SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS share, rank AS bm25_rank, NULL AS vec_rank FROM bm25
    UNION ALL
    SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank), NULL, rank FROM dense) GROUP BY ALL),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
          ORDER BY score DESC, bm25_rank NULLS LAST, vec_rank NULLS LAST) AS rank FROM fused_all) WHERE rank <= 20)"""

RERANKED = """qtotal AS (SELECT query_id, sum(coalesce(idf, 0)) AS total FROM qt LEFT JOIN idf USING (term) GROUP BY ALL),
covered AS (SELECT f.query_id, f.chunk_id, sum(idf) AS covered FROM fused f
            JOIN tf USING (chunk_id) JOIN qt ON qt.query_id = f.query_id AND qt.term = tf.term
            JOIN idf ON idf.term = tf.term GROUP BY ALL),
pairs AS (SELECT f.query_id, f.chunk_id, f.rank,
                 round(CASE WHEN total > 0 THEN coalesce(covered, 0) / total ELSE 0 END, 6) AS score
          FROM fused f LEFT JOIN covered USING (query_id, chunk_id) LEFT JOIN qtotal USING (query_id)),
reranked AS (SELECT query_id, chunk_id, score, final_rank AS rank, max(score) OVER (PARTITION BY query_id) AS top_score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS final_rank
        FROM pairs WHERE score > 0.1) WHERE final_rank <= 3)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


RETRIEVAL = with_sql(CHUNKS, QUERIES_SQL, LEXICAL, DENSE, FUSED, RERANKED)


# --- cache: labelled documents were asked before, the others are asked now -------------

CACHE_NOW = "2024-01-02 12:00:00"

CACHE = f"""asked_before AS (
  SELECT d.doc_id AS entry_id, md5(lower({strip_sql('d.text')})) AS query_hash, d.text, e.ts AS created_at,
         e.ts + INTERVAL 1 DAY AS expires_at
  FROM documents d JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) JOIN events e ON e.event_id = d.doc_id),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_hash ORDER BY created_at DESC, entry_id DESC) AS n
           FROM asked_before) WHERE n = 1),
live AS (SELECT * FROM latest WHERE expires_at > TIMESTAMP '{CACHE_NOW}'),
asked_now AS (SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
exact AS (SELECT query_id, md5(lower({strip_sql('query')})) AS query_hash, entry_id
          FROM asked_now LEFT JOIN live ON live.query_hash = md5(lower({strip_sql('query')})))"""


def cache_now():
    return F.lit(CACHE_NOW).cast("timestamp_ntz")


def asked_before(t: Tables) -> DataFrame:
    d = t["documents"].join(t["labels"].select("doc_id"), "doc_id", "left_semi")
    e = t["events"].select(F.col("event_id").alias("doc_id"), F.col("ts").alias("created_at"))
    from shelfmark.functions.text import query_hash

    rows = d.join(e, "doc_id").join(t.chunks.select("doc_id", "chunk_id"), "doc_id")
    entries = embed(rows, "text").select(
        F.col("doc_id").alias("entry_id"),
        query_hash(F.col("text")).alias("query_hash"),
        F.substring("text", 1, 60).alias("preview"),
        "vec",
        F.array("chunk_id").alias("chunk_ids"),
        "created_at",
        (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("expires_at"),
    )
    return materialize(entries, "cache")


def asked_now(t: Tables) -> DataFrame:
    d = t["documents"].join(t["labels"].select("doc_id"), "doc_id", "left_anti")
    return d.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
