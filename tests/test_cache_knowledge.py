"""Result cache and the whole question pipeline."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shelfmark.functions.text import query_hash
from shelfmark.operators import cache as rc
from shelfmark.operators.embedding import embed
from shelfmark.plans.knowledge import knowledge_query

T0 = datetime(2024, 1, 1)


def now():
    return F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")


def cache_of(spark, rows):
    """rows: (entry_id, text, chunk_ids, created minutes, lives minutes)"""
    data = [(i, q, ids, T0 + timedelta(minutes=m), T0 + timedelta(minutes=m + life)) for i, q, ids, m, life in rows]
    df = spark.createDataFrame(data, "entry_id long, text string, chunk_ids array<string>, created_at timestamp_ntz, expires_at timestamp_ntz")
    return embed(df, "text").withColumn("query_hash", query_hash(F.col("text")))


def test_exact_hits_ignore_case_and_space_and_expire(spark):
    cache = cache_of(spark, [(1, "What is X", ["a"], 0, 120), (2, "old one", ["b"], 0, 30), (3, " WHAT is x ", ["c"], 10, 120)])
    q = spark.createDataFrame([(1, "what IS x  "), (2, "old one"), (3, "new")], "query_id long, query string")
    got = {r.query_id: r.entry_id for r in rc.exact_probe(q, cache, now()).collect()}
    assert got == {1: 3, 2: None, 3: None}


def test_semantic_tier_sees_misses_only(spark):
    base = " ".join(f"w{i}" for i in range(60))
    cache = cache_of(spark, [(1, base, ["a"], 0, 120), (2, base + " more", ["b"], 0, 120)])
    q = embed(spark.createDataFrame([(1, base), (2, base + " other"), (3, "unrelated words only")], "query_id long, query string"), "query")
    got = {r.query_id: r.tier for r in rc.probe(q, cache, now()).collect()}
    assert got == {1: "exact", 2: "semantic"}


def test_admission(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (2, 3, 0.49), (3, 3, 0.5)], "query_id long, n_docs long, top_score double")
    got = {r.query_id: (r.write_exact, r.write_semantic, r.ttl_seconds) for r in rc.admit(df, now()).collect()}
    assert got == {1: (True, False, 300), 2: (False, False, None), 3: (True, True, 3600)}


def test_eviction(spark):
    index = spark.createDataFrame([(i, T0 + timedelta(minutes=i)) for i in range(30)], "entry_id long, created_at timestamp_ntz")

    def left(alive, capacity):
        vectors = spark.createDataFrame([(i,) for i in alive], "entry_id long")
        return sorted(r.entry_id for r in rc.evict(index, vectors, capacity).collect())

    assert left(range(5), 31) == list(range(30))  # below capacity nothing moves
    assert left(range(10, 30), 30) == list(range(10, 30))  # orphans are enough
    assert left(range(30), 30) == list(range(3, 30))  # the oldest tenth goes
    vectors = spark.createDataFrame([(i,) for i in range(5)], "entry_id long")
    assert rc.orphans(index, vectors).count() == 25


def test_pipeline_stages(spark):
    chunks = spark.createDataFrame(
        [("s.pdf::page_1::chunk_0", "dir/s.pdf", 1, "tech", "revenue of acme grew in spring"),
         ("s.pdf::page_2::chunk_0", "dir/s.pdf", 2, None, "acme opened a plant"),
         ("t.csv::row_0", None, None, None, "weather was mild"),
         ("u::0", "u", 1, None, "spring harvest report")],
        "chunk_id string, source string, page int, industry string, content string",
    )
    cache = cache_of(spark, [(1, "cached question", ["t.csv::row_0", "u::0"], 0, 120)])
    q = spark.createDataFrame(
        [(1, "acme revenue grew"), (2, "  "), (3, None), (4, "Cached Question"), (5, "zzz qqq")], "query_id long, query string"
    )
    rows = knowledge_query(q, chunks, cache=cache, now=now()).collect()
    by = {i: sorted((r for r in rows if r.query_id == i), key=lambda r: r["rank"] or 0) for i in range(1, 6)}
    top = by[1][0]
    assert top.stage == "dual_retrieve + rerank" and top.content == "[来源：dir/s.pdf  第 1 页]\nrevenue of acme grew in spring"
    assert (top.source, top.page, top.industry, top.has_relevant_content) == ("dir/s.pdf", 1, "tech", True)
    assert top.retrieved_count == len(by[1]) <= 3 and top.candidates_count >= top.retrieved_count
    for i in (2, 3):
        assert [(r.stage, r.rank, r.has_relevant_content) for r in by[i]] == [("BAD_INPUT", None, False)]
    assert [(r.stage, r["rank"], r.source, r.page) for r in by[4]] == [
        ("semantic_cache_hit", 1, "unknown", -1), ("semantic_cache_hit", 2, "u", 1)
    ]
    assert [(r.has_relevant_content, r.retrieved_count) for r in by[5]] == [(False, 0)]


def test_empty_corpus(spark):
    chunks = spark.createDataFrame([], "chunk_id string, source string, page int, industry string, content string")
    q = spark.createDataFrame([(1, "anything")], "query_id long, query string")
    assert [r.stage for r in knowledge_query(q, chunks).collect()] == ["dual_retrieve_empty"]
