"""BM25 against a direct computation."""

import math
from collections import Counter

from shelfmark.operators.fusion import coverage_scores, rerank_fallback, rerank_topk, rrf_fuse
from shelfmark.operators.lexical import bm25_topk

DOCS = {
    "a": "the cat sat on the mat the end",
    "b": "the dog sat",
    "c": "the cat and the dog",
    "d": "",
    "e": "the the the the",
    "f": "birds fly",
}
QUERIES = {1: "cat dog", 2: "the the", 3: "nothing here", 4: "  ", 5: "sat sat cat"}


def direct(docs, query, k):
    terms = {d: t.split() for d, t in docs.items()}
    n, avg = len(docs), sum(map(len, terms.values())) / len(docs)
    df = Counter(w for t in terms.values() for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    out = []
    for d, t in terms.items():
        tf = Counter(t)
        if not set(query.split()) & set(t):
            continue
        s = sum(idf.get(q, 0) * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for q in query.split())
        out.append((-round(s, 6), d))
    return [d for _, d in sorted(out)[:k]]


def frames(spark):
    chunks = spark.createDataFrame(list(DOCS.items()), "chunk_id string, content string")
    queries = spark.createDataFrame(list(QUERIES.items()), "query_id long, query string")
    return queries, chunks


def test_order_equals_direct_computation(spark):
    queries, chunks = frames(spark)
    rows = bm25_topk(queries, chunks, k=3).collect()
    for q, text in QUERIES.items():
        got = [r.chunk_id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])]
        assert got == direct(DOCS, text, 3)


def test_unbounded_queries_take_the_shuffle_path(spark, monkeypatch):
    queries, chunks = frames(spark)
    want = sorted(map(tuple, bm25_topk(queries, chunks).collect()))
    from shelfmark.functions import sizing

    monkeypatch.setattr(sizing, "is_bounded", lambda *a, **k: False)
    assert sorted(map(tuple, bm25_topk(queries, chunks).collect())) == want


def ranks(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id string, rank int")


def test_fusion_sums_shares_and_breaks_ties_by_first_list(spark):
    fused = rrf_fuse(ranks(spark, [(1, "x", 1), (1, "y", 2)]), ranks(spark, [(1, "z", 1), (1, "y", 2)])).collect()
    order = [r.chunk_id for r in sorted(fused, key=lambda r: r["rank"])]
    assert order == ["y", "x", "z"]
    assert {r.chunk_id: r.score for r in fused}["y"] == round(2 / 62, 9)


def test_fusion_with_one_or_an_empty_list(spark):
    one = ranks(spark, [(1, "x", 1), (1, "y", 2)])
    assert [r.chunk_id for r in rrf_fuse(None, one).orderBy("rank").collect()] == ["x", "y"]
    empty = ranks(spark, [])
    assert rrf_fuse(one, empty).count() == 2 and rrf_fuse(empty, empty).count() == 0


def test_rerank_threshold_is_strict_and_falls_back(spark):
    rows = [(1, "a", 0.1, 1), (1, "b", 0.11, 2), (1, "c", 0.5, 3), (1, "d", 0.5, 4), (1, "e", 0.2, 5), (2, "a", 0.1, 1), (2, "b", 0.0, 2)]
    scored = spark.createDataFrame(rows, "query_id long, chunk_id string, score double, rank int")
    kept = rerank_topk(scored)
    assert [(r.query_id, r.chunk_id, r.top_score) for r in kept.orderBy("query_id", "rank").collect()] == [
        (1, "c", 0.5), (1, "d", 0.5), (1, "e", 0.5)
    ]
    both = rerank_fallback(kept, scored, top_n=5).filter("query_id = 2").orderBy("rank").collect()
    assert [(r.chunk_id, r.fallback) for r in both] == [("a", True), ("b", True)]
    assert rerank_topk(scored, top_n=99).count() == 4 and rerank_topk(scored, top_n=0).count() == 1


def test_coverage_is_between_zero_and_one(spark):
    queries, chunks = frames(spark)
    pairs = ranks(spark, [(1, "c", 1), (1, "f", 2), (4, "a", 1)])
    got = {(r.query_id, r.chunk_id): r.score for r in coverage_scores(pairs, queries, chunks).collect()}
    assert got == {(1, "c"): 1.0, (1, "f"): 0.0, (4, "a"): 0.0}
