"""Exact search and greedy removal against brute force, in one cell and in many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import nearest
from shelfmark.operators.embedding import embed
from shelfmark.operators.nearest import semantic_dedup, vector_topk


def clustered(rng, n, d=8, centres=5, spread=0.15):
    c = rng.normal(size=(centres, d))
    v = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def brute(queries, corpus, k, exclude_self):
    out = set()
    sims = np.floor(queries @ corpus.T * 1e6 + 0.5) / 1e6
    for q in range(len(queries)):
        order = sorted((i for i in range(len(corpus)) if not (exclude_self and i == q)), key=lambda i: (-sims[q, i], i))
        out |= {(q, i, r + 1) for r, i in enumerate(order[:k])}
    return out


@pytest.mark.parametrize("questions", [7, 2048])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_topk_is_exact(spark, monkeypatch, questions, exclude_self):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "QUESTIONS", questions)
    rng = np.random.default_rng(3)
    v = clustered(rng, 90)
    v[40:70] = v[7]  # a third of the rows are copies of one vector
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    corpus = spark.createDataFrame(rows, "chunk_id long, vec array<double>")
    got = vector_topk(corpus.withColumnRenamed("chunk_id", "query_id"), corpus, k=4, exclude_self=exclude_self)
    assert {(r.query_id, r.chunk_id, r.rank) for r in got.collect()} == brute(v, v, 4, exclude_self)


def greedy(v, threshold):
    kept = []
    for i in range(len(v)):
        if not kept or (v[i] @ v[kept].T).max() < threshold:
            kept.append(i)
    return set(kept)


@pytest.mark.parametrize("cells,batch", [(1, 1000), (1, 7), (5, 9)])
def test_greedy_dedup_equals_sequential(spark, monkeypatch, cells, batch):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    rng = np.random.default_rng(5)
    v = clustered(rng, 120, spread=0.25)
    v[30:60] = v[3]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    df = spark.createDataFrame(rows, "ord long, vec array<double>")
    got = semantic_dedup(df, 0.92, cells=cells, batch=batch)
    assert {r.ord for r in got.collect()} == greedy(v, 0.92)


def test_documents_equal_sequential(spark, tables):
    rows = embed(tables.chunks, "content").select(F.col("doc_id").alias("ord"), "vec")
    local = rows.orderBy("ord").collect()
    want = greedy(np.stack([np.array(r.vec) for r in local]), 0.92)
    assert {r.ord for r in semantic_dedup(rows).collect()} == {local[i].ord for i in want}
