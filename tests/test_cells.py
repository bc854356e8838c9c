"""The cell join against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import cells, nearest
from shelfmark.operators.cells import Cells, cell_topk


def clustered(n, centres=12, dim=8, seed=1, spread=0.08):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    v = middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def table(spark, vectors, name, start=0):
    return spark.createDataFrame([(start + i, v.tolist()) for i, v in enumerate(vectors)], f"{name} long, vec array<double>").repartition(4)


def brute(queries, corpus, k, exclude_self=False):
    scores = np.floor(queries @ corpus.T * 1e6 + 0.5) / 1e6
    out = set()
    for q, row in enumerate(scores):
        order = [c for c in np.lexsort((np.arange(len(corpus)), -row)) if not (exclude_self and c == q)][:k]
        out |= {(q, int(c), float(row[c]), r + 1) for r, c in enumerate(order)}
    return out


@pytest.mark.parametrize("pivots, slice_rows", [(1, 50), (20, 30), (None, 4096)])
def test_equals_all_pairs(spark, pivots, slice_rows):
    corpus, asked = clustered(600), clustered(90, seed=2)
    asked[:5] = corpus[:5]
    got = cell_topk(table(spark, asked, "query_id"), table(spark, corpus, "chunk_id"), 7, pivots=pivots, slice_rows=slice_rows)
    assert {tuple(r) for r in got.collect()} == brute(asked, corpus, 7)


def test_copies_ties_and_self(spark, monkeypatch):
    monkeypatch.setattr(cells, "ASKED", 16)  # a slice that many ask goes to several tasks
    corpus = np.concatenate([np.repeat(clustered(1), 150, axis=0), clustered(50, seed=3)])
    df = table(spark, corpus, "chunk_id")
    got = cell_topk(df.withColumnRenamed("chunk_id", "query_id"), df, 4, exclude_self=True, pivots=5, slice_rows=20)
    assert {tuple(r) for r in got.collect()} == brute(corpus, corpus, 4, exclude_self=True)


def test_few_rows_nulls_and_nothing(spark):
    corpus, asked = clustered(3), clustered(2, seed=2)
    df, q = table(spark, corpus, "chunk_id"), table(spark, asked, "query_id")
    none = spark.createDataFrame([(99, None)], "chunk_id long, vec array<double>")
    assert {tuple(r) for r in cell_topk(q, df.union(none), 10, pivots=2).collect()} == brute(asked, corpus, 10)
    assert cell_topk(q, none).count() == 0 and cell_topk(q.limit(0), df).count() == 0


def test_most_pairs_of_clustered_data_are_never_compared(spark):
    corpus, asked = clustered(4000, centres=30, dim=16), clustered(200, centres=30, dim=16)
    made = Cells(table(spark, corpus, "chunk_id"), pivots=64, slice_rows=64)
    q = table(spark, asked, "query_id")
    least = spark.createDataFrame([(i, s) for i, _, s, r in brute(asked, corpus, 10) if r == 10], "query_id long, least double")
    pairs = made.possible_slices(q.join(least, "query_id")).agg(F.sum("rows")).first()[0]
    assert pairs < len(corpus) * len(asked) / 3
    got = cell_topk(q, table(spark, corpus, "chunk_id"), 10, pivots=64, slice_rows=64)
    assert {tuple(r) for r in got.collect()} == brute(asked, corpus, 10)


def test_many_questions_go_to_the_cell_join(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUESTIONS", 20)
    corpus, asked = clustered(100), clustered(50, seed=2)
    got = nearest.vector_topk(table(spark, asked, "query_id"), table(spark, corpus, "chunk_id"), 3)
    assert {tuple(r) for r in got.collect()} == brute(asked, corpus, 3)


@pytest.mark.parametrize("scores", [50, 1 << 22])
def test_slices_travel_together(spark, monkeypatch, scores):
    monkeypatch.setattr(cells, "SCORES", scores)
    corpus = np.random.default_rng(4).normal(size=(900, 6))
    corpus = np.round(corpus / np.linalg.norm(corpus, axis=1, keepdims=True), 2)
    corpus /= np.linalg.norm(corpus, axis=1, keepdims=True)
    df = table(spark, corpus, "chunk_id")
    made = Cells(df, pivots=3, slice_rows=16)
    assert made.slices.count() > 40 and made.slices.select("cell", "region").distinct().count() == 3
    got = cell_topk(df.withColumnRenamed("chunk_id", "query_id"), df, 5, exclude_self=True, pivots=3, slice_rows=16)
    assert {tuple(r) for r in got.collect()} == brute(corpus, corpus, 5, exclude_self=True)


def test_best_that_reach_a_score():
    raw = np.array([[0.5, 0.9, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2], [0.3, 0.1, 0.0, 0.2]])
    q, m, scores = cells.best_reaching(raw, np.array([0.4, -np.inf, 0.9]), 2)
    assert list(zip(q, m, scores)) == [(0, 1, 0.9), (0, 0, 0.5), (1, 0, 0.2), (1, 1, 0.2)]
    many = np.tile(np.linspace(0, 1, 101), (3, 1))
    assert [list(cells.best_reaching(many, np.full(3, -np.inf), 2)[i]) for i in (0, 1)] == [[0, 0, 1, 1, 2, 2], [100, 99] * 3]


def test_a_repeated_id_costs_no_neighbour(spark):
    corpus = clustered(120, centres=3)
    ids = [*range(100), *range(20)]
    rows = [(i, corpus[i].tolist()) for i in ids]
    df = spark.createDataFrame(rows, "chunk_id long, vec array<double>")
    got = cell_topk(df.withColumnRenamed("chunk_id", "query_id"), df, 6, exclude_self=True, pivots=2, slice_rows=10)
    want = set()
    for q in set(ids):
        pairs = sorted((-float(np.floor(corpus[q] @ corpus[c] * 1e6 + 0.5) / 1e6), c) for c in ids for _ in range(ids.count(q)) if c != q)
        want |= {(q, c, -s, r + 1) for r, (s, c) in enumerate(pairs[:6])}
    assert {tuple(r) for r in got.collect()} == want
