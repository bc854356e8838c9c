"""Greedy removal compares a pair once, whatever the number of cells, and decides chains and crowds."""

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.operators import nearest
from shelfmark.operators.nearest import semantic_dedup
from tests.test_nearest import clustered, greedy


def frame(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "ord long, vec array<double>")


def kept(df, **how):
    return {r.ord for r in semantic_dedup(df, 0.92, **how).collect()}


def test_rows_meet_once_per_pair_of_cells(spark, monkeypatch):
    seen, whole = spark.sparkContext.accumulator(0), nearest.earlier_neighbours

    def counted(rows, others, *args):
        seen.add(rows.num_rows * others.num_rows)
        return whole(rows, others, *args)

    monkeypatch.setattr(nearest, "earlier_neighbours", counted)
    v = clustered(np.random.default_rng(8), 400, d=16, centres=400)
    assert kept(frame(spark, v), cells=8) == greedy(v, 0.92)
    # of all pairs of cells those in order, so little more than half of the pairs; cells around pivots held most rows many times
    assert 0 < seen.value < 0.7 * 400 * 400


@pytest.mark.parametrize("links", [1, 16])
def test_chains_and_crowds(spark, monkeypatch, links):
    monkeypatch.setattr(nearest, "LINKS", links)
    rng = np.random.default_rng(9)
    turn = np.arange(60) * 0.25  # each row is near the one before and the one after only
    chain = np.stack([np.cos(turn), np.sin(turn), np.zeros(60)], axis=1)
    crowd = np.array([0.0, 0.0, 1.0]) + 0.2 * rng.normal(size=(80, 3))
    v = rng.permutation(np.concatenate([chain, crowd / np.linalg.norm(crowd, axis=1, keepdims=True)]))
    assert kept(frame(spark, v), cells=4, batch=20) == greedy(v, 0.92)


def test_named_neighbours_are_the_first(monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 3)
    one = [1.0, 0.0]
    rows = pa.table({"ord": [5, 6, 7, 8], "vec": [one, [0.0, 1.0], one, one]})
    others = pa.table({"ord": list(range(8)), "vec": [one, [0.0, 1.0]] * 4})
    i, j, more = nearest.earlier_neighbours(rows, others, 0.9, 3)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 2), (0, 4), (1, 1), (1, 3), (1, 5), (2, 0), (2, 2), (2, 4), (3, 0), (3, 2), (3, 4)]
    assert more.tolist() == [2, 3]
