"""Groups of rows that lie too far apart are not compared, and nothing near is lost by it."""

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.operators import nearest


def rows(vectors, ords):
    return pa.table({"ord": ords, "vec": pa.array([v.tolist() for v in vectors], pa.list_(pa.float64()))})


def brute(a, a_ords, b, b_ords, most):
    pairs, more = set(), []
    for i, x in enumerate(a):
        near = [j for j, y in enumerate(b) if b_ords[j] < a_ords[i] and (x * y).sum() >= 0.92]
        pairs |= {(i, j) for j in near[:most]}
        more += [i] * (len(near) > most)
    return pairs, more


@pytest.mark.parametrize("leaf, boxes, axes", [(256, 16, 8), (4, 2, 3), (1, 1, 12)])
def test_pairs_are_those_of_all_pairs(monkeypatch, leaf, boxes, axes):
    for name, value in (("LEAF", leaf), ("BOXES", boxes), ("AXES", axes)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 12))
    v = centres[rng.integers(0, 5, 300)] + 0.25 * rng.normal(size=(300, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7], v[8], v[9] = 0.0, np.nan, 3 * v[10]  # no direction, a missing value, not of unit length
    for at, others in ((slice(120, 300), slice(0, 200)), (slice(0, 300), slice(0, 300))):
        a, b, a_ords, b_ords = v[at], v[others], np.arange(300)[at], np.arange(300)[others]
        i, j, more = nearest.earlier_neighbours(rows(a, a_ords), rows(b, b_ords), 0.92, 3)
        want, crowded = brute(a, a_ords, b, b_ords, 3)
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want) and more.tolist() == crowded
        assert crowded


def test_far_groups_are_not_compared(monkeypatch):
    monkeypatch.setattr(nearest, "LEAF", 10)
    met, whole = [], np.concatenate

    def counted(parts, *args, **how):
        out = whole(parts, *args, **how)
        if out.ndim == 2:
            met.append(len(out))
        return out

    monkeypatch.setattr(nearest.np, "concatenate", counted)
    v = np.repeat(np.eye(4), 50, axis=0)
    nearest.earlier_neighbours(rows(v, np.arange(200)), rows(v, np.arange(200)), 0.92, 3)
    assert met and sum(met) < 0.5 * 200 * len(met)
