"""The bound that rules pairs out never costs a link, and leaves few pairs of a hot group."""

import random

import pytest

from shelfmark.llm import neardup
from tests.llm.conftest import prose
from tests.llm.test_copies import brute_groups


def hot_group(seed, n=260, words=120):
    """Copies of one text with so many words replaced that most pairs just miss the similarity, chains between them and copies of copies."""
    rng = random.Random(seed)
    base = prose(rng, words).split()
    rows = []
    for i in range(n):
        w = list(rng.choice(rows)[1].split() if rows and rng.random() < 0.15 else base)
        for _ in range(rng.randint(1, 2) if rows and rng.random() < 0.15 else rng.randint(4, 9)):
            w[rng.randrange(len(w))] = rng.choice([f"x{rng.randrange(10**6)}", "common", rng.choice(base)])
        rows.append((i, " ".join(w)))
    return rows + [(1000 + i, prose(rng, 40)) for i in range(20)]


@pytest.mark.parametrize("bitmap, k", [(64, 2), (1, 2), (64, 5)])
def test_groups_of_a_hot_group_equal_all_pairs(spark, monkeypatch, bitmap, k):
    monkeypatch.setattr(neardup, "BITMAP", bitmap)
    compared = []
    written = neardup.materialize

    def count(df, purpose):
        table = written(df, purpose)
        if purpose == "pairs":
            compared.append(table.count())
        return table

    monkeypatch.setattr(neardup, "materialize", count)
    rows = hot_group(k)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()
    assert {tuple(r) for r in got} == brute_groups(rows, k, 80)
    if bitmap == 64:
        assert compared[-1] < 260  # pairs across groups, of 33,670 pairs of the group
