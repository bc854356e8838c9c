"""Every match of a short item is found, at the full tolerance; longer ones mostly."""

import random

import pytest

from shelfmark.llm import decontam
from tests.llm.conftest import prose
from tests.llm.test_copies import brute_distance


def edited(rng, words, edits):
    """``words`` after exactly ``edits`` insertions, deletions or replacements at different places."""
    out = list(words)
    for at in sorted(rng.sample(range(len(words)), edits), reverse=True):
        kind = rng.choice("idr")
        out[at : at + 1] = [f"n{rng.randrange(10**6)}", out[at]] if kind == "i" else [] if kind == "d" else [f"n{rng.randrange(10**6)}"]
    return out


@pytest.mark.parametrize("sizes, least", [(range(1, 15), 1.0), (range(15, 61, 5), 0.95)])
def test_recall_at_the_full_tolerance(spark, sizes, least):
    rng = random.Random(sizes[0])
    # words of the items stand in no other text, so that what is found is what was planted
    items = [(100 * n + k, [f"w{n}x{k}x{i % max(3, n - 2)}" for i in range(n)]) for n in sizes for k in range(30)]
    docs, want = [], set()
    for i, (item, words) in enumerate(items):
        planted = edited(rng, words, int(0.2 * len(words)))
        if brute_distance(words, planted) <= int(0.2 * len(words)):
            docs.append((i, f"{prose(rng, 30)} {' '.join(planted)} {prose(rng, 30)}"))
            want.add((i, item))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), table, least_words=1).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert pairs <= want and len(pairs) >= least * len(want)


def test_short_items_are_left_out_by_default_and_texts_may_be_empty(spark):
    items = spark.createDataFrame([(1, "one two three"), (2, "alpha beta gamma delta epsilon zeta eta theta"), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so one two three it is"), (2, "x alpha beta gamma delta zeta eta theta"), (3, ""), (4, None), (5, "three")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.leaks(docs, items).collect()] == [(2, 2, 1)]
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items, least_words=1).collect()}
    assert found == {(1, 1), (2, 2)}
    assert {r["doc_id"] for r in decontam.without_leaks(docs, items, least_words=1).collect()} == {3, 4, 5}
