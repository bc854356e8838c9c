"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import spelling
from tests.llm.conftest import SCHEMA


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows, every=199):
    count = Counter()
    for doc, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def brute_variants(count, ratio=5):
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        if best and count[best] >= ratio * count[w]:
            form[w] = best
    def last(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), last(w), n, len(near[w]), count[form[w]] if w in form else None) for w, n in count.items()}


def invented(seed, n=400):
    """Words with many neighbours: short alphabets, slips at every place, accents, halves that many words share."""
    rng = random.Random(seed)
    words = {}
    for _ in range(n):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
        words[w] = rng.choice([5, 6, 30, 200, 1000])
        cut = rng.randrange(len(w))
        for v in (w[:cut] + w[cut + 1 :], w[:cut] + "ÿ" + w[cut:], w[:cut] + "z" + w[cut + 1 :]):
            if len(v) >= 6:
                words.setdefault(v, rng.choice([5, 7, 900]))
    words |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625, "baaaaaaaa": 3125, "longest" + "s" * 60: 8, "longest" + "s" * 61: 9}
    return words


@pytest.mark.parametrize("most", [16, 1 << 13])
def test_variants_equal_all_pairs(spark, most):
    words = invented(3)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = spelling.variants(df, most=most).collect()
    assert len(got) == len(words) and {tuple(r) for r in got} == brute_variants(words)
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in spelling.near_words(df, most).collect()]
    assert len(pairs) == len(set(pairs))


def test_sorted_lists_find_each_pair_of_one_edit():
    rng = random.Random(8)
    for _ in range(20):
        lists = [sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(20)}) for _ in range(3)]
        rest = [w for words in lists for w in words]
        first = np.cumsum([0, *map(len, lists)])[:-1]
        q, row = spelling.near_in_lists(rest, first, np.arange(len(rest)))
        assert len(spelling.near_in_lists(rest, first, np.zeros(0, np.int64))[0]) == 0
        home = np.searchsorted(first, np.arange(len(rest)), "right")
        want = {(a, b) for a in range(len(rest)) for b in range(len(rest)) if home[a] == home[b] and one_edit(rest[a], rest[b])}
        assert sorted(zip(q.tolist(), row.tolist())) == sorted(want)


def test_counts_and_odd_rows(spark, no_docs):
    rng = random.Random(6)
    names = [w for w in invented(5, 60)]
    rows = [(i, " ".join(rng.choice(names).title() if rng.random() < 0.2 else rng.choice(names) for _ in range(60))) for i in range(80)]
    rows += rows[:3] + [(None, "aaaaaab " * 5000), (90, None), (91, ""), (92, "×÷÷÷÷×" * 3 + " ÀÀÀÀÀÀ" * 6 + " \U0001f600 東京 日本"), (93, "bbbbbb\x00bbbbbb " * 5)]
    docs = spark.createDataFrame([(*r, None, None, None, 1, "k", 2, 3, "h", 4, 0.5) for r in rows], SCHEMA)
    for every in (199, 2):
        want = brute_counts(rows, every)
        assert dict(map(tuple, spelling.word_counts(docs, every=every).collect())) == want
        assert {tuple(r) for r in spelling.variants(spelling.word_counts(docs, every=every)).collect()} == brute_variants(want)
    assert spelling.variants(spelling.word_counts(no_docs, every=199)).count() == 0
