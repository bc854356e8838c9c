"""Every character of trusted text is a symbol of the model of op4, whether the model travels or not."""

import math
import random
from collections import Counter

import pytest

from shelfmark.llm import kneser

ODD = [chr(c) for c in range(0x100, 0x180)]
TRUSTED = [" ".join(random.Random(i).choices(ODD, k=40)) + " the river" * (i % 3) for i in range(30)]
OTHERS = ["", "the river", "\u4e00 the \U0001f600", ODD[3] * 50, " ".join(ODD), None]


def brute(texts, asked):
    """log10 probabilities by dictionaries of characters."""
    known = {c for t in texts for c in t}
    x = lambda t: tuple(c if c in known else None for c in kneser.LEAD + t)
    levels = [Counter(x(t)[i : i + 4] for t in texts for i in range(len(t)))]
    for _ in range(3):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    p, weight = [], []
    for k, level in enumerate(levels):
        n = [sum(c == i for c in level.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
        cut = [0, *[min(i, max(0, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] else 0 for i in (1, 2, 3)]]
        total, mass = Counter(), Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            mass[g[:-1]] += cut[min(c, 3)]
        weight.append({g: mass[g] / total[g] for g in total})
        below = (lambda g: p[-1][g[1:]]) if k else (lambda g: 1 / (1 + len(known)))
        p.append({g: (c - cut[min(c, 3)]) / total[g[:-1]] + weight[k][g[:-1]] * below(g) for g, c in level.items()})

    def of(g):
        if not g:
            return 1 / (1 + len(known))
        k = len(g) - 1
        return p[k][g] if g in p[k] else weight[k].get(g[:-1], 1.0) * of(g[1:])

    return [sum(math.log10(max(kneser.LEAST, of(x(t or "")[i : i + 4]))) for i in range(len(t or ""))) for t in asked]


@pytest.mark.parametrize("most", [kneser.MODEL, 0])
def test_every_character_counts(spark, monkeypatch, most):
    monkeypatch.setattr(kneser, "MODEL", most)  # whether the model travels or is joined
    asked = TRUSTED + OTHERS
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(asked)] + [(0, TRUSTED[0], "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(len(TRUSTED))], "doc_id long, quality int")
    rows = kneser.quality(docs.filter("doc_id > 0").unionByName(docs.filter("doc_id = 0")), labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter([0, *range(len(asked))])
    want = brute([*TRUSTED, TRUSTED[0]], asked)
    for r in rows:
        assert r["log_prob"] == pytest.approx(want[r["doc_id"]], rel=1e-9), asked[r["doc_id"]]
        assert r["n_symbols"] == len(asked[r["doc_id"]] or "")


def test_rare_characters_take_two_symbols(monkeypatch):
    monkeypatch.setattr(kneser, "SINGLE", 10)
    monkeypatch.setattr(kneser, "TRAILS", 4)
    alphabet = ["\n", *ODD]
    table, base = kneser.symbol_table(alphabet), kneser.base_of(alphabet)
    texts = [ODD[0] + ODD[50] + ODD[1], "", ODD[51], "?" + ODD[-1]]
    symbols, first = kneser.symbols_of(texts, table, kneser.LEAD)
    assert first.tolist() == [0, 7, 10, 15, 21] and symbols.max() < base
    each = {tuple(kneser.symbols_of([c], table, "")[0].tolist()) for c in alphabet}
    assert len(each) == len(alphabet) and {len(s) for s in each} == {1, 2}
    again = [kneser.symbols_of([kneser.LEAD + t], table, "")[0].tolist() for t in texts]
    assert [symbols[a:b].tolist() for a, b in zip(first, first[1:])] == again
    grams, at = kneser.grams_of(symbols, first, base)
    assert at.tolist() == [0, 4, 4, 6, 9] and grams.max() < base**kneser.ORDER


def test_codes_of_the_largest_alphabet_fit():
    assert kneser.base_of([""] * 0x110000) ** kneser.ORDER < 1 << 63
