"""Large rule tables against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import patterns
from shelfmark.functions.patterns import Automaton, first_rule, mentions


@pytest.fixture(params=[True, False])
def library(request, monkeypatch):
    """With the automaton's library and without it."""
    if not request.param:
        build = Automaton.__init__

        def plain(self, words):
            build(self, words)
            self.trie = None

        monkeypatch.setattr(Automaton, "__init__", plain)
    return request.param


def words(n, seed):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice("abcö芯") for _ in range(rng.randint(2, 7))) for _ in range(n)})


def test_occurrences_overlap(library):
    text = "aababaöab"
    found = sorted(Automaton(["ab", "aba", "b", "öab", "zz"]).occurrences(text))
    want = sorted((i + len(p) - 1, n) for n, p in enumerate(["ab", "aba", "b", "öab", "zz"]) for i in range(len(text)) if text.startswith(p, i))
    assert found == want and list(Automaton([]).occurrences(text)) == []


@pytest.mark.parametrize("at_once", [200_000, 3000])
def test_ten_thousand_rules(spark, monkeypatch, at_once):
    monkeypatch.setattr(patterns, "MAX_PATTERNS", at_once)
    rng = random.Random(2)
    table = [(w, f"c{rng.randrange(9)}", rng.randrange(500)) for w in words(40000, 3)]
    assert len(table) > 10_000
    texts = [(i, "".join(rng.choice("abcö芯 ") for _ in range(60))) for i in range(60)] + [(90, ""), (91, None), (92, "zzz")]
    rules = spark.createDataFrame([*table, ("", "empty", 0)], "pattern string, category string, priority int")
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    tagged = dict(map(tuple, docs.select("doc_id", first_rule(F.col("text"), rules)).collect()))
    assert tagged == {i: min(((p, c) for w, c, p in table if w in (t or "")), default=(0, None))[1] for i, t in texts}
    found = {(r.doc_id, r.pattern): (r.at, r.n) for r in mentions(docs, rules).collect()}
    assert found == {
        (i, w): (t.index(w) + 1, sum(t.startswith(w, k) for k in range(len(t)))) for i, t in texts if t for w, _, _ in table if w in t
    }


def test_repeated_patterns_and_no_rules(spark):
    docs = spark.createDataFrame([(1, "a chip")], "doc_id int, text string")
    rules = spark.createDataFrame([("chip", "late", 5), ("chip", "early", 2), ("a", "mid", 3)], "pattern string, category string, priority int")
    assert docs.select(first_rule(F.col("text"), rules)).first()[0] == "early"
    assert docs.select(first_rule(F.col("text"), rules.limit(0))).first()[0] is None
    assert mentions(docs, rules.limit(0)).count() == 0
