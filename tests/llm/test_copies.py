"""Near duplicates, repeated passages, fingerprints and benchmark leaks against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import components, decontam, fingerprints, neardup, substrings, textkit
from tests.llm.conftest import edge_rows, prose

ROWS = [(r[0], r[1] or "") for r in edge_rows()]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()


def brute_groups(rows, k, share):
    sets = {}
    for d, t in rows:
        w = lowered(t)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = {d: [] for d in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= share * len(sets[a] | sets[b]):
                links[a].append(b)
                links[b].append(a)
    label = {}
    for d in ids:  # ascending: the first to reach a document is the smallest of its group
        stack = [d] if d not in label else []
        while stack:
            x = stack.pop()
            if x not in label:
                label[x] = d
                stack += links[x]
    return {(d, len(s), label[d], d == label[d]) for d, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(edge_docs, k):
    got = neardup.near_duplicates(edge_docs, k=k).collect()
    assert set(map(tuple, got)) == brute_groups(ROWS, k, 80)
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in ROWS)


def test_near_duplicates_of_nothing(no_docs, null_id_docs):
    assert neardup.near_duplicates(no_docs).count() == 0
    lost = neardup.near_duplicates(null_id_docs).filter("doc_id is null").first()
    assert lost["component_id"] is None and lost["kept"]


def test_chain_and_hot_group_are_one_group(spark):
    rng = random.Random(1)
    words = prose(rng, 200).split()
    rows = []
    for i in range(150):  # a chain: every text drops one more word at the front and gains one at the end
        rows.append((i, " ".join([*words[i % 150 :], *[f"new{j}" for j in range(i)]])[:20000]))
    rows += [(1000 + i, " ".join([*words[:100], f"edit{i}", *words[101:]])) for i in range(150)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert {tuple(r) for r in got} == brute_groups(rows, 2, 80)


def test_superminhash_is_unbiased_and_steadier():
    rng = np.random.default_rng(3)
    for n in (1, 4, 40, 300):
        errors = []
        for _ in range(20):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = a.copy()
            b[: n // 4] = rng.integers(0, 2**63, n // 4)
            sig = neardup.superminhash(np.concatenate([a, b]), np.array([0, n, 2 * n]), 576)
            errors.append((sig[0] == sig[1]).mean() - (n - n // 4) / (n + n // 4))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) <= 0.023
    assert (neardup.superminhash(np.zeros(0, np.uint64), np.array([0, 0]), 16) == np.iinfo(np.uint64).max).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (300, 300)] + [(1000, 1000 + i) for i in range(1, 400)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()))
    assert all(got[i] == 0 for i in range(61)) and got[200] == 100 and all(got[1000 + i] == 1000 for i in range(400))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, length):
    words = [(d, t.encode().split()) for d, t in rows]
    first = {}
    for d, w in sorted(words, key=lambda x: x[0]):
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), d)
    out = Counter()
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = [x for x, g in zip(w, gone) if not g]
        out[(d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("most_units", [2, 256])
def test_repeats(edge_docs, monkeypatch, most_units):
    monkeypatch.setattr(substrings, "MOST_UNITS", most_units)
    assert Counter(map(tuple, substrings.remove_repeats(edge_docs).collect())) == brute_repeats(ROWS, 13)


def test_repeats_of_nothing(no_docs, null_id_docs):
    assert substrings.remove_repeats(no_docs).count() == 0
    assert substrings.remove_repeats(null_id_docs).filter("doc_id is null and n_removed = 0").count() == 1


def test_automaton_labels():
    rng = random.Random(2)
    for _ in range(50):
        texts = [[rng.randint(0, 2) for _ in range(rng.randint(3, 30))] for _ in range(6)]
        labels = rng.sample(range(100), 6)
        automaton = substrings.Automaton()
        for t, d in zip(texts, labels):
            automaton.add(t, d)
        automaton.close()
        for t in texts:
            want = [min(d for u, d in zip(texts, labels) if any(u[j : j + 3] == t[i : i + 3] for j in range(len(u) - 2))) for i in range(len(t) - 2)]
            assert automaton.first_labels(t, 3) == want


def test_fingerprints(edge_docs):
    got = fingerprints.fingerprints(edge_docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in ROWS)
    texts = dict(ROWS)
    ids = sorted(texts)
    by_text, errors = {}, []
    for r in got:
        t, after = texts[r["doc_id"]], texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        by_text.setdefault(t, set()).add(r["fingerprint"])
        by_text.setdefault(edited, set()).add(r["edited_fingerprint"])
        for other, value in ((edited, r["near_edited"]), (after, r["near_next"])):
            x, y = Counter(t.encode().split()), Counter(other.encode().split())
            want = sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0
            assert abs(value - want) < 0.45
            errors.append(value - want)
    assert all(len(f) == 1 for f in by_text.values())
    assert abs(np.mean(errors)) < 0.03


def test_fingerprint_collision_rate_is_weighted_jaccard(spark):
    bags = [(0, "a a a a b b c d e f"), (1, "a a b b b b c d g h")]
    texts = spark.createDataFrame(bags, "doc_id long, text string").withColumn("words", fingerprints._terms(F.col("text")))
    a, b = (r["samples"] for r in fingerprints.samples(texts, ["doc_id"], 2000).orderBy("doc_id").collect())
    x, y = (Counter(t.split()) for _, t in bags)
    want = sum((x & y).values()) / sum((x | y).values())
    assert abs(np.mean([(p & 0x7FFFFFFF) == (q & 0x7FFFFFFF) for p, q in zip(a, b)]) - want) < 0.04


def test_fingerprints_of_nothing(no_docs, null_id_docs):
    assert fingerprints.fingerprints(no_docs).count() == 0
    assert fingerprints.fingerprints(null_id_docs).filter("doc_id is null and near_next is null").count() == 1


def brute_distance(item, text):
    cost = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        row = [i + 1]
        for j, y in enumerate(text):
            row.append(min(cost[j] + (x != y), cost[j + 1] + 1, row[j] + 1))
        cost = row
    return min(cost)


def test_best_stretch_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(200):
        item, text = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 15))
        distance, a, b = decontam.best_stretch(item.astype(np.uint64), text.astype(np.uint64))
        assert distance == brute_distance(item.tolist(), text.tolist())
        assert brute_distance(item.tolist(), text[a:b].tolist()) == distance


@pytest.fixture(scope="module")
def items():
    rng = random.Random(9)
    return [(i, prose(rng, rng.randint(15, 60))) for i in range(40)]


def edit(rng, words, rate):
    out = []
    for i, w in enumerate(words):
        kind = rng.randint(0, 2) if rng.random() < rate else None
        out += [w] if kind is None else [] if kind == 0 else [f"x{i}"] if kind == 1 else [f"y{i}", w]
    return out


def test_leaks(spark, items):
    rng = random.Random(11)
    rows, want, doc = [], set(), 0
    for rate in (0.0, 0.05, 0.1):
        for i, text in items:
            rows.append((doc, f"{prose(rng, 40)} {' '.join(edit(rng, text.upper().split() if i % 2 else text.split(), rate))} {prose(rng, 40)}"))
            if brute_distance(lowered(text), lowered(rows[-1][1])) <= int(0.2 * len(text.split())):
                want.add((doc, i))
            doc += 1
    rows += [(doc + i, prose(rng, 200)) for i in range(40)] + [(doc + 50, ""), (doc + 51, None)]
    table = spark.createDataFrame([*items, (None, "nothing"), (99, None), (98, "the of")], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.leaks(docs, table).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert {(d, i) for d, i in want if d < len(items)} <= pairs
    assert len(want & pairs) >= 0.95 * len(want) and pairs <= want
    assert {r["doc_id"] for r in decontam.without_leaks(docs, table).collect()} == {d for d, _ in rows} - {d for d, _ in pairs}
    assert decontam.leaks(docs, table.limit(0)).count() == 0
    assert decontam.leaks(docs.limit(0), table).count() == 0


def test_grams_tell_order():
    a, b = (textkit.grams(textkit.words(pa.array([t])).hash, 2) for t in ("x y z", "y x z"))
    assert len(set(a.tolist()) | set(b.tolist())) == 4
