"""Toxicity, quality, language-model scores and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import kneser, scoring, toxicity
from tests.llm.conftest import edge_rows, prose
from tests.conftest import DATA

ROWS = [(r[0], r[1] or "") for r in edge_rows()]


def test_toxicity_finds_held_out_documents(spark):
    rng = random.Random(7)
    bad = ["blargh", "snorfle", "grimbly", "vexatious", "muckrake"]
    docs, labels = [], []
    for i in range(1200):
        words = prose(rng, rng.randint(30, 120)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    out = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == 1200
    right = total = 0
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["held_out"]:
            total += 1
            right += r["predicted"] == (r["doc_id"] % 6 == 0)
    assert right / total > 0.95


def test_toxicity_edges(spark, edge_docs, null_id_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (1, None, 0), (2, 1, None), (None, 1, 1), (999, 1, 0), (4, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(no_docs, odd).count() == 0
    for labels in (none, odd):
        out = toxicity.toxicity(null_id_docs, labels).collect()
        assert Counter(r["doc_id"] for r in out) == Counter([*[d for d, _ in ROWS], None])
        assert all(0 <= r["score"] <= 1 for r in out) and next(r for r in out if r["doc_id"] is None)["held_out"]


def test_kneser_ney_sums_to_one_and_equals_the_tables(spark):
    texts = spark.createDataFrame([(t,) for _, t in ROWS], "text string")
    alphabet, model = kneser.fit(texts)
    p = 10.0 ** kneser.Model(model.seen, model.weight).dense().reshape(-1, kneser.SYMBOLS).astype(float)
    assert np.abs(p.sum(axis=1) - 1).max() < 1e-3
    counts = Counter()
    code = {c: i + 1 for i, c in enumerate(alphabet)}
    for _, t in ROWS:
        x = [code.get(c, 0) for c in kneser.LEAD + t]
        counts.update(tuple(x[i : i + 4]) for i in range(len(x) - 3))
    levels = [counts]
    for _ in range(3):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    probability, discounts = {(): 1 / kneser.SYMBOLS}, []
    for level in levels:
        n = [sum(c == i for c in level.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
        discounts = [0, *[min(i, max(0, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] else 0 for i in (1, 2, 3)]]
        total, mass = Counter(), Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            mass[g[:-1]] += discounts[min(c, 3)]
        probability |= {g: (c - discounts[min(c, 3)]) / total[g[:-1]] + mass[g[:-1]] / total[g[:-1]] * probability[g[1:]] for g, c in level.items()}
    for k, (grams, values) in enumerate(model.seen):
        assert len(grams) == len(levels[k])
        for g, v in list(zip(grams.tolist(), values.tolist()))[::7]:
            key = tuple(g // 64**i % 64 for i in range(k, -1, -1))
            assert v == pytest.approx(probability[key])


def test_quality_rejects_junk_and_keeps_prose(spark, no_docs):
    rng = random.Random(8)
    docs = [(i, prose(rng, rng.randint(2, 150)), ["en", "de", None][i % 3]) for i in range(400)]
    docs += [(1000 + i, " ".join(w + "%%%" for w in prose(rng, 80).split()), "en") for i in range(20)]
    docs += [(2000 + i, " ".join(f"{w}!!" for w in prose(rng, 80).upper().split()), "de") for i in range(20)]
    docs += [(3000, "", "en"), (3001, None, None), (None, "the river", "en")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 400, 2)] + [(1000, 0, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in kneser.quality(table, labels).collect()}
    assert len(out) == len(docs)
    assert not any(out[i + d]["kept"] for i in range(20) for d in (1000, 2000))
    assert sum(out[i]["kept"] for i in range(400)) >= 396
    assert out[3000]["kept"] and out[3000]["perplexity"] == 1 and out[3001]["kept"]
    assert kneser.quality(no_docs, labels).count() == 0
    assert kneser.quality(table, labels.limit(0)).filter("not kept").count() == 0


def brute_scores(rows):
    """Unigram and pair model of the training rows by dictionaries."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
    train = [lower(t) + ["$"] for d, t in rows if zlib.crc32(str(d).encode()) % 10]
    c, pairs = Counter(), Counter()
    for w in train:
        c.update(w)
        pairs.update(zip(["^", *w], w))
    n, v, once = sum(c.values()), len(c), sum(x == 1 for x in c.values())
    d1 = once / v
    kept = {p: x for p, x in pairs.items() if x >= 2}
    two, three = (sum(x == k for x in kept.values()) for k in (2, 3))
    d2 = two / (two + 2 * three)
    total = Counter(c) + Counter({"^": len(train)})
    back = {}
    for (a, _), x in kept.items():
        back[a] = back.get(a, 1.0) - (x - d2) / total[a]
    one = lambda w: (c[w] - d1) / n if c[w] else d1 * v / n
    two_ = lambda a, w: ((kept[a, w] - d2) / total[a] if (a, w) in kept else 0) + back.get(a, 1.0) * one(w)
    known = [*c, "unknown"]
    for a in ["^", *list(back)[:5]]:
        assert sum(two_(a, w) for w in known) == pytest.approx(1)
    out = Counter()
    for d, t in rows:
        w = lower(t) + ["$"]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = sum(math.log10(two_(a, x)) for a, x in zip(["^", *w], w))
        out[(d, zlib.crc32(str(d).encode()) % 10 == 0, len(w), sum(c[x] > 0 for x in w), n, round(base, 6), round(score, 6))] += 1
    return out


def test_scores_equal_brute_force(edge_docs):
    got = Counter((*r[:5], round(r[5], 6), round(r[6], 6)) for r in scoring.log_probabilities(edge_docs, cutoff=2).collect())
    assert got == brute_scores(ROWS)


def test_scores_of_nothing(no_docs, null_id_docs):
    assert scoring.log_probabilities(no_docs).count() == 0
    assert scoring.log_probabilities(null_id_docs).filter("doc_id is null and held_out").count() == 1
    only = null_id_docs.filter("doc_id is null")
    r = scoring.log_probabilities(only).first()
    assert r["score"] == r["base_score"] and r["train_tokens"] == 0 and r["n_tokens"] == 7


def test_pipeline_stages(spark):
    import corpus_pipeline
    from shelfmark.functions.session import materialize
    from tests.llm.test_copies import brute_groups

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (docs, docs := materialize(stage(spark, docs, DATA), "stage"))
    columns = spark.read.parquet(f"{DATA}/documents.parquet").columns
    assert all(after.columns == columns for _, after in list(out.values())[:-1])
    before, after = out["MinHash near-dedup"]
    groups = brute_groups([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    assert {r["doc_id"] for r in after.collect()} == {d for d, _, label, _ in groups if d == label}
    before, after = out["mixing sources"]
    assert after.select("doc_id").distinct().count() <= before.count() <= 1.6 * after.count()
    before, after = out["sharding"]
    assert sorted(r[0] for r in before.select("doc_id").collect()) == sorted(r[0] for r in after.select("doc_id").collect())
    assert corpus_pipeline.run(spark, DATA).count() == after.count()


def test_pipeline_stages_of_odd_rows(spark, null_id_docs, no_docs):
    import corpus_pipeline

    for docs in (no_docs, null_id_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            assert (out.count() == 0) == (docs is no_docs)
            if out.columns == docs.columns:
                assert out.filter(F.col("doc_id").isNull()).count() == docs.filter("doc_id is null").count()


def test_registered_queries_have_every_operator():
    from shelfmark.llm import queries

    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 11)] == [1] * 10
