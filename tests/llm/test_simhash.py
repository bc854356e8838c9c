"""Fingerprints against Spark's own hash, groups against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import simhash
from tests.llm.conftest import edge_rows, prose


def brute_components(prints):
    label = {f: f for f in prints}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    fs = sorted(prints)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {f: find(f) for f in fs}


def brute_rows(rows):
    prints = [(d, simhash.fingerprint(t)) for d, t in rows]
    root = brute_components({f for _, f in prints})
    least = {}
    for d, f in prints:
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    return Counter((d, f"{f:016x}", least.get(root[f])) for d, f in prints)


def test_fingerprint_bits_are_majorities_of_spark_hashes(spark, edge_docs):
    shingles = edge_docs.select(
        "doc_id", F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w")
    ).filter(F.size("w") >= 4).dropDuplicates(["doc_id"])
    rows = shingles.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.xxhash64(F.concat_ws(" ", F.slice("w", i, 4))))).alias("h"))
    hashes = {}
    for d, h in rows.collect():
        hashes.setdefault(d, []).append(h % 2**64)
    texts = {r[0]: r[1] for r in edge_rows()}
    assert len(hashes) > 20
    for d, hs in hashes.items():
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert simhash.fingerprint(texts[d]) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("most", [2, 1 << 13])
def test_near_duplicates(edge_docs, null_id_docs, no_docs, most):
    got = simhash.near_duplicates(null_id_docs, most=most).collect()
    assert Counter(tuple(r) for r in got) == brute_rows([(r["doc_id"], r["text"]) for r in null_id_docs.collect()])
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("most", [40, 1 << 13])
def test_groups_of_any_shape_equal_all_pairs(spark, most):
    rng = random.Random(9)
    prints = {0, 2**64 - 1, 15, 31, 63}
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 60])):  # balls and chains
            f = centre
            for _ in range(rng.randint(0, 4)):
                f ^= 1 << rng.randrange(64)
            prints.add(f)
            if rng.random() < 0.2:
                centre = f
    signed = {f: f - 2**64 if f >> 63 else f for f in prints}
    df = spark.createDataFrame([(s,) for s in signed.values()], "f long")
    found = [(a % 2**64, b % 2**64) for a, b in simhash.links(df, most=most).collect()]
    label = {f: f for f in prints}
    for _ in range(len(prints)):
        before = dict(label)
        for a, b in found:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert label == brute_components(prints)


def test_lanes_beyond_the_radius_never_come_back():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (128, 64)).astype(np.uint8)
    for i in range(64):
        bits[64 + i] = bits[i]
        bits[64 + i, rng.choice(64, i % 9, replace=False)] ^= 1
    for radius in (1, 3, 4, 7):
        q = np.repeat(np.arange(128), 2)
        a, b = simhash.close_lanes(bits, list(range(64)), q, np.tile([0, 1], 128), radius)
        want = {(x, y) for x in range(128) for y in range(128) if (bits[x] != bits[y]).sum() <= radius}
        assert set(zip(a.tolist(), b.tolist())) == want


def test_hot_group_of_near_copies_is_one_component(spark):
    rng = random.Random(4)
    words = prose(rng, 400).split()
    rows = [(i, " ".join([*words[: i % 390], f"x{i}", *words[i % 390 + 1 :]])) for i in range(200)] + [(1000 + i, " ".join(words)) for i in range(100)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), most=30).collect()
    assert Counter(map(tuple, got)) == brute_rows(rows)
