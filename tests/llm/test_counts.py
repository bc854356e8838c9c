"""Token counts, mixing and sharding."""

import hashlib
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import mixing, sharding, textkit, tokens
from tests.llm.conftest import edge_rows

ROWS = [(r[0], r[1] or "", r[3]) for r in edge_rows()]


def test_words_split_like_bytes():
    import pyarrow as pa

    w = textkit.words(pa.array([t for _, t, _ in ROWS]))
    assert w.counts.tolist() == [len(t.encode().split()) for _, t, _ in ROWS]
    seen = {}
    for h, a, b in zip(w.hash.tolist(), w.start, w.end):
        assert seen.setdefault(h, bytes(w.data[a:b])) == bytes(w.data[a:b])


def test_tokens_equal_the_library(edge_docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((d, len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False)), n > 1024) for d, t, _ in ROWS)
    assert Counter(map(tuple, tokens.token_counts(edge_docs, "byte_bpe_50k.json").collect())) == want


def test_empty_tables(no_docs):
    assert tokens.token_counts(no_docs, "byte_bpe_50k.json").count() == 0
    assert mixing.mix(no_docs).count() == 0
    assert sharding.shards(no_docs).count() == 0


def test_null_ids_are_rows(null_id_docs):
    for out in (tokens.token_counts(null_id_docs, "byte_bpe_50k.json"), mixing.mix(null_id_docs), sharding.shards(null_id_docs)):
        assert out.count() == len(ROWS) + 1 and out.filter("doc_id is null").count() == 1


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        stopped = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not stopped:
            return target | {s: weight[s] * level for s in free}
        target |= {s: 2.0 * sizes[s] for s in stopped}
        free -= stopped
    return target


def test_mix_reaches_targets(edge_docs):
    sizes = defaultdict(int)
    for _, t, s in ROWS:
        sizes[s] += len(t.encode().split())
    want = brute_targets(sizes)
    rows = edge_docs.select("doc_id", "source").distinct().join(mixing.mix(edge_docs), "doc_id").collect()
    assert Counter(r["doc_id"] for r in mixing.mix(edge_docs).collect()) == Counter(d for d, _, _ in ROWS)
    taken = defaultdict(int)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert taken[s] == round(t)


def test_schedule_is_spread_and_ranked(spark):
    goals = spark.createDataFrame([(0, 30_000.0, 30_000), (1, 10_000.0, 10_000), (2, 3.0, 3)], "turn int, target double, take long")
    rows = mixing.schedule(goals, 64).collect()
    for turn, take in ((0, 30_000), (1, 10_000), (2, 3)):
        own = sorted((r["rank"], r["words"]) for r in rows if r["turn"] == turn)
        assert [rank for rank, _ in own] == list(range(-(-take // 64))) and sum(n for _, n in own) == take
    early = [r["turn"] for r in rows if r["slot"] is not None and r["slot"] < 200]
    assert abs(early.count(0) / len(early) - 0.75) < 0.02


@pytest.mark.parametrize("n", [1, 3, 8])
def test_shards_are_even_and_gapless(edge_docs, n):
    rows = sharding.shards(edge_docs, n).collect()
    want = Counter((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t, _ in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for shard in range(n):
        own = [r for r in rows if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / n) <= largest + total / n * 0.02


def test_hot_text_is_cut_and_small_groups_stay(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text " * 10)).otherwise(F.md5(F.expr("id div 2").cast("string"))).alias("text"))
    rows = sharding.shards(docs, 4).collect()
    by_text = defaultdict(set)
    for r, text in ((r, "hot" if r["doc_id"] % 3 == 0 else hashlib.md5(str(r["doc_id"] // 2).encode()).hexdigest()) for r in rows):
        by_text[text].add(r["shard"])
    assert len(by_text.pop("hot")) >= 2 and all(len(s) == 1 for s in by_text.values())
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) < 400
