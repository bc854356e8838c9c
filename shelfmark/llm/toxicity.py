"""Toxicity by compression distance: windows compress shorter with the dictionary of the text they resemble.

Two zstandard dictionaries come from the same labelled texts: one is trained on windows of ordinary text, one holds the
words of toxic text that cover what sets it apart (byte sequences found in many toxic and hardly any ordinary
texts), each mark once. Every window of a text is compressed with the ordinary dictionary and with the ordinary one followed by the
toxic one, so that a difference can only come from toxic matches. The lengths saved are turned into a probability by
thresholds and weights calibrated on other labelled texts.

Fitting sees at most ``2 * sample`` labelled texts; scoring is one narrow pass over all texts.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import textkit

#: Labelled texts for the dictionaries, and as many others for calibration.
SAMPLE = 8000
WINDOW, STRIDE = 8, 5
GRAMS = (5, 6, 8)
ORDINARY_BYTES, TOXIC_BYTES = 8192, 2048
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)


def _spans(texts: pa.Array) -> tuple[bytes, textkit.Words]:
    w = textkit.words(texts)
    return _LOWER[w.data].tobytes(), w


def _windows(w: textkit.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, first byte and length of every window of ``WINDOW`` words (the last one of a text may be shorter)."""
    n = np.where(w.counts > 0, 1 + np.maximum(0, -(-(w.counts - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = w.first[:-1][owner] + place * STRIDE
    last = np.minimum(begin + WINDOW, w.first[1:][owner]) - 1
    return owner, w.start[begin], w.end[last] - w.start[begin]


class Compressors:
    """The two compressors of a task."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.pair = [self._compressor(content) for content in (ordinary, ordinary + toxic)]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        settings = zstandard.ZstdCompressionParameters.from_level(
            3, min_match=4, write_checksum=False, write_content_size=False, write_dict_id=False
        )
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(compression_params=settings, dict_data=dictionary)

    def saved(self, data: bytes, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        if len(begin) == 0:
            return np.zeros(0, np.int64)
        segments = np.stack([begin, length], 1).astype("<u8").tobytes()
        windows = zstandard.BufferWithSegments(data, segments)
        sizes = [np.fromiter((len(x) for x in c.multi_compress_to_buffer(windows, threads=1)), np.int64, len(begin)) for c in self.pair]
        return sizes[0] - sizes[1]


def _features(texts: pa.Array, compressors: Compressors) -> np.ndarray:
    """Per text: largest saving, mean of the three largest, log of the number of windows, share of windows saving 4 or more."""
    data, w = _spans(texts)
    owner, begin, length = _windows(w)
    gain = compressors.saved(data, begin, length)
    n = len(texts)
    out = np.zeros((n, 4))
    counts = np.bincount(owner, minlength=n)
    order = np.lexsort((-gain, owner))
    sorted_gain, at = gain[order], np.cumsum(counts) - counts
    for k in range(3):
        has = counts > k
        top = sorted_gain[at[has] + k]
        out[has, 1] += top / 3
        if k == 0:
            out[has, 0] = top
    out[:, 2] = np.log1p(counts)
    out[:, 3] = np.bincount(owner, gain >= 4, minlength=n) / np.maximum(counts, 1)
    return out


def _design(features: np.ndarray) -> np.ndarray:
    top = np.minimum(features[:, 0], 30)
    return np.column_stack([np.ones(len(features)), top, features[:, 1], features[:, 2], features[:, 3], top * features[:, 2], np.maximum(top - 6, 0)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x, beta = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)) * 0.1, x.T @ (y - p) - ridge * 0.1 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta / scale


def _word_grams(word: bytes) -> set[bytes]:
    padded = b" " + word + b" "
    return {padded[i : i + n] for n in GRAMS for i in range(len(padded) - n + 1)}


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and ordinary texts each byte sequence occurs."""
    for batch in textkit.pieces(batches, "text"):
        found = [Counter(), Counter()]
        data, w = _spans(batch.column("text"))
        known: dict[bytes, set[bytes]] = {}
        for i, toxic in enumerate(batch.column("toxic").to_pylist()):
            distinct = {data[s:e] for s, e in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])}
            for x in distinct.difference(known):
                known[x] = _word_grams(x)
            found[toxic].update(set().union(*(known[x] for x in distinct)))
        keys = list(found[0] | found[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), *[pa.array([found[c][k] for k in keys], pa.int64()) for c in (1, 0)]], ["gram", "toxic", "ordinary"]
        )


def _marked_words(grams: frozenset[bytes]):
    """Words of toxic texts that hold one of ``grams``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text"):
            data, w = _spans(batch.column("text"))
            count = Counter(data[s:e] for s, e in zip(w.start, w.end))
            hits = {x: n for x, n in count.items() if not grams.isdisjoint(_word_grams(x))}
            yield pa.RecordBatch.from_arrays([pa.array(list(hits), pa.binary()), pa.array(list(hits.values()), pa.int64())], ["word", "n"])

    return run


def _ordinary_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textkit.pieces(batches, "text"):
        data, w = _spans(batch.column("text"))
        _, begin, length = _windows(w)
        yield pa.RecordBatch.from_arrays([pa.array([data[b : b + n] for b, n in zip(begin, length)], pa.binary())], ["window"])


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; the samples themselves (the last the nearest) if they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))[-size:]


def _cover(words: list[bytes], weight: dict[bytes, float], size: int) -> bytes:
    """The words that together hold most of the weight of the byte sequences, the heaviest last (the nearest), in ``size`` bytes.

    A word counts for what no word before it holds, so many spellings of one mark leave room for all others.
    """
    open_grams = dict(weight)
    holds = {x: [g for g in sorted(_word_grams(x)) if g in open_grams] for x in words}
    queue = [(-sum(open_grams[g] for g in grams), x) for x, grams in holds.items()]
    heapq.heapify(queue)
    chosen, room = [], size - 1
    while queue and room > 0:
        gain, x = heapq.heappop(queue)
        now = -sum(open_grams.get(g, 0.0) for g in holds[x])
        if now > gain:  # others hold a part of it by now
            if now < 0:
                heapq.heappush(queue, (now, x))
            continue
        if now < 0 and len(x) < room:
            chosen.append(x)
            room -= len(x) + 1
            for g in holds[x]:
                open_grams.pop(g, None)
    return b" " + b"".join(x + b" " for x in reversed(chosen)) if chosen else b""


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[bytes, bytes, np.ndarray]:
    """Dictionaries and calibration from ``text, toxic (0/1), part`` (0: dictionaries, 1: calibration), at most ``2 * sample`` rows."""
    fold = [labelled.filter(F.col("part") == p).select("text", "toxic") for p in (0, 1)]
    n = {r["toxic"]: r["n"] for r in fold[0].groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_ordinary = n.get(1, 0), n.get(0, 0)
    lift = (F.col("toxic") / max(n_toxic, 1)) / ((F.col("ordinary") + 0.5) / max(n_ordinary, 1))
    grams = (
        fold[0].mapInArrow(_gram_counts, "gram binary, toxic long, ordinary long")
        .groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
        .filter((F.col("toxic") >= max(4, math.ceil(0.02 * n_toxic))) & (lift >= 20))
        .orderBy((F.col("toxic") * F.log(lift)).desc(), "gram").limit(2000)
        .select("gram", (F.col("toxic") * F.log(lift)).alias("weight")).collect()
    )
    weight = {bytes(r["gram"]): r["weight"] for r in grams}
    marked = (
        fold[0].filter("toxic = 1").mapInArrow(_marked_words(frozenset(weight)), "word binary, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(2000).collect()
    )
    ordinary_samples = [
        bytes(r[0]) for r in fold[0].filter("toxic = 0").mapInArrow(_ordinary_windows, "window binary")
        .orderBy(F.xxhash64("window"), "window").limit(20000).collect()
    ]
    ordinary, toxic = _dictionary(ordinary_samples, ORDINARY_BYTES), _cover([bytes(r["word"]) for r in marked], weight, TOXIC_BYTES)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Compressors(ordinary, toxic)
        for batch in textkit.pieces(batches, "text"):
            f = _features(batch.column("text"), pair)
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in f.T], batch.column("toxic")], ["a", "b", "c", "d", "toxic"])

    rows = np.array(fold[1].mapInArrow(features, "a double, b double, c double, d double, toxic int").orderBy("a", "b", "c", "d", "toxic").collect(), float)
    if len(rows) == 0 or rows[:, 4].min() == rows[:, 4].max():  # one class only: nothing to tell apart
        rate = rows[:, 4].mean() if len(rows) else 0.0
        return ordinary, toxic, np.array([math.log((rate + 1e-6) / (1 - rate + 1e-6)), 0, 0, 0, 0, 0, 0])
    return ordinary, toxic, _logistic(_design(rows[:, :4]), rows[:, 4])


def score(docs: DataFrame, model: tuple[bytes, bytes, np.ndarray], text: str = "text") -> DataFrame:
    """``doc_id, score`` for every row: the probability that the text is toxic."""
    ordinary, toxic, weights = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Compressors(ordinary, toxic)
        for batch in textkit.pieces(batches, "text"):
            z = _design(_features(batch.column("text"), pair)) @ weights
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    narrow = docs.select("doc_id", F.col(text).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Labels are learnt only where ``crc32(doc_id as text) mod 4`` is not 2 (``held_out`` marks the others, and null
    ids); a doc_id labelled more than once counts as toxic if any label says so, null labels are left out. The
    ``2 * sample`` labelled ids of smallest hash are used. Null and empty texts are scored as texts without windows.
    Without labels of both kinds every score is the share of toxic labels. Repeated rows are scored alike; an empty
    table gives an empty table; other columns are never read.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    chosen = (
        labels.filter((fold != 2) & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.md5(F.col("labelled").cast("string")), "labelled").limit(2 * sample)
    )
    part = F.conv(F.substring(F.md5(F.concat(F.lit("part"), F.col("labelled").cast("string"))), 1, 8), 16, 10).cast("long") % 2
    picked = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    model = fit(picked.select("text", "toxic", part.alias("part")), sample)
    scored = score(docs, model, text)
    return scored.select(
        "doc_id", F.coalesce(fold == 2, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
