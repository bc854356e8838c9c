"""Benchmark decontamination: CGK embedding, bit sampling and exact edit verification.

The CGK walk reads a word sequence with a pointer that stays or moves on by a random bit of the step and the word it
stands on. Two sequences at small edit distance fall into step again after each edit, so their outputs agree in most
places: edit distance becomes Hamming distance, and equality in a few sampled places is a locality-sensitive hash.

Items are indexed from every word on, in ``WALKS`` walks with two samples of places each; the walk of a document starts at
every word. A walk goes on only where its places so far agree with some item, so almost all starts end at the second
place. Items of fewer than ``SHORT`` words are shorter than the walks: such an item is cut into one part more than the
edits it allows, one of which stands in every match as it is, so the parts are looked up from every word. Every candidate then names the item-sized window it implies, and the exact edit distance of the item to the
best stretch of that window (and of the tolerated number of words around it) decides.

The pass over the documents is narrow. Items go to the tasks in blocks of ``BLOCK``, one pass each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import textkit

U64 = np.uint64
BLOCK = 4000
WALKS = 3
#: Sampled places of the walks, two samples each. Place 0 is the first word itself.
PLACES = [
    [(0, 2, 4, 6, 8, 10), (0, 1, 4, 7, 10, 13)], [(0, 3, 5, 7, 9, 11), (0, 2, 5, 8, 11, 14)], [(0, 2, 3, 6, 9, 12), (0, 4, 6, 9, 11, 13)]
]
#: Items of fewer words are found by their parts, without a miss.
SHORT = 15
#: By default items of fewer words are no evidence, as any text may hold them, and are not searched.
LEAST_WORDS = 8
_BITS = 1 << 20


class Index:
    """The items of one block and the sampled walks from each of their words."""

    def __init__(self, ids: list[int], texts: list[str], tolerance: float, least_words: int = LEAST_WORDS):
        w = textkit.words(pa.array(texts, pa.string()), lower=True)
        self.ids = ids
        self.words = [w.hash[a:b] for a, b in zip(w.first, w.first[1:])]
        self.allowed = [int(tolerance * len(x)) for x in self.words]
        #: which words an item holds, by the low bits of their hash
        self.holds = np.zeros((len(ids), 1024), bool)
        self.holds[w.text_of(), (w.hash & U64(1023)).astype(np.int64)] = True
        starts = np.flatnonzero(np.repeat(w.counts >= max(least_words, SHORT), w.counts))
        #: by length of a part: sorted keys of the parts, their items, and where in the item each begins
        self.parts = {}
        short = [i for i, x in enumerate(self.words) if max(least_words, 1) <= len(x) < SHORT]
        cut = [(i, a, b) for i in short for a, b in _parts(len(self.words[i]), self.allowed[i] + 1)]
        for length in sorted({b - a for _, a, b in cut}):
            mine = [(i, a) for i, a, b in cut if b - a == length]
            keys = np.array([textkit.grams(self.words[i][a : a + length], length)[0] for i, a in mine], U64)
            order = np.argsort(keys, kind="stable")
            self.parts[length] = keys[order], np.array([i for i, _ in mine])[order], np.array([a for _, a in mine])[order]
        owner, left = w.text_of(), w.left()
        self.tables = []
        for walk in range(WALKS):
            coins = textkit.mix(w.hash, 300 + walk)
            for places in PLACES[walk]:
                at, key, levels = starts.copy(), np.zeros(len(starts), U64), []
                begin = starts
                step = 0
                for place in places:
                    for j in range(step, place):
                        at = at + ((coins[np.minimum(at, len(coins) - 1)] >> U64(j)) & U64(1)).astype(np.int64)
                    step = place
                    inside = at - begin < left[begin]  # beyond the end of an item there is nothing to compare
                    at, begin, key = at[inside], begin[inside], key[inside]
                    key = textkit.mix(key ^ w.hash[at], place)
                    seen = np.zeros(_BITS, bool)
                    seen[(key & U64(_BITS - 1)).astype(np.int64)] = True
                    levels.append(seen)
                order = np.argsort(key, kind="stable")
                item = owner[begin[order]]
                self.tables.append((walk, places, levels, key[order], item, begin[order] - w.first[item]))

    def candidates(self, w: textkit.Words) -> np.ndarray:
        """Rows (document word where an item would start, item), without repeats."""
        n = len(w.hash)
        found = []
        everywhere = np.arange(n)
        coins: dict[int, np.ndarray] = {}
        for walk, places, levels, keys, items, offsets in self.tables:
            if walk not in coins:
                coins[walk] = textkit.mix(w.hash, 300 + walk)
            begin, at, key, step = everywhere, everywhere, None, 0
            for place, seen in zip(places, levels):
                for j in range(step, place):
                    at = np.minimum(at + ((coins[walk][at] >> U64(j)) & U64(1)).astype(np.int64), n - 1)
                step = place
                word = w.hash if key is None else w.hash[at]
                key = textkit.mix(word if key is None else key ^ word, place)
                going = np.flatnonzero(seen[(key & U64(_BITS - 1)).astype(np.int64)])
                begin, at, key = begin[going], at[going], key[going]
            low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            many = high - low
            entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            found.append(np.column_stack([np.repeat(begin, many) - offsets[entry], items[entry], np.repeat(begin, many)]))
        for length, (keys, items, offsets) in self.parts.items():
            inside = w.left() >= length
            key = textkit.grams(w.hash, length)
            at = np.flatnonzero(inside[: len(key)])
            low, high = np.searchsorted(keys, key[at]), np.searchsorted(keys, key[at], "right")
            many = high - low
            entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            found.append(np.column_stack([np.repeat(at, many) - offsets[entry], items[entry], np.repeat(at, many)]))
        rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        if len(rows) == 0:
            return rows
        rows = rows[np.unique(rows[:, 0] * len(self.ids) + rows[:, 1], return_index=True)[1]]
        # no stretch is near an item if too few words around it are words of the item
        size, allowed = (np.array(x)[rows[:, 1]] for x in ([len(x) for x in self.words], self.allowed))
        low = w.hash & U64(1023)
        shared = np.zeros(len(rows), np.int64)
        for i in range(int((size + 2 * allowed).max())):
            at = rows[:, 0] - allowed + i
            inside = np.flatnonzero((i < size + 2 * allowed) & (at >= 0) & (at < n))
            shared[inside] += self.holds[rows[inside, 1], low[at[inside]].astype(np.int64)]
        return rows[shared >= size - allowed]


def _parts(n: int, parts: int) -> list[tuple[int, int]]:
    """``n`` words in ``parts`` near-equal parts."""
    edges = [round(i * n / parts) for i in range(parts + 1)]
    return list(zip(edges, edges[1:]))


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Edit distance of ``item`` to the closest stretch ``text[start:end]``: (distance, start, end), leftmost shortest end."""
    n = len(text)
    cost, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    ramp = np.arange(n + 1)
    for i, word in enumerate(item):
        diagonal = cost[:-1] + (text != word)
        above = cost[1:] + 1
        best = np.minimum(diagonal, above)
        source = np.where(diagonal <= above, origin[:-1], origin[1:])
        value = np.concatenate([[i + 1], best]) - ramp
        running = np.minimum.accumulate(value)
        where = np.maximum.accumulate(np.where(value == running, ramp, 0))
        cost = running + ramp
        origin = np.concatenate([[0], source])[where]
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


def _matches(index: Index, w: textkit.Words) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word, words, distance) of the verified matches; of overlapping ones for an item the best."""
    rows = index.candidates(w)
    if len(rows) == 0:
        return []
    owner = np.searchsorted(w.first, rows[:, 2], "right") - 1
    verified: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    tried: dict[tuple[int, int], list[tuple[int, int]]] = {}
    first_of: dict[int, int] = {}
    for (start, item, _), text in zip(rows.tolist(), owner.tolist()):
        words, allowed = index.words[item], index.allowed[item]
        low = max(int(w.first[text]), start - allowed)
        high = min(int(w.first[text + 1]), start + len(words) + allowed)
        done = tried.setdefault((text, item), [])
        if any(a <= low and high <= b for a, b in done):
            continue
        done.append((low, high))
        distance, a, b = best_stretch(words, w.hash[low:high])
        if distance <= allowed and b > a:
            # the texts of one id are one item
            known = first_of.setdefault(index.ids[item], item) if index.ids[item] is not None else item
            verified.setdefault((text, known), []).append((distance, low + a, low + b))
    out = []
    for (text, item), hits in verified.items():
        taken: list[tuple[int, int]] = []
        for distance, a, b in sorted(set(hits)):
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                out.append((text, item, a - int(w.first[text]), b - a, distance))
    return out


def _blocks(items: DataFrame, text: str) -> Iterator[tuple[list[int], list[str]]]:
    """All distinct texts of the items in blocks of ``BLOCK``, in order of id; the texts of one id are not parted."""
    known = items.select("item_id", F.col(text).alias("text")).filter("text is not null").distinct()
    without = known.filter("item_id is null")
    last = None
    while True:  # texts without an id are an item each
        rows = (without if last is None else without.filter(F.col("text") > last)).orderBy("text").limit(BLOCK).collect()
        if rows:
            yield [None] * len(rows), [r["text"] for r in rows]
        if len(rows) < BLOCK:
            break
        last = rows[-1]["text"]
    after = None
    while True:
        rest = known.filter("item_id is not null" if after is None else F.col("item_id") > after)
        rows = rest.orderBy("item_id", "text").limit(BLOCK).collect()
        full = len(rows) == BLOCK
        if full:
            after, last = rows[-1]
            rows += rest.filter((F.col("item_id") == after) & (F.col("text") > last)).orderBy("text").collect()
        if rows:
            yield [r["item_id"] for r in rows], [r["text"] for r in rows]
        if not full:
            return


def leaks(docs: DataFrame, items: DataFrame, tolerance: float = 0.2, text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, item_id, first_word, n_words, distance`` for every passage of a document that is an item.

    A passage is an item if its words (A-Z as a-z) differ by at most ``tolerance`` of the item's words, counted as
    inserted, left out or replaced words. Of passages of one item that overlap, the closest (then first) is given. Items
    of fewer than ``least_words`` words and null texts match nothing; of rows that repeat an ``item_id`` every distinct text is
    searched, and texts without an id are an item each (``item_id`` null); rows that repeat a ``doc_id`` are searched each. Empty tables give an empty table. Every item is a
    query against all documents. Exact passages are always found, and every match of an item of fewer than 15 words; of
    longer items 95 % of the passages with 10 % of their words edited (see the tests).
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, first_word int, n_words int, distance int"

    def search(ids: list[int], texts: list[str]):
        shipped = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(*shipped.value, tolerance, least_words)
            for batch in textkit.pieces(batches, "text"):
                found = _matches(index, textkit.words(batch.column("text"), lower=True))
                doc = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array([index.ids[f[1]] for f in found], pa.int64()), *[pa.array([f[i] for f in found], pa.int32()) for i in (2, 3, 4)]],
                    ["doc_id", "item_id", "first_word", "n_words", "distance"],
                )

        return narrow.mapInArrow(run, schema)

    parts = [search(ids, texts) for ids, texts in _blocks(items, "text")]
    return reduce(DataFrame.unionByName, parts) if parts else narrow.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, items: DataFrame, tolerance: float = 0.2, text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, all columns, in a narrow pass per block of items."""
    for ids, texts in _blocks(items, "text"):
        shipped = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = Index(*shipped.value, tolerance, least_words)
            for batch in textkit.pieces(batches, text):
                hit = {f[0] for f in _matches(index, textkit.words(batch.column(text), lower=True))}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
