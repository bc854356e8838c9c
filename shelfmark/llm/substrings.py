"""Removing passages that an earlier document already has, by suffix automata of reference shards.

The reference of a document is every document with a smaller id, so it grows with the corpus and is not broadcast:
it is cut into shards that the documents are routed to.

* Every window of ``length`` words has a *seed*, its smallest hash of ``GRAM`` words. Equal windows have equal seeds,
  so a window can only repeat if its seed occurs in two documents. Seeds cost one row per four to five words.
* The windows of one seed occurrence form a *unit* (a stretch of ``length`` words or a little more). Equal units
  collapse to one row with the smallest document id.
* All units of a seed form a reference shard. Its suffix automaton is built over their word codes, every state
  labelled with the smallest document id among its occurrences; the units are streamed through it, and the state of
  the last ``length`` words names the first document with that window. Seeds with more than ``MOST_UNITS`` different
  units (the edges of a very common passage) are cut further, to one shard per window.
* A word is removed if a window that covers it occurs in an earlier document, so removed spans are maximal.

Words enter as hashes of 64 bits in seeds, units and windows, and as 32-bit codes in the automata.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.session import materialize
from shelfmark.llm import textkit

GRAM = 5
MOST_UNITS = 256


def _seeds(w: textkit.Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``GRAM`` words, and for each window of ``length`` words its start and the place of its seed."""
    g = textkit.grams(w.hash, GRAM)
    span = length - GRAM + 1
    n = len(g) - span + 1
    if n <= 0:
        return g, np.zeros(0, np.int64), np.zeros(0, np.int64)
    best, place = g[:n].copy(), np.arange(n)
    for t in range(1, span):
        smaller = g[t : t + n] < best
        best[smaller] = g[t : t + n][smaller]
        place[smaller] = np.flatnonzero(smaller) + t
    start = np.flatnonzero(w.left()[:n] >= length)
    return g, start, place[start]


def _seed_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text"):
            w = textkit.words(batch.column("text"))
            g, _, place = _seeds(w, length)
            place = place[np.flatnonzero(np.diff(place, prepend=-1))]
            owner = w.text_of()[place]
            once = np.unique(g[place] ^ textkit.mix(owner.astype(np.uint64), 3), return_index=True)[1]
            place, owner = place[once], owner[once]
            yield pa.RecordBatch.from_arrays([pa.array(g[place].view(np.int64)), batch.column("doc_id").take(pa.array(owner))], ["seed", "doc_id"])

    return run


def _unit_rows(length: int):
    """One row per occurrence of a repeated seed: its windows start at ``at`` and follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text"):
            w = textkit.words(batch.column("text"))
            g, start, place = _seeds(w, length)
            owner = w.text_of()
            # repeated seeds are known per document: tie each seed to its document by mixing both
            lists = batch.column("seeds")
            values = np.asarray(lists.flatten()).view(np.uint64)
            sizes = np.asarray(lists.value_lengths())
            of_list = textkit.mix(np.repeat(np.arange(batch.num_rows, dtype=np.uint64), sizes), 3)
            of_place = textkit.mix(owner[place].astype(np.uint64), 3)
            known = np.isin(g[place] ^ of_place, values ^ of_list)
            start, place = start[known], place[known]
            first = np.flatnonzero(np.diff(place, prepend=-1))
            count = np.diff(np.append(first, len(place)))
            at, seed = start[first], g[place[first]]
            codes = (w.hash >> np.uint64(32)).astype("<u4").tobytes()
            words = count + length - 1
            unit = np.empty(len(at), np.uint64)
            for size in np.unique(words):
                mine = words == size
                unit[mine] = textkit.grams(w.hash, int(size))[at[mine]]
            own = owner[at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(seed.view(np.int64)), pa.array(unit.view(np.int64)), batch.column("doc_id").take(pa.array(own)),
                    batch.column("own").take(pa.array(own)), pa.array((at - w.first[own]).astype(np.int32)),
                    pa.array([codes[4 * a : 4 * (a + n)] for a, n in zip(at, words)], pa.binary()),
                ],
                ["seed", "unit", "doc_id", "own", "at", "codes"],
            )

    return run


class Automaton:
    """Suffix automaton of several words sequences; each state knows the smallest label that occurs at it."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.label = [-1], [0], [None]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.label.append(None)
        return len(self.next) - 1

    def _split(self, p: int, code: int, q: int) -> int:
        """The state for the extension of ``p`` by ``code``, cut out of ``q`` if that also stands for longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(code) == q:
            self.next[p][code] = clone
            p = self.link[p]
        return clone

    def add(self, codes: list[int], label: int) -> None:
        last = 0
        for code in codes:
            q = self.next[last].get(code)
            if q is not None:
                last = self._split(last, code, q)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p >= 0 and code not in self.next[p]:
                    self.next[p][code] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, code, self.next[p][code])
                last = new
            if self.label[last] is None or label < self.label[last]:
                self.label[last] = label

    def close(self) -> None:
        """Hand the smallest labels on to shorter suffixes."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if self.label[s] is not None and (self.label[up] is None or self.label[s] < self.label[up]):
                self.label[up] = self.label[s]

    def first_labels(self, codes: list[int], length: int) -> list[int]:
        """For every window of ``length`` codes the smallest label of a sequence that has it."""
        state, matched, out = 0, 0, []
        for code in codes:
            while state and code not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if code in self.next[state]:
                state, matched = self.next[state][code], matched + 1
            while self.length[self.link[state]] >= length if state else False:
                state = self.link[state]
                matched = self.length[state]
            if matched >= length:
                out.append(self.label[state])
        return out


def _shard_answers(length: int):
    """Stream units sorted by seed; answer each with the first document of each of its windows.

    Units of common seeds only get the hash of each window, to be answered by window.
    """

    def answers(units: list[tuple[int, int, bytes]]) -> list[list[int]]:
        if len(units) == 1:
            _, first, codes = units[0]
            return [[first] * (len(codes) // 4 - length + 1)]
        sequences = [np.frombuffer(codes, "<u4").tolist() for _, _, codes in units]
        automaton = Automaton()
        for (_, first, _), codes in zip(units, sequences):
            automaton.add(codes, first)
        automaton.close()
        return [automaton.first_labels(codes, length) for codes in sequences]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed, units = None, []
        done: list[tuple[int, int, int, list[int] | None, list[int] | None]] = []

        def flush() -> None:
            if units:
                done.extend((seed, u, f, a, None) for (u, f, _), a in zip(units, answers(units)))
                units.clear()

        def rows() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            out = [pa.array([d[i] for d in done], kind) for i, kind in enumerate(kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(out, ["seed", "unit", "first", "firsts", "windows"])

        for batch in batches:
            for s, u, first, codes, common in zip(*(batch.column(c).to_pylist() for c in ("seed", "unit", "first", "codes", "common"))):
                if common:
                    keys = textkit.grams(textkit.mix(np.frombuffer(codes, "<u4").astype(np.uint64)), length)
                    done.append((s, u, first, None, keys.view(np.int64).tolist()))
                    continue
                if s != seed:
                    flush()
                    seed = s
                units.append((u, first, codes))
            if len(done) > 20_000:
                yield rows()
        flush()
        yield rows()

    return run


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text"):
            n_words, n_removed, digest = [], [], []
            for text, starts in zip(batch.column("text").fill_null("").to_pylist(), batch.column("starts").to_pylist()):
                words = text.encode().split()  # bytes split at exactly the separators of textkit
                n_words.append(len(words))
                if starts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, np.asarray(starts) + length, -1)
                    words = [x for x, c in zip(words, np.cumsum(edge)) if not c]
                n_removed.append(n_words[-1] - len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def repeated_windows(docs: DataFrame, length: int = 13) -> DataFrame:
    """``doc_id, own, starts``: for each document with repeats, the first words of windows that an earlier document has.

    ``docs`` has ``doc_id`` (not null), ``text`` and ``own``, a hash of the text that tells rows of one id apart.
    """
    seeds = docs.select("doc_id", "text").mapInArrow(_seed_rows(length), "seed long, doc_id long")
    repeated = seeds.groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("seed")
    repeated = materialize(repeated, "repeated")  # a plain table on one side: the join can split common seeds
    by_doc = materialize(seeds.join(repeated, "seed").groupBy("doc_id").agg(F.collect_set("seed").alias("seeds")), "seeds")
    schema = "seed long, unit long, doc_id long, own long, at int, codes binary"
    units = materialize(docs.join(by_doc, "doc_id").select("doc_id", "own", "text", "seeds").mapInArrow(_unit_rows(length), schema), "units")

    distinct = units.groupBy("seed", "unit").agg(F.min("doc_id").alias("first"), F.first("codes").alias("codes"))
    common = materialize(
        units.select("seed", "unit").distinct().groupBy("seed").count().filter(F.col("count") > MOST_UNITS).select("seed", F.lit(True).alias("common")), "common"
    )
    marked = distinct.join(common, "seed", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    # the units of a seed stay together, those of a common seed are spread
    shards = marked.repartition("seed", F.when(F.col("common"), F.col("unit"))).sortWithinPartitions("seed")
    schema = "seed long, unit long, first long, firsts array<long>, windows array<long>"
    answers = materialize(shards.mapInArrow(_shard_answers(length), schema), "answers")
    windows = answers.filter("windows is not null").select("seed", "unit", "first", F.posexplode("windows").alias("place", "window"))
    firsts = windows.groupBy("seed", "window").agg(F.min("first").alias("low"))
    of_common = windows.join(firsts, ["seed", "window"]).groupBy("seed", "unit").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "low"))), lambda x: x["low"]).alias("firsts")
    )
    answered = answers.filter("firsts is not null").select("seed", "unit", "firsts").unionByName(of_common)
    found = units.drop("codes").join(answered, ["seed", "unit"])
    starts = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("firsts") - 1), lambda i: F.get("firsts", i) < F.col("doc_id")), lambda i: i + F.col("at")
    )
    hit = found.select("doc_id", "own", starts.alias("starts")).filter(F.size("starts") > 0)
    return hit.groupBy("doc_id", "own").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def remove_repeats(docs: DataFrame, length: int = 13, text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs``.

    A word goes if a window of ``length`` words that covers it starts in a document with a smaller ``doc_id`` too.
    Null texts have no words, texts shorter than a window lose none, and repeats inside one document stay. Rows that
    repeat a ``doc_id`` are judged each by its own text against smaller ids. A null ``doc_id`` has no order: such rows
    lose nothing and count for no other row. An empty table gives an empty table; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = texts.withColumn("own", F.xxhash64("text"))
    starts = materialize(repeated_windows(keyed.filter("doc_id is not null"), length), "repeats")
    return (
        keyed.join(starts, ["doc_id", "own"], "left").select("doc_id", "text", "starts")
        .mapInArrow(_kept(length), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    )
