"""SimHash near duplicates: fingerprints compared as bit planes with carry-save counters.

* A bit of a fingerprint is set if over half of the text's shingle hashes have it set. Equal fingerprints are one node,
  so copies cost a row.
* Fingerprints within ``radius`` bits agree in at least ``parts - radius`` of ``parts`` blocks of bits, so those that
  agree in some choice of so many blocks meet in a bucket (``parts=6``, radius 4: 15 buckets of 20 to 22 bits each).
* A bucket is compared vertically: plane ``p`` holds bit ``p`` of 64 fingerprints a machine word. The plane, flipped where
  the asking fingerprint has a 1, is added to counters of ``log2(radius)`` planes with carries; they start so high that
  the counter of a fingerprint overflows once it is beyond the radius. Words all of whose 64 fingerprints have
  overflowed are abandoned.
* A bucket hands on a spanning forest of its links, not the links; buckets over ``BUCKET`` fingerprints meet slice by slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import groups
from shelfmark.functions.session import materialize
from shelfmark.llm import blocks
from shelfmark.llm.components import components

SEED = 42
BUCKET = 1 << 13
#: Shingles whose bits are counted at a time, and pairs of fingerprint and word that are compared at a time.
COUNTED, COMPARED = 1 << 14, 1 << 15
#: Planes after which words are looked through for those to abandon.
LOOKS = (16, 24, 32, 40, 48)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
KEYS = ["t", "key", "i", "j"]


def fingerprint(text: str | None, k: int = 4) -> int:
    """The 64 bits of a text, A-Z as a-z; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(words) - k + 1, 1)
    starts, ends = starts[:last], ends[min(k, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, last, COUNTED):
        spans = zip(starts[at : at + COUNTED].tolist(), ends[at : at + COUNTED].tolist())
        digests = b"".join([xxhash.xxh64_digest(whole[s:e], SEED) for s, e in spans])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last).tobytes(), "big")


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py(), k) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits.view(np.int64))], ["doc_id", "f"])

    return run


def _masks(parts: int, radius: int) -> list[int]:
    edges = [round(i * 64 / parts) for i in range(parts + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(parts)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(parts), parts - radius)]


def close_lanes(bits: np.ndarray, free: list[int], q: np.ndarray, w: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of fingerprint ``q`` and word ``w`` (64 fingerprints): pairs ``(q, lane)`` within ``radius`` over the planes ``free``.

    ``bits`` is a row of 0 and 1 for each fingerprint, as many rows as the words have lanes.
    """
    planes = np.packbits(bits.T[free], axis=1).view(np.uint64)
    flips = np.where(bits.T[free].astype(bool), FULL, np.uint64(0))
    size = radius.bit_length()
    start = (1 << size) - 1 - radius  # the counter overflows at radius + 1
    counters = [np.full(len(q), FULL if start >> b & 1 else 0, np.uint64) for b in range(size)]
    over = np.zeros(len(q), np.uint64)
    for p in range(len(free)):
        carry = planes[p][w] ^ flips[p][q]
        for b in range(size):
            counters[b], carry = counters[b] ^ carry, counters[b] & carry
        over |= carry
        if p + 1 in LOOKS:
            open_ = np.flatnonzero(over != FULL)
            if len(open_) < len(q):
                q, w, over, counters = q[open_], w[open_], over[open_], [c[open_] for c in counters]
    open_ = np.flatnonzero(over != FULL)
    lanes = np.unpackbits((~over[open_]).view(np.uint8).reshape(-1, 8), axis=1)
    at, lane = np.nonzero(lanes)
    return q[open_][at], w[open_][at] * 64 + lane


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find over many pairs at once; ``root`` points to the least member and is flat before and after."""
    while len(a):
        x, y = root[a], root[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def _compare(radius: int, masks: list[int]):
    free_planes = [[p for p in range(64) if not m >> (63 - p) & 1] for m in masks]

    def one_choice(f: np.ndarray, first: np.ndarray, i: np.ndarray, j: np.ndarray, side: np.ndarray, free: list[int]):
        n = len(f)
        end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
        # in a block of two slices those of side 0 ask and those of side 1, which stand behind, answer
        split = np.repeat(np.add.reduceat(1 - side, first) + first, np.diff(np.append(first, n)))
        begin = np.where(i == j, np.arange(n) + 1, np.where(side == 0, split, end))
        many = np.where(begin < end, (end - 1) // 64 - begin // 64 + 1, 0)
        bits = np.zeros((-(-n // 64) * 64, 64), np.uint8)
        bits[:n] = np.unpackbits(f.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
        root, upto = np.arange(n), np.cumsum(many)
        asked = 0
        while asked < n:
            stop = max(int(np.searchsorted(upto, (upto[asked - 1] if asked else 0) + COMPARED, "right")), asked + 1)
            q = np.repeat(np.arange(asked, stop), many[asked:stop])
            w = begin[q] // 64 + np.arange(len(q)) - np.repeat(np.cumsum(many[asked:stop]) - many[asked:stop], many[asked:stop])
            if len(q):
                a, b = close_lanes(bits, free, q, w, radius)
                real = (b >= begin[a]) & (b < end[a])
                join_roots(root, a[real], b[real])
            asked = stop
        linked = np.flatnonzero(root != np.arange(n))
        return f[linked].view(np.int64), f[root[linked]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups.whole_groups(batches, KEYS):
            t, f, i, j, side = (table.column(c).to_numpy() for c in ("t", "f", "i", "j", "side"))
            first = groups.changes(table, KEYS)
            alone = np.diff(np.append(first, len(f)))
            for choice in np.unique(t[first[alone > 1]]):
                lo, hi = np.searchsorted(t, [choice, choice + 1])
                here = first[(first >= lo) & (first < hi)] - lo
                a, b = one_choice(f[lo:hi].view(np.uint64), here, i[lo:hi], j[lo:hi], side[lo:hi], free_planes[choice])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def links(fingerprints: DataFrame, radius: int = 4, parts: int = 6, most: int = BUCKET) -> DataFrame:
    """``a, b``: pairs of the distinct ``fingerprints(f)`` whose components are those of all pairs within ``radius`` bits."""
    if not 0 < radius < parts:
        raise ValueError("more parts than radius are needed")
    masks = _masks(parts, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("f").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)])
    dealt = fingerprints.select("f", F.explode(keys).alias("_b")).select("_b.*", "f")
    met = blocks.paired(dealt, ["t", "key"], most, F.col("f"))
    return met.repartition(*KEYS).sortWithinPartitions(*KEYS, "side", "f").mapInArrow(_compare(radius, masks), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4, parts: int = 6, text: str = "text", most: int = BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Rows link if their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest ``doc_id`` that
    can be reached. A null or blank text has fingerprint zero and links like any other; a row that repeats a
    ``doc_id`` has its own fingerprint; a null ``doc_id`` gets the smallest id it reaches, or null. An empty table gives
    an empty table; other columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(narrow.mapInArrow(_fingerprints(k), "doc_id long, f long"), "fingerprints")
    nodes = materialize(rows.groupBy("f").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = materialize(links(nodes.select("f"), radius, parts, most), "links")
    label = components(found).withColumnsRenamed({"id": "f"})
    labelled = materialize(nodes.join(label, "f", "left").withColumn("label", F.coalesce("label", "f")), "labels")
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "label").select("f", "component_id")
    return rows.join(named, "f").select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
