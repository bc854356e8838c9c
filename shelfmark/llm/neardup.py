"""Near-duplicate grouping with SuperMinHash, banding, verification and union-find.

* One narrow pass turns every text into its shingle set and the set into a SuperMinHash signature: element by
  element the ranks ``j + r`` (``r`` uniform) fall on the positions of a random permutation, so the ranks of one
  element are correlated and the variance is below that of independent hashes. All elements of many texts advance
  rank by rank together, and a text stops as soon as every position holds a value below the next rank.
* Equal sets are collapsed by a 128-bit set hash before anything is compared, so exact copies cost one row each.
* Texts that share a band meet in a bucket. Every member is first checked against the smallest id of its bucket
  only. After grouping, the members of buckets that still hold several groups are checked against one pivot drawn
  from their bucket, ``PIVOTS`` times over: a text meets other pivots in each of its buckets, so groups with a link
  between them soon fall together. Then the pairs *across* the groups left in a bucket are checked, but for those
  that an exact bound on their common shingles rules out inside the join: the shingles found in one text only are
  common to no pair, and a shingle common to two texts sets the same bit in their bitmaps. So no link between groups is
  missed and a bucket hands on next to none of the pairs that are no links.
* A link counts only if the full shingle sets (64-bit shingle hashes) reach the similarity.

With ``bands=72, rows=8`` a pair of similarity 0.8 shares no band with probability 1.8e-6, a pair of 0.3 shares
one with 0.5 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.session import materialize
from shelfmark.llm import textkit
from shelfmark.llm.components import components

U64 = np.uint64
LOW = U64(0xFFFFFFFF)
#: Up to this rank a permutation is traced back through its swaps; later it is kept whole, ``MATRIX`` entries at a time.
TRACED, MATRIX = 16, 1 << 22
PIVOTS = 2


def superminhash(elements: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """Signatures ``(len(first) - 1, m)`` of the sets ``elements[first[i]:first[i + 1]]``.

    A value is ``rank << 32 | fraction``; equal positions of two signatures agree with probability equal to the
    Jaccard similarity. An empty set has no value below the largest integer.
    """
    n = len(first) - 1
    sig = np.full((n, m), np.iinfo(U64).max, U64)
    owner = np.repeat(np.arange(n), np.diff(first))
    drawn: list[np.ndarray] = []
    for j in range(min(m, TRACED)):
        x, k = _draw(elements, j, m)
        at = k.copy()
        for i in range(j - 1, -1, -1):  # undo the earlier swaps: what stood at k before step j?
            at[at == drawn[i]] = i
        drawn.append(k)
        elements, owner, drawn = _settle(sig, elements, owner, at, x, j, drawn)
        if len(elements) == 0:
            return sig
    # few elements are left, of small sets: their permutations are kept as rows of a matrix, some sets at a time
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    while len(cuts):
        many = max(1, int(np.searchsorted(cuts, cuts[0] + MATRIX // m)))
        stop = cuts[many] if many < len(cuts) else len(owner)
        _finish(sig, elements[cuts[0] : stop], owner[cuts[0] : stop], [d[cuts[0] : stop] for d in drawn], m)
        cuts = cuts[many:]
    return sig


def _draw(elements: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    x = textkit.mix(elements, 1000 + j)
    return x, (j + (((x & LOW) * U64(m - j)) >> U64(32)).astype(np.int64)).astype(np.int16)


def _settle(sig, elements, owner, at, x, j, per_element):
    """Put the values of rank ``j`` in place and drop the sets that no later value can change."""
    m = sig.shape[1]
    np.minimum.at(sig.reshape(-1), owner * m + at, (U64(j) << U64(32)) | (x >> U64(32)))
    sets = owner[np.flatnonzero(np.diff(owner, prepend=-1))]
    going = np.zeros(len(sig), bool)
    going[sets] = (sig[sets] >= U64((j + 1) << 32)).any(axis=1)
    going = going[owner]
    if going.all():
        return elements, owner, per_element
    return elements[going], owner[going], [d[going] for d in per_element]


def _finish(sig, elements, owner, drawn, m) -> None:
    order = np.tile(np.arange(m, dtype=np.int16), (len(elements), 1))
    rows = np.arange(len(elements))
    for i, k in enumerate(drawn):
        order[rows, i], order[rows, k] = order[rows, k], order[rows, i].copy()
    for j in range(len(drawn), m):
        x, k = _draw(elements, j, m)
        rows = np.arange(len(elements))
        at = order[rows, k]
        order[rows, k] = order[rows, j]
        order[rows, j] = at
        elements, owner, (order,) = _settle(sig, elements, owner, at.astype(np.int64), x, j, [order])
        if len(elements) == 0:
            return


def _signatures(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text"):
            elements, first = textkit.shingle_sets(textkit.words(batch.column("text"), lower=True), k)
            sizes = np.diff(first)
            n = len(sizes)
            sig = superminhash(elements, first, bands * rows).reshape(n, bands, rows)
            key = np.broadcast_to(textkit.mix(np.arange(bands, dtype=U64), 5), (n, bands)).copy()
            for i in range(rows):
                key = textkit.mix(key ^ sig[:, :, i], i)
            full = np.flatnonzero(sizes)
            sums = [np.zeros(n, U64) for _ in range(2)]
            for seed, out in enumerate(sums):
                if len(full):
                    out[full] = np.add.reduceat(textkit.mix(elements, 50 + seed), first[full])
            has = np.zeros(n + 1, np.int32)
            np.cumsum(np.where(sizes > 0, bands, 0), out=has[1:])
            flat = pa.array(key[full].ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(has), flat),
                ],
                ["doc_id", "n_shingles", "s1", "s2", "bands"],
            )

    return run


def _confirm(k: int, share: int):
    """Pairs whose full shingle sets reach ``share`` per cent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text_b", textkit.PIECE // 2):
            left, at_left = textkit.shingle_sets(textkit.words(batch.column("text_a"), lower=True), k)
            right, at_right = textkit.shingle_sets(textkit.words(batch.column("text_b"), lower=True), k)
            linked = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = left[at_left[i] : at_left[i + 1]], right[at_right[i] : at_right[i + 1]]
                if min(len(x), len(y)) * 100 >= share * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked[i] = 100 * both >= share * (len(x) + len(y) - both) > 0
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(linked)) for c in ("a", "b")], ["a", "b"])

    return run


def _shingle_rows(k: int):
    """The distinct shingles of each text, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text"):
            elements, first = textkit.shingle_sets(textkit.words(batch.column("text"), lower=True), k)
            owner = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(first)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), pa.array(elements.view(np.int64))], ["doc_id", "g"])

    return run


#: Words of a bitmap; it says little of texts with far more shingles than its bits.
BITMAP = 64


def _bitmaps(k: int):
    """``rep, bits, extra``: which of ``64 * BITMAP`` codes the shingles of a text have, and how many share a code with another.

    Two texts have at most as many shingles in common as bits, and the smaller ``extra``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text"):
            elements, first = textkit.shingle_sets(textkit.words(batch.column("text"), lower=True), k)
            n = batch.num_rows
            owner = np.repeat(np.arange(n), np.diff(first))
            code = (textkit.mix(elements, 77) % U64(64 * BITMAP)).astype(np.int64)
            cell = np.unique(owner * 64 * BITMAP + code)
            bits = np.zeros(n * BITMAP, U64)
            np.bitwise_or.at(bits, cell // 64, U64(1) << (cell % 64).astype(U64))
            codes = np.bincount(cell // (64 * BITMAP), minlength=n)
            words = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BITMAP, BITMAP), pa.int32()), pa.array(bits.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), words, pa.array(np.diff(first) - codes)], ["rep", "bits", "extra"])

    return run


def near_duplicates(
    docs: DataFrame, k: int = 5, share: int = 80, bands: int = 72, rows: int = 8, text: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Texts are linked if ``100 * intersection >= share * union`` of their sets of ``k``-word shingles, A-Z as a-z;
    ``component_id`` is the smallest ``doc_id`` reachable over links and ``kept`` marks that document.
    Null, empty and blank texts have no shingles and link with nothing. Each row that repeats a
    ``doc_id`` is grouped by its own text. A null ``doc_id`` links with nothing: ``component_id`` null, ``kept`` true.
    An empty table gives an empty table; other columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"
    sig = materialize(narrow.mapInArrow(_signatures(k, bands, rows), schema), "signatures")
    full = sig.filter("doc_id is not null and n_shingles > 0")
    sets = full.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    dealt = sets.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).filter("leader < last").drop("last")
    members = materialize(dealt.join(shared, "bucket"), "buckets")

    sizes = members.select("rep", "n").distinct()
    texts = materialize(narrow.join(sizes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "texts")
    close = f"least(n_a, n_b) * 100 >= {share} * greatest(n_a, n_b)"

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = (texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")
        return pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(_confirm(k, share), "a long, b long")

    def untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
        """Distinct pairs ``a < b`` of texts whose sizes allow a link, without those tried before."""
        ordered = pairs.filter("a <> b").filter(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return materialize(ordered if tried is None else ordered.join(tried, ["a", "b"], "left_anti"), "pairs")

    tried = untried(
        members.select(F.col("leader").alias("a"), F.col("rep").alias("b"), F.col("n").alias("n_b"))
        .join(sizes.select(F.col("rep").alias("a"), F.col("n").alias("n_a")), "a"), None,
    )
    links = materialize(confirmed(tried), "links")
    groups = components(links)
    for turn in range(PIVOTS + 1):
        labelled = members.join(groups.select(F.col("id").alias("rep"), "label"), "rep", "left").select(
            "bucket", "rep", "n", F.coalesce("label", "rep").alias("label")
        )
        mixed = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("bucket")
        rest = materialize(labelled.join(mixed, "bucket", "left_semi"), "mixed-buckets")
        if rest.isEmpty():
            break
        a, b = (rest.select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in ("n", "label")], F.col("rep").alias(s)) for s in "ab")
        if turn < PIVOTS:
            drawn = F.xxhash64("bucket", "a", F.lit(turn))
            pivot = a.groupBy("bucket").agg(F.min_by(F.struct("a", "n_a", "label_a"), drawn).alias("p")).select("bucket", "p.*")
            across = pivot.join(b, "bucket").filter("label_a <> label_b")
        else:
            # shingles that no other text left has can be in no intersection: an exact bound for every pair
            left = texts.join(rest.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
            once = left.mapInArrow(_shingle_rows(k), "doc_id long, g long").groupBy("g").agg(F.min("doc_id").alias("of"), F.max("doc_id").alias("last"))
            alone = once.filter("of = last").groupBy(F.col("of").alias("rep")).agg(F.count("*").alias("alone"))
            known = materialize(left.mapInArrow(_bitmaps(k), "rep long, bits array<long>, extra long").join(alone, "rep", "left").fillna(0, ["alone"]), "own-shingles")
            # a text that shares too little with all others together links with none
            able = rest.join(known, "rep").filter(f"100 * (n - alone) >= {share} * n").select("bucket", "rep", "label", "n", (F.col("n") - F.col("alone")).alias("most"), "bits", "extra")
            a, b = (able.select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in ("label", "n", "most", "bits", "extra")], F.col("rep").alias(s)) for s in "ab")
            needed = f"{share} * (n_a + n_b)"
            same_bits = "aggregate(zip_with(bits_a, bits_b, (x, y) -> bit_count(x & y)), 0, (s, x) -> s + x)"
            across = a.join(b, "bucket").filter(
                f"a < b and label_a <> label_b and {100 + share} * least(most_a, most_b) >= {needed} "
                f"and {100 + share} * ({same_bits} + least(extra_a, extra_b)) >= {needed}"
            ).select("a", "b", "n_a", "n_b")
        pairs = untried(across, tried)
        found = materialize(confirmed(pairs), "links")
        tried = tried.unionByName(pairs)
        if not found.isEmpty():
            links = links.unionByName(found)
            groups = components(links)

    node = sig.select("doc_id", "n_shingles", "s1", "s2").join(sets.select("s1", "s2", "rep"), ["s1", "s2"], "left")
    group = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("label", "rep")).otherwise(F.col("doc_id"))
    return node.join(groups.select(F.col("id").alias("rep"), "label"), "rep", "left").select(
        "doc_id", "n_shingles", group.alias("component_id"), F.coalesce(group == F.col("doc_id"), F.lit(True)).alias("kept")
    )
