"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

* Two words one edit apart share the first half or the last half of the shorter one, so each word goes to the lists of
  its halves (for its own length and as the longer partner of a word one shorter). A list holds what is left of the
  words beside the shared half, sorted; from the end of the word on where the last half is shared.
* In a sorted list the words that share a prefix stand together. For all words of the list at once, the rows of the
  edit matrix (banded: three cells for one edit) go down the prefixes: the row of a prefix is worked out once and
  reused by every word that has it, which is what the length of the common prefix with the neighbour says, and a range
  whose prefix is already more than one edit away is left out whole.
* Lists over ``LIST`` words are cut into slices that meet in blocks, so a common half is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import groups
from shelfmark.functions.session import materialize
from shelfmark.llm import blocks

LIST = 1 << 13
#: Words whose matrix rows go down together.
TOGETHER = 1 << 13
FAR = np.uint8(2)
KEYS = ["code", "key", "i", "j"]
PAIRS = "a string, n_a long, b string, n_b long"

# The letters of a word, and the capitals that are lower-cased.
RUNS = r"[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, every: int | None = None, least_length: int = 6, least_count: int = 5, text: str = "text") -> DataFrame:
    """``word, n``: how often each run of letters occurs in the texts, A-Z as a-z.

    With ``every`` a slip is planted: where the CRC-32 of ``doc_id:run`` is a multiple of it, the run loses the code
    point at that CRC modulo its length. A null text has no words, a null ``doc_id`` counts as empty; words below
    ``least_length`` code points or ``least_count`` occurrences are left out.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUNS), F.lit(0))).alias("run"),
    ).filter(F.length("run") >= least_length)
    word = F.col("run")
    if every:
        hashed = runs.withColumn("h", F.crc32(F.concat_ws(":", "doc", "run")))
        at = (F.col("h") % F.length("run")).cast("int")
        slip = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
        runs, word = hashed, F.when(F.col("h") % every == 0, slip).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _lists(vocabulary: DataFrame) -> DataFrame:
    """``code, key, rest, n``: each word in its four lists; ``code`` is twice the shorter length, plus 1 for last halves."""
    length = F.length("word")
    rows = []
    for shorter in (length, length - 1):
        half = F.floor(shorter / 2).cast("int")
        tail = shorter - half
        rows += [
            F.struct((shorter * 2).alias("code"), F.col("word").substr(F.lit(1), half).alias("key"), F.col("word").substr(half + 1, length).alias("rest")),
            F.struct(
                (shorter * 2 + 1).alias("code"), F.col("word").substr(length - tail + 1, tail).alias("key"),
                F.reverse(F.col("word").substr(F.lit(1), length - tail)).alias("rest"),
            ),
        ]
    return vocabulary.select("n", F.explode(F.array(*rows)).alias("_l")).select("_l.*", "n")


def near_in_lists(rest: list[str], first: np.ndarray, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(q, row)`` of one edit between a row of ``asking`` and any row of the same list.

    ``rest`` holds sorted lists one after the other, ``first`` where each begins. A text must not hold U+0000.
    """
    n = len(rest)
    width = max(map(len, rest)) + 1
    # one code point a cell; past the end 0, and two cells more than any word has
    chars = np.array(rest, f"U{width}").view(np.uint32).reshape(n, width)
    chars = np.concatenate([chars, np.zeros((n, 2), np.uint32)], axis=1)
    lengths = np.array([len(r) for r in rest])
    differs = chars[1:] != chars[:-1]
    common = np.concatenate([[0], np.where(differs.any(axis=1), differs.argmax(axis=1), width)])
    common[first] = -1
    none = np.zeros(0, np.int64)
    found_q, found_row = [none], [none]
    for begin in range(0, len(asking), TOGETHER):
        q = asking[begin : begin + TOGETHER]
        starts = first
        node = np.searchsorted(starts, q, "right") - 1
        low, mid, high = np.full(len(q), FAR), np.zeros(len(q), np.uint8), np.ones(len(q), np.uint8)
        for depth in range(width + 1):
            if len(q) == 0:
                break
            below = np.flatnonzero(common <= depth)  # ranges of one more code point
            child_of = np.searchsorted(below, np.append(starts, n))
            many = (child_of[1:] - child_of[:-1])[node]
            at = np.repeat(np.arange(len(q)), many)
            inside = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            node = child_of[node[at]] + inside
            q, low, mid, high = q[at], low[at], mid[at], high[at]
            v = chars[below[node], depth]
            ended = v == 0
            # a word that ends here: its cell of the whole asking word, if that is in the band
            gap = lengths[q] - depth
            cost = np.select([gap == -1, gap == 0, gap == 1], [low, mid, high], FAR)
            hit = ended & (cost == 1)
            found_q.append(q[hit])
            found_row.append(below[node[hit]])
            before = chars[q, depth - 1] if depth else np.zeros(len(q), np.uint32)
            new_low = np.minimum(low + (v != before), mid + 1)
            new_mid = np.minimum(np.minimum(mid + (v != chars[q, depth]), high + 1), new_low + 1)
            new_high = np.minimum(high + (v != chars[q, np.minimum(depth + 1, width + 1)]), new_mid + 1)
            going = ~ended & (np.minimum(np.minimum(new_low, new_mid), new_high) <= 1)
            q, node = q[going], node[going]
            low, mid, high = (np.minimum(c[going], FAR).astype(np.uint8) for c in (new_low, new_mid, new_high))
            starts = below
    return np.concatenate(found_q), np.concatenate(found_row)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in groups.whole_groups(batches, KEYS):
        rest, key = table.column("rest").to_pylist(), table.column("key").to_pylist()
        code, n, i, j, side = (table.column(c).to_numpy() for c in ("code", "n", "i", "j", "side"))
        own = np.array([len(r) + len(k) for r, k in zip(rest, key)]) == code // 2
        a, b = near_in_lists(rest, groups.changes(table, KEYS), np.flatnonzero(own))
        # two words of the list's length find each other; words of different slices meet in one block only
        keep = (~own[b] | (a < b)) & ((i[a] == j[a]) | (side[a] != side[b]))
        a, b = a[keep], b[keep]
        # what the list of first halves has as well: the longer word has one more code point next to the shared half
        twice = np.array([code[x] % 2 == 1 and rest[x] == rest[y][1:] for x, y in zip(a, b)], bool)
        a, b = a[~twice], b[~twice]

        def words(rows):
            return pa.array([rest[r][::-1] + key[r] if code[r] % 2 else key[r] + rest[r] for r in rows], pa.string())

        yield pa.RecordBatch.from_arrays([words(a), pa.array(n[a]), words(b), pa.array(n[b])], ["a", "n_a", "b", "n_b"])


def near_words(vocabulary: DataFrame, most: int = LIST) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of words of ``vocabulary(word, n)`` one edit apart, once. Words are distinct, not null and not empty."""
    lists = blocks.paired(_lists(vocabulary), ["code", "key"], most, F.col("rest"))
    return lists.repartition(*KEYS).sortWithinPartitions(*KEYS, "rest").mapInArrow(_near, PAIRS)


def variants(vocabulary: DataFrame, ratio: int = 5, most: int = LIST) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``vocabulary(word, n)``.

    ``form`` is the commonest near word (ties: least in code points) if it occurs at least ``ratio`` times as often;
    ``root`` follows the forms to the last. Counts grow along the way for ``ratio`` above 1, so it ends. An empty
    vocabulary gives an empty table.
    """
    words = materialize(vocabulary.select("word", "n"), "words")
    pairs = materialize(near_words(words, most), "near-words")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))
    )
    best = sides.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min_by(F.struct("other", "m"), F.struct((-F.col("m")).alias("x"), "other")).alias("best")
    )
    strong = F.col("best.m") >= ratio * F.col("n")
    formed = materialize(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("best.other")).alias("form"), F.when(strong, F.col("best.m")).alias("form_n"),
        ),
        "forms",
    )
    # each turn doubles the way that a pointer covers
    jumps = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumps = materialize(jumps.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if jumps.filter("moved").isEmpty():
            break
        jumps = jumps.drop("moved")
    return formed.join(jumps.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
