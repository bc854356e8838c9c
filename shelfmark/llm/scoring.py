"""Language-model scoring with a weighted backoff automaton.

States are the words of the training documents and the empty context. From a state ``v`` an arc reads each word that
follows ``v`` at least ``cutoff`` times, at the discounted probability interpolated with that of the empty context; for all other
words a failure arc leads to the empty context at weight ``back(v)``, where every known word has an arc and one more
stands for all unknown words. A traversal from the start state to the end token adds up the log10 weights; the
arcs out of every state sum to one.

The automaton holds the whole training text and is no broadcast: it lies in shards by word and by pair of words. The
traversal of a text takes ``log back(v) + log p(w)`` for every step ``v -> w`` and, where an arc exists, the difference
that the arc makes; so each document sends its distinct words and pairs to their shards once and sums up what comes back.
The commonest words, at most ``HEAD`` of them, travel to the texts and to the pairs instead: what they add to a document
is summed where it is read, so a word of every document is in no one's shard. Words are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.session import discard, materialize
from shelfmark.llm import textkit

#: Pairs of words seen less often in the training documents have no arc of their own; 1 keeps every pair.
CUTOFF = 1
#: Pairs are counted and sent to their shards in so many turns, each a part of the shards, to bound the shuffle on disk.
TURNS = 3
#: Commonest words that travel: 40 bytes each, a few times that in a task.
HEAD = 1 << 17
#: States that are no words.
START, END = (int(x) for x in textkit.mix(np.array([1, 2], np.uint64), 99).view(np.int64))


def _steps(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every step ``v -> w`` of the texts, from the start to the end, and the text it belongs to."""
    w = textkit.words(texts, lower=True)
    n = len(w.first) - 1
    owner = np.repeat(np.arange(n), w.counts + 1)
    last = np.cumsum(w.counts + 1) - 1
    to = np.empty(len(owner), np.int64)
    ends = np.zeros(len(owner), bool)
    ends[last] = True
    to[ends], to[~ends] = END, w.hash.view(np.int64)
    source = np.empty(len(owner), np.int64)
    source[1:] = to[:-1]
    source[last - w.counts] = START
    return source, to, owner


def _distinct(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct combination of the parts first stands, and how often it occurs."""
    key = np.zeros(len(parts[0]), np.uint64)
    for i, part in enumerate(parts):
        key = textkit.mix(key ^ part.view(np.uint64), 60 + i)
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    return at, n


def _rows(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textkit.pieces(batches, "text", 4 * textkit.PIECE):
        words, n = np.unique(_steps(batch.column("text"))[1], return_counts=True)
        yield _rows(["w", "n"], words, n)


def _of_turn(turn: int, *steps: np.ndarray) -> list[np.ndarray]:
    """The steps ``v, w, ...`` whose pair has this turn."""
    mine = ((steps[0] ^ steps[1]) & 0xFFFF) % TURNS == turn
    return [x[mine] for x in steps]


def _pair_counts(turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text", 4 * textkit.PIECE):
            v, w, _ = _of_turn(turn, *_steps(batch.column("text")))
            at, n = _distinct(v, w)
            yield _rows(["v", "w", "n"], v[at], w[at], n)

    return run


def _words_of_rows(head):
    """``row, w, n, ends, known, base, steps``: one row per text for its words in ``head``, summed, and one for each other word.

    The sums of a text have its ``row`` for ``w`` and no ``n``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, base, step = head.value
        for batch in textkit.pieces(batches, "text"):
            _, w, owner = _steps(batch.column("text"))
            texts = batch.num_rows
            at = np.minimum(np.searchsorted(common, w), max(len(common) - 1, 0))
            here = common[at] == w if len(common) else np.zeros(len(w), bool)
            row = np.asarray(batch.column("row"))
            sums = [np.bincount(owner[here], minlength=texts), *[np.bincount(owner[here], x[at[here]], texts) for x in (base, step)]]
            ends = np.bincount(owner[w == END], minlength=texts) if here[w == END].any() else np.zeros(texts, np.int64)
            w, owner = w[~here], owner[~here]
            first, n = _distinct(w, owner)
            tail = len(first)

            def both(of_text, of_word):
                return np.concatenate([of_text, of_word])

            missing = pa.array(both(np.zeros(texts, np.int32), n.astype(np.int32)), mask=both(np.ones(texts, bool), np.zeros(tail, bool)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(both(row, row[owner[first]])), pa.array(both(row, w[first])), missing, pa.array(both(ends, np.zeros(tail, np.int64))),
                    pa.array(both(sums[0], np.zeros(tail, np.int64))), pa.array(both(sums[1], np.zeros(tail))), pa.array(both(sums[2], np.zeros(tail))),
                ],
                ["row", "w", "n", "ends", "known", "base", "steps"],
            )

    return run


def _pairs_of_rows(turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text"):
            v, w, owner = _of_turn(turn, *_steps(batch.column("text")))
            at, n = _distinct(v, w, owner)
            yield _rows(["row", "pair", "n"], np.asarray(batch.column("row"))[owner[at]], _pair(v[at], w[at]), n.astype(np.int32))

    return run


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return textkit.mix(textkit.mix(v.view(np.uint64), 61) ^ w.view(np.uint64), 62).view(np.int64)


def _named_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v, w, gain = (np.asarray(batch.column(c)) for c in ("v", "w", "gain"))
        yield _rows(["pair", "gain"], _pair(v, w), gain)


def _least_count(words: DataFrame, most: int) -> int:
    """The least count of the commonest words of which there are at most ``most``."""
    steps = words.groupBy(F.floor(F.log2("c") * 8).alias("step")).agg(F.count("*").alias("words"), F.min("c").alias("c")).orderBy(F.col("step").desc())
    least, total = 1 << 62, 0
    for _, n, c in steps.collect():  # a few hundred steps
        total += n
        if total > most:
            break
        least = c
    return least


def log_probabilities(docs: DataFrame, text: str = "text", cutoff: int = CUTOFF) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Tokens are the words (A-Z as a-z) and one end. Rows with ``crc32(doc_id as text) mod 10 = 0`` are held out, and those
    without an id; all others are learnt from. ``score`` is the log10 probability of the tokens under the automaton,
    ``base_score`` under add-0.1 counts; both spread one unit over the known tokens and one token for the unknown. Null
    and empty texts have the end as their only token. Repeated rows are learnt from and scored each. Without training
    rows every score is the base score; an empty table gives an empty table; other columns are ignored.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    texts = docs.select("doc_id", held_out.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    learnt = texts.filter(~F.col("held_out")).select("text")
    words = materialize(learnt.mapInArrow(_word_counts, "w long, n long").groupBy("w").agg(F.sum("n").alias("c")), "words")
    n, v, once = words.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1)).first()
    n = n or 0
    base = lambda c: F.log10((c + 0.1) / F.lit(n + 0.1 * (v + 1)))
    # words seen once tell how often new ones come: the discounts free just that for the unknown word
    discount = once / v if once else 0.5
    unknown = discount * v / n if n else 1.0
    single = words.select("w", "c", ((F.col("c") - F.lit(discount)) / F.lit(float(max(n, 1)))).alias("p"))

    parts = [
        materialize(learnt.mapInArrow(_pair_counts(turn), "v long, w long, n long").groupBy("v", "w").agg(F.sum("n").alias("c2")).filter(F.col("c2") >= cutoff), "pairs")
        for turn in range(TURNS)
    ]
    pairs = reduce(DataFrame.unionByName, parts)
    spread = pairs.agg(F.count_if(F.col("c2") == cutoff), F.count_if(F.col("c2") == cutoff + 1)).first()
    cut = spread[0] / (spread[0] + 2 * spread[1]) if spread[0] else 0.5
    # every step leaves its state once: the start as often as there are texts, a word as often as it occurs
    leaving = words.select(F.when(F.col("w") == END, F.lit(START)).otherwise(F.col("w")).alias("v"), F.col("c").alias("total"))
    out = pairs.groupBy("v").agg(F.sum(F.col("c2") - F.lit(cut)).alias("held"))
    states = materialize(out.join(leaving, "v").select("v", "total", (1 - F.col("held") / F.col("total")).alias("back")), "states")
    difference = F.log10((F.col("c2") - F.lit(cut)) / F.col("total") / (F.col("back") * F.col("p")) + 1)
    at_start = states.filter(F.col("v") == START).select(F.log10("back").alias("b")).first()
    entry = at_start["b"] if at_start else 0.0
    lexicon = materialize(
        single.join(states.select(F.col("v").alias("w"), "back"), "w", "left")
        .select("w", base(F.col("c")).alias("base"), F.log10("p").alias("log_p"), F.coalesce(F.log10("back"), F.lit(0.0)).alias("log_back")), "lexicon",
    )

    least = _least_count(words, HEAD)
    common = {
        "v": F.broadcast(states.filter(F.col("total") >= least)),
        "w": F.broadcast(single.filter(F.col("c") >= least).select("w", "p")),
    }
    head = lexicon.join(words.filter(F.col("c") >= least).select("w"), "w", "left_semi").select("w", "base", (F.col("log_p") + F.col("log_back")).alias("step")).toPandas().sort_values("w")
    shipped = docs.sparkSession.sparkContext.broadcast(tuple(head[c].to_numpy() for c in ("w", "base", "step")))

    # equal rows share a key; every row has one end, so the ends tell by how many rows the sums are shared
    numbered = texts.withColumn("row", F.xxhash64("doc_id", "text"))
    sent = numbered.select("row", "text")
    new_word = [F.coalesce("word_base", base(F.lit(0))), F.coalesce(F.col("log_p") + F.col("log_back"), F.log10(F.lit(unknown)))]
    gains = []
    for turn, part in enumerate(parts):
        # most pairs are of two common words, whose states travel; the others go to the shards of theirs
        met = part.join(common["v"], "v", "left").join(common["w"], "w", "left")
        whole = F.col("total").isNotNull() & F.col("p").isNotNull()
        other = met.filter(~whole).select("v", "w", "c2").join(states, "v").join(single.select("w", "p"), "w")
        weighed = met.filter(whole).select("v", "w", difference.alias("gain")).unionByName(other.select("v", "w", difference.alias("gain")))
        arcs = materialize(weighed.mapInArrow(_named_arcs, "pair long, gain double"), "arcs")
        discard(part)
        by_pair = sent.mapInArrow(_pairs_of_rows(turn), "row long, pair long, n int")
        met = by_pair.join(arcs.hint("shuffle_hash"), "pair")
        gains.append(materialize(met.groupBy("row").agg(F.sum(F.col("n") * F.col("gain")).alias("gain")), "pair-sums"))
        discard(arcs)
    # the words go last, when the pairs are gone from disk
    tail = F.col("n").isNotNull()
    by_word = sent.mapInArrow(_words_of_rows(shipped), "row long, w long, n int, ends long, known long, base double, steps double").join(
        lexicon.withColumnRenamed("base", "word_base").hint("shuffle_hash"), "w", "left"
    ).select(
        "row", F.when(tail & (F.col("w") == END), F.col("n")).otherwise(F.col("ends")).alias("rows"),
        F.when(tail, F.col("n")).otherwise(F.col("known")).alias("n_tokens"),
        F.when(~tail, F.col("known")).when(F.col("word_base").isNotNull(), F.col("n")).otherwise(0).alias("n_known"),
        F.when(tail, F.col("n") * new_word[0]).otherwise(F.col("base")).alias("base_score"), F.when(tail, F.col("n") * new_word[1]).otherwise(F.col("steps")).alias("steps"),
    )
    word_sums = materialize(by_word.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("rows", "n_tokens", "n_known", "base_score", "steps")]), "word-sums")
    pair_sums = reduce(DataFrame.unionByName, gains).groupBy("row").agg(F.sum("gain").alias("gain"))
    base_score = F.col("base_score") / F.col("rows")
    score = (F.col("steps") + F.coalesce("gain", F.lit(0.0))) / F.col("rows") + F.lit(entry) if n else base_score
    return numbered.select("row", "doc_id", "held_out").join(word_sums, "row").join(pair_sums, "row", "left").select(
        "doc_id", "held_out", F.expr("n_tokens div rows").alias("n_tokens"), F.expr("n_known div rows").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base_score.alias("base_score"), score.alias("score"),
    )
