"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters: each one of the trusted text is a symbol of its own, one more stands for those that it has
not. Characters beyond the ``SINGLE`` most frequent are written as two symbols, so that an n-gram of ``ORDER`` symbols is
one number of 64 bits whatever the alphabet. Counts are sharded by n-gram; lower orders count the distinct left neighbours; discounts come from the
counts of counts of each order; a join with the totals of the context and one with the next lower order give the
interpolated probability of every n-gram seen. The n-grams seen and the weight of each context go to the tasks, which
score all documents in one narrow pass; a model of more than ``MODEL`` rows is joined with the n-grams of the documents.

A document is judged by its mean log probability, drawn towards the median of its language as if ``PRIOR`` more
symbols of median text stood in it, so that short texts do not fail by chance. The thresholds are the quartiles of trusted text
in each language, extended by ``FENCE`` interquartile ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.session import materialize
from shelfmark.functions.sizing import broadcast_if_bounded
from shelfmark.llm import textkit

#: Symbols of an n-gram and the least number of different ones.
ORDER, SYMBOLS = 4, 64
#: Characters that are one symbol each, and how many of the others share the first of their two.
SINGLE, TRAILS = 50_000, 1024
#: Trusted ids that travel to the tasks, more of them are joined by a shuffle; and the same for rows of the model.
TRAVEL, MODEL = 2_000_000, 1 << 22
PRIOR, FENCE = 500, 4.0
LEAD = "\n" * (ORDER - 1)
#: Lower probabilities count as this.
LEAST = 1e-12


def base_of(alphabet: list[str]) -> int:
    """How many different symbols there are, at least ``SYMBOLS``."""
    return max(SYMBOLS, 1 + min(len(alphabet), SINGLE) + -(-max(0, len(alphabet) - SINGLE) // TRAILS))


def gram_type(base: int) -> type:
    return np.int32 if base**ORDER <= 1 << 31 else np.int64


def symbols_of(texts: list[str], table: np.ndarray, lead: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts in a row, each led by ``lead``, and where each begins (its lead included)."""
    points = np.frombuffer("".join([lead + t for t in texts]).encode("utf-32-le", "surrogatepass"), "<u4")
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(lead) for t in texts], out=first[1:])
    symbols = table[points]
    pairs = np.flatnonzero(symbols < 0)
    if len(pairs):
        rest = -1 - symbols[pairs]
        first += np.searchsorted(pairs, first)
        symbols = np.repeat(symbols, 1 + (symbols < 0))
        pairs += np.arange(len(pairs))
        symbols[pairs], symbols[pairs + 1] = SINGLE + 1 + rest // TRAILS, 1 + rest % TRAILS
    return symbols, first


def symbol_table(alphabet: list[str]) -> np.ndarray:
    """Symbol of each code point: 1.. for the alphabet, 0 for all others; below 0 for a character that takes two."""
    table = np.zeros(0x110000, np.int32)
    points = np.array([ord(c) for c in alphabet], np.int64)
    table[points[:SINGLE]] = 1 + np.arange(len(points[:SINGLE]))
    table[points[SINGLE:]] = -1 - np.arange(len(points[SINGLE:]))
    return table


def grams_of(symbols: np.ndarray, first: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``ORDER``-grams that end in each symbol behind a lead of ``ORDER - 1``, and where each text's begin."""
    g = np.zeros(max(0, len(symbols) - ORDER + 1), gram_type(base))
    for i in range(ORDER):
        g *= base
        g += symbols[i : i + len(g)]
    sizes = np.diff(first) - (ORDER - 1)
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    where = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], sizes)
    return g[where], at


def characters(texts: DataFrame, most: int | None = None) -> list[str]:
    """All characters of the column ``text``, no more than there are code points, or the ``most`` most frequent ones.

    That of the lead comes first if they are all, the others by frequency.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text"):
            points = np.frombuffer("".join(batch.column("text").fill_null("").to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
            values, counts = np.unique(points, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int32)), pa.array(counts)], ["point", "n"])

    found = texts.select("text").mapInArrow(count, "point int, n long").groupBy("point").agg(F.sum("n").alias("n"))
    ranked = found.orderBy(F.col("point") != ord(LEAD[0]), F.col("n").desc(), "point") if most is None else found.orderBy(F.col("n").desc(), "point").limit(most)
    return [chr(c) for c in ranked.select("point").toArrow().column("point").to_pylist()]


def gram_counts(texts: DataFrame, alphabet: list[str], lead: str) -> DataFrame:
    """``gram, c``: how often each n-gram of ``ORDER`` symbols occurs in the column ``text``."""
    base = base_of(alphabet)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table(alphabet)
        for batch in textkit.pieces(batches, "text", 4 * textkit.PIECE):
            grams, _ = grams_of(*symbols_of(batch.column("text").fill_null("").to_pylist(), table, lead), base)
            values, counts = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(counts)], ["gram", "c"])

    return texts.select("text").mapInArrow(count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``wanted`` stands in the sorted ``keys``, and whether it does."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    """``seen[k]``: n-grams of ``k + 1`` symbols and their probabilities; ``weight[k]``: contexts of ``k`` symbols and their weight for the lower order.

    Both are sorted arrays, or tables if there are more than ``MODEL`` rows.
    """

    def __init__(self, seen: list, weight: list, base: int = SYMBOLS):
        self.seen, self.weight, self.base = seen, weight, base

    def dense(self) -> np.ndarray:
        """log10 probability of every n-gram of ``ORDER`` symbols; for small alphabets."""
        p = np.full(1, 1 / self.base, np.float32)
        for k in range(ORDER):
            factor = np.ones(self.base**k, np.float32)
            contexts, weights = self.weight[k]
            factor[contexts] = weights
            lower = p if k == 0 else p.reshape(-1, self.base)
            p = (factor.reshape(self.base if k else 1, -1, 1) * (lower if k else np.full(self.base, p[0], np.float32))).astype(np.float32).reshape(-1)
            grams, probabilities = self.seen[k]
            p[grams] = probabilities
        return np.log10(np.maximum(p, np.float32(LEAST), out=p), out=p)

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each of ``grams``."""
        p, left = np.ones(len(grams)), np.arange(len(grams))
        for k in range(ORDER - 1, -1, -1):
            # those without a longer n-gram
            g = grams if k == ORDER - 1 else grams[left] % self.base ** (k + 1)
            at, hit = _find(self.seen[k][0], g)
            p[left[hit]] *= self.seen[k][1][at[hit]]
            left, g = left[~hit], g[~hit]
            at, hit = _find(self.weight[k][0], g // self.base)
            p[left[hit]] *= self.weight[k][1][at[hit]]
        p[left] /= self.base
        return np.log10(np.maximum(p, LEAST))


def train(counts: DataFrame, base: int = SYMBOLS) -> Model:
    """Interpolated modified Kneser-Ney from ``gram, c`` of the highest order, over ``base`` symbols."""
    tables = [materialize(counts, "grams")]
    for k in range(ORDER - 1, 0, -1):
        tables.insert(0, materialize(tables[0].groupBy((F.col("gram") % base**k).alias("gram")).agg(F.count("*").alias("c")), "grams"))
    lower: DataFrame | None = None
    seen, weight = [], []
    for table in tables:
        n = table.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)]).first()
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
        discounts = [0.0, *[min(float(i), max(0.0, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] else 0.0 for i in (1, 2, 3)]]
        cut = F.element_at(F.array(*map(F.lit, discounts)), F.least("c", F.lit(3)).cast("int") + 1)
        staged = table.withColumns({"context": F.expr(f"gram div {base}"), "cut": cut})
        contexts = materialize(staged.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("weight")), "contexts")
        joined = staged.join(contexts, "context")
        if lower is None:
            below = F.lit(1 / base)
        else:
            suffix = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            joined = joined.join(suffix, F.col("gram") % base ** len(seen) == F.col("suffix"))
            below = F.col("below")
        lower = materialize(joined.select("gram", ((F.col("c") - F.col("cut")) / F.col("total") + F.col("weight") * below).alias("p")), "model")
        seen.append(lower)
        weight.append(contexts)
    if sum(table.count() for table in tables) > MODEL:
        return Model(seen, weight, base)
    kind = gram_type(base)
    return Model([_columns(t, "gram", "p", kind) for t in seen], [_columns(t, "context", "weight", kind) for t in weight], base)


def _columns(table: DataFrame, key: str, value: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """A model table, at most ``MODEL`` rows, sorted by key."""
    got = table.select(key, value).toArrow()
    keys, values = got.column(key).to_numpy().astype(kind), got.column(value).to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def fit(texts: DataFrame, most: int | None = SYMBOLS - 1) -> tuple[list[str], Model]:
    """Alphabet and model of every row of the column ``text``; beyond the ``most`` most frequent characters (None: never) all are one symbol."""
    alphabet = characters(texts, most)
    return alphabet, train(gram_counts(texts, alphabet, LEAD), base_of(alphabet))


def score(docs: DataFrame, alphabet: list[str], model: Model, text: str = "text") -> DataFrame:
    """``doc_id, lang, n_symbols, log_prob`` (log10) for every row."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col(text).alias("text"))
    if isinstance(model.seen[0], DataFrame):
        return _score_by_joins(narrow, alphabet, model)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = symbol_table(alphabet), shipped.value
        for batch in textkit.pieces(batches, "text"):
            grams, at = grams_of(*symbols_of(batch.column("text").fill_null("").to_pylist(), table, LEAD), known.base)
            sums = np.zeros(len(grams) + 1)
            np.cumsum(known.log_p(grams), out=sums[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array(np.diff(at)), pa.array(sums[at[1:]] - sums[at[:-1]])],
                ["doc_id", "lang", "n_symbols", "log_prob"],
            )

    return narrow.mapInArrow(run, "doc_id long, lang string, n_symbols long, log_prob double")


def _score_by_joins(docs: DataFrame, alphabet: list[str], model: Model) -> DataFrame:
    """The same for a model that does not travel: the n-grams of each row are joined with it, order by order."""
    base = model.base

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table(alphabet)
        for batch in textkit.pieces(batches, "text"):
            grams, at = grams_of(*symbols_of(batch.column("text").fill_null("").to_pylist(), table, LEAD), base)
            found = [np.unique(grams[a:b], return_counts=True) for a, b in zip(at, at[1:])]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(values) for values, _ in found])]), pa.int32())
            values, counts = (pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", "lang")), pa.array(np.diff(at)),
                 pa.ListArray.from_arrays(offsets, values), pa.ListArray.from_arrays(offsets, counts)],
                ["row", "doc_id", "lang", "n_symbols", "grams", "counts"],
            )

    rows = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        count, "row long, doc_id long, lang string, n_symbols long, grams array<long>, counts array<long>"
    )
    rows = materialize(rows, "row-grams")
    left = rows.select("row", F.explode(F.arrays_zip("grams", "counts")).alias("g")).select(
        "row", F.col("g.grams").alias("gram"), F.col("g.counts").alias("n"), F.lit(1.0).alias("factor")
    )
    parts = []
    for k in range(ORDER - 1, -1, -1):
        met = materialize(left.join(model.seen[k].select("gram", "p"), "gram", "left"), "met-grams")
        parts.append(met.filter(F.col("p").isNotNull()).select("row", "n", (F.col("factor") * F.col("p")).alias("p")))
        back = met.filter(F.col("p").isNull()).withColumn("context", F.expr(f"gram div {base}"))
        back = back.join(model.weight[k].select("context", "weight"), "context", "left")
        left = back.select("row", (F.col("gram") % base**k).alias("gram"), "n", (F.col("factor") * F.coalesce("weight", F.lit(1.0))).alias("factor"))
    parts.append(left.select("row", "n", (F.col("factor") / base).alias("p")))
    summed = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.sum(F.col("n") * F.log10(F.greatest("p", F.lit(LEAST)))).alias("log_prob"))
    return rows.select("row", "doc_id", "lang", "n_symbols").join(summed, "row", "left").select(
        "doc_id", "lang", "n_symbols", F.coalesce("log_prob", F.lit(0.0)).alias("log_prob")
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that some label calls good and none bad, in ``trusted``."""
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("trusted")).agg(F.min("quality").alias("q")).filter("q = 1").select("trusted")


def quality(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, lang, n_symbols, log_prob, perplexity, smoothed, low, high, kept`` for every row of ``docs``.

    ``perplexity`` is per character; ``smoothed`` is the mean log10 surprise with ``PRIOR`` symbols at the median
    of the language, and ``kept`` tells whether it lies between the fences ``low`` and ``high``. Trusted documents are
    those labelled ``quality`` 1; the model and the fences learn from all of them and from every character. A language without trusted documents (or null) takes the fences of all trusted documents; without any
    trusted document nothing is rejected. Null and empty texts have perplexity 1 and are kept. Repeated rows and ids are
    scored each; an empty table gives an empty table; extra columns are ignored.
    """
    trusted = materialize(trusted_ids(labels), "trusted")
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = bare.join(broadcast_if_bounded(trusted, TRAVEL), F.col("doc_id") == F.col("trusted")).select("text")
    # read twice, for the alphabet and for the counts
    alphabet, model = fit(materialize(texts, "trusted-texts"), None)
    scored = materialize(score(docs, alphabet, model, text), "scores")
    surprise = -F.col("log_prob") / F.greatest("n_symbols", F.lit(1))
    good = scored.join(trusted, F.col("doc_id") == F.col("trusted"), "left_semi").filter("n_symbols > 0").withColumn("s", surprise)
    fences = [F.percentile_approx("s", p, 10_000).alias(n) for n, p in (("q1", 0.25), ("mid", 0.5), ("q3", 0.75))]
    by_lang = good.filter("lang is not null").groupBy(F.col("lang").alias("of")).agg(*fences)
    overall = good.agg(*[c.alias(f"all_{n}") for c, n in zip(fences, ("q1", "mid", "q3"))])
    judged = scored.join(by_lang, F.col("lang") == F.col("of"), "left").join(F.broadcast(overall), F.lit(True))
    judged = judged.select(*scored.columns, *[F.coalesce(n, f"all_{n}").alias(n) for n in ("q1", "mid", "q3")])
    smoothed = (-F.col("log_prob") + PRIOR * F.col("mid")) / (F.col("n_symbols") + PRIOR)
    width = FENCE * (F.col("q3") - F.col("q1"))
    return judged.withColumns({"smoothed": smoothed, "low": F.col("q1") - width, "high": F.col("q3") + width}).select(
        "doc_id", "lang", "n_symbols", "log_prob", F.pow(F.lit(10.0), surprise).alias("perplexity"), "smoothed", "low", "high",
        F.coalesce(F.col("smoothed").between(F.col("low"), F.col("high")), F.lit(True)).alias("kept"),
    )
