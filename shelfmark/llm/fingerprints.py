"""Document fingerprints by consistent weighted sampling, DataFrame functions only.

The terms of a text are its words, weighted by how often they occur. For sample ``k`` every term draws, from hashes
of the term and ``k``, ``r`` and ``c`` from Gamma(2, 1) and ``b`` from [0, 1). With ``t = floor(ln(weight) / r + b)``
the term's value is ``ln c - r * (t - b + 1)``, and the sample is the pair (term, t) of least value. Two texts
agree in a sample with probability sum(min) / sum(max) of their weights, the generalised Jaccard similarity.

Words are counted inside the row (hash, sort, run lengths), so nothing is shuffled per word: the minima of a text are
taken in the task that reads it, and one short row per text goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.session import materialize
from shelfmark.llm.ordered import following

#: Samples are drawn in groups, so that generated code stays small.
GROUP = 4
SPACES = r"[\x20\x09-\x0D]+"
_NONE = (1 << 62) - 1


def _terms(text: Column) -> Column:
    """Array of (hash, weight) of the distinct words of a text."""
    return F.transform(F.array_remove(F.split(text, SPACES), ""), lambda w: F.xxhash64(w))


def _runs(name: str) -> Column:
    """Run lengths of a sorted array column as an array of structs ``h, w``."""
    at = F.filter(
        F.sequence(F.lit(0), F.size(name) - 1), lambda i: (i == 0) | (F.get(F.col(name), i) != F.get(F.col(name), i - 1))
    )
    starts = F.when(F.size(name) > 0, at).otherwise(F.array().cast("array<int>"))
    return F.arrays_zip(F.array_distinct(name).alias("h"), starts.alias("from"), F.concat(F.slice(starts, 2, F.greatest(F.size(name), F.lit(1))), F.array(F.size(name))).alias("to"))


def _unit(x: Column, shift: int, bits: int) -> Column:
    """``bits`` bits of a long as a number inside (0, 1)."""
    return (F.shiftrightunsigned(x, shift).bitwiseAND((1 << bits) - 1) + F.lit(0.5)) / F.lit(float(1 << bits))


def samples(bags: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``keys, samples``: for each text the array of its ``n`` samples, from its words in array column ``words``.

    Two 64-bit hashes give a term its draws for a sample: twice 21 bits for ``r`` and 22 for ``b``, twice 31 for ``c``. Each sample is ``value << 31 | id``: the smallest wins, and the low 31 bits
    tell which term and ``t`` it was.
    """
    rows = bags.select(*keys, F.sort_array("words").alias("words")).select(*keys, F.explode_outer(_runs("words")).alias("run"))
    rows = rows.select(*keys, F.col("run.h").alias("h"), F.log((F.col("run.to") - F.col("run.from")).cast("double")).alias("lw"))
    rows = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n // GROUP - 1))))
    each = range(GROUP)
    rows = rows.select(*keys, "g", "h", "lw", *[F.xxhash64("h", F.col("g") * (2 * GROUP) + i).alias(f"x{i}") for i in range(2 * GROUP)])
    rows = rows.select(*keys, "g", "h", "lw", *[c for i in each for c in (
        (-F.log(_unit(F.col(f"x{2 * i}"), 43, 21) * _unit(F.col(f"x{2 * i}"), 22, 21))).alias(f"r{i}"),
        _unit(F.col(f"x{2 * i}"), 0, 22).alias(f"b{i}"),
        F.log(-F.log(_unit(F.col(f"x{2 * i + 1}"), 32, 31) * _unit(F.col(f"x{2 * i + 1}"), 0, 31))).alias(f"c{i}"),
    )])
    rows = rows.select(*keys, "g", "h", *[c for i in each for c in (
        F.floor(F.col("lw") / F.col(f"r{i}") + F.col(f"b{i}")).alias(f"t{i}"), f"r{i}", f"b{i}", f"c{i}"
    )])

    def packed(i: int) -> Column:
        value = F.col(f"c{i}") - F.col(f"r{i}") * (F.col(f"t{i}") - F.col(f"b{i}") + 1) + 64
        identity = F.col("h").bitwiseXOR(F.col(f"t{i}") * 1000003).bitwiseAND(0x7FFFFFFF)
        return F.shiftleft((value * float(1 << 24)).cast("long"), 31).bitwiseOR(identity)

    least = rows.groupBy(*keys, "g").agg(*[F.min(packed(i)).alias(f"m{i}") for i in each])
    part = F.struct("g", F.array(*[F.coalesce(f"m{i}", F.lit(_NONE)) for i in each]).alias("m"))
    return least.groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["m"])).alias("samples"))


def likeness(a: Column, b: Column, n: int) -> Column:
    """Share of equal samples of two fingerprints of ``n`` samples (four hex digits a sample)."""
    starts = F.array(*[F.lit(4 * i + 1) for i in range(n)])
    return F.size(F.filter(starts, lambda i: F.substring(a, i, F.lit(4)) == F.substring(b, i, F.lit(4)))) / F.lit(float(n))


def fingerprints(docs: DataFrame, n: int = 32, text: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row.

    The edited text has its last ``floor(n_chars / 4)`` code points replaced by the first as many of the next
    document's, in ascending ``doc_id`` (after the last: the first). Null texts are empty; a text without words has
    the fingerprint ``ffff...``. If ids repeat, the smallest text of the next id lends its start, ``near_next`` is
    the largest likeness to any of its texts, and each repeated row has its own result. A null ``doc_id`` has no
    next document: nothing is put in and ``near_next`` is null. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sized = texts.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("own"))
    rows = materialize(sized, "sizes")
    follows = materialize(following(rows), "following")
    # A key that is never null: no join filters the texts, so they are shuffled by it once and both joins read that.
    spelt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    by_key = texts.select(spelt("doc_id").alias("key"), "text")
    # what each next document must lend, at most: the longest quarter among the rows before it
    wanted = rows.groupBy("doc_id").agg(F.max(F.expr("n_chars div 4")).alias("lent")).join(follows, "doc_id")
    wanted = wanted.select(spelt("next_id").alias("key"), spelt("doc_id").alias("before"), "lent")
    heads = by_key.join(wanted, "key").groupBy(F.col("before").alias("key")).agg(F.min(F.expr("left(text, lent)")).alias("head"))
    joined = by_key.join(heads, "key", "left")
    quarter = F.expr("char_length(text) div 4")
    edited = F.concat(
        F.expr("left(text, char_length(text) - char_length(text) div 4)"), F.substring(F.coalesce("head", F.lit("")), F.lit(1), quarter)
    )
    staged = joined.select("key", F.xxhash64("text").alias("own"), "text", edited.alias("edited"))
    bodies = staged.select("key", "own", F.explode(F.array(
        F.struct(F.lit(False).alias("is_edit"), F.col("text").alias("body")), F.struct(F.lit(True).alias("is_edit"), F.col("edited").alias("body")),
    )).alias("v"))
    bags = bodies.select("key", "own", "v.is_edit", _terms(F.col("v.body")).alias("words"))
    drawn = samples(bags, ["key", "own", "is_edit"], n)
    digits = lambda m: F.lower(F.lpad(F.hex(m.bitwiseAND(0xFFFF)), 4, "0"))
    spelled = drawn.select("key", "own", "is_edit", F.array_join(F.transform("samples", digits), "").alias("print"))
    by_text = spelled.groupBy("key", "own").agg(
        F.max(F.when(~F.col("is_edit"), F.col("print"))).alias("fingerprint"), F.max(F.when(F.col("is_edit"), F.col("print"))).alias("edited_fingerprint"),
    )
    # both sides read the same shuffled texts
    digests = staged.select("key", "own", F.sha2("edited", 256).alias("edited_sha256")).distinct()
    doc_id = F.nullif("key", F.lit("")).cast("long").alias("doc_id")
    found = digests.join(by_text, ["key", "own"]).select(doc_id, "own", "edited_sha256", "fingerprint", "edited_fingerprint")
    prints = materialize(found, "fingerprints")
    next_prints = follows.join(
        prints.groupBy(F.col("doc_id").alias("next_id")).agg(F.collect_set("fingerprint").alias("nexts")), "next_id"
    ).select("doc_id", "nexts")
    whole = rows.join(prints.withColumnRenamed("doc_id", "of"), (F.col("doc_id").eqNullSafe(F.col("of"))) & (rows["own"] == prints["own"])).drop("of", "own")
    return whole.join(next_prints, "doc_id", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), n).alias("near_edited"),
        F.array_max(F.transform("nexts", lambda p: likeness(F.col("fingerprint"), p, n))).alias("near_next"),
    )
