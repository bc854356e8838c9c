"""Long texts: what stands in memory at once, and what is searched."""

import time

import pandas as pd
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators import embedding


def test_terms_of_a_batch_never_stand_in_memory_together(spark, monkeypatch):
    rows = [(i, " ".join(f"w{j % 17}" for j in range(i % 40))) for i in range(300)] + [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    vectors = df.select("id", embedding.hash_counts(F.col("text")).alias("v"))
    whole = {r.id: r.v for r in vectors.collect()}
    monkeypatch.setattr(embedding, "PIECE_CHARS", 50)
    count = embedding.hash_counts(F.col("text"))
    assert {r.id: r.v for r in df.select("id", count.alias("v")).collect()} == whole
    assert sum(abs(x) for x in whole[1]) == 1 and sum(abs(x) for x in whole[300]) == 0


def test_arrow_batches_are_bounded_by_bytes(spark):
    @F.pandas_udf("long")
    def most(batches: pd.Series) -> pd.Series:
        return pd.Series([len(batches)] * len(batches))

    rows = spark.range(64, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    assert rows.select(F.max(most("t"))).first()[0] <= 16


def test_trimming_equals_the_plain_form(spark):
    texts = ["", None, "  ", " \u3000ab\u00a0", "abcdef", "abcde   ", " abcde  f", "abcd\n ", "ab  \U0001f600  c", "abcde\x1f", "\u0085" * 9 + "x" + " " * 9]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    s = tx.strip(F.coalesce("s", F.lit("")))
    for limit in (0, 2, 3, 5, 6):
        plain = F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, max(limit - 3, 0)), F.lit("...")))
        assert df.filter(~plain.eqNullSafe(tx.trim_three_dots(F.col("s"), limit))).count() == 0


def test_a_long_text_is_trimmed_without_a_search_through_it(spark):
    # white space everywhere: a search for the run at the end takes the square of a run's length
    df = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 60_000), F.lit("b")).alias("s"))
    start = time.time()
    assert df.select(tx.trim_three_dots(F.col("s"), 5)).first()[0] == "a ..."
    assert time.time() - start < 5
