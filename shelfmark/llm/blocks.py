"""Rows of a group that must meet each other, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.sizing import broadcast_if_bounded


def paired(rows: DataFrame, keys: Sequence[str], most: int, by: Column) -> DataFrame:
    """Add ``i, j, side`` so that any two rows of a group ``keys`` share one block ``(keys, i, j)`` of about ``2 * most`` rows.

    A group of at most ``most`` rows is the block (0, 0). A larger one is cut into slices by the hash of ``by``, and
    every pair of slices is a block; in a block of two slices ``side`` tells them apart, and only pairs of different
    sides are new there. ``keys`` hold no nulls.
    """
    large = rows.groupBy(*keys).count().filter(F.col("count") > most)
    cut = large.select(*keys, F.ceil(F.col("count") / most).cast("int").alias("_slices"))
    dealt = rows.join(broadcast_if_bounded(cut), list(keys), "left").withColumns(
        {"_slices": F.coalesce("_slices", F.lit(1)), "_own": F.pmod(F.xxhash64(by), F.coalesce("_slices", F.lit(1))).cast("int")}
    )
    spread = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    return spread.select(
        *rows.columns, F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"),
        (F.col("_own") > F.col("_other")).cast("int").alias("side"),
    )
