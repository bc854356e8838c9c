"""Running totals and positions for keys of any size.

``Window.partitionBy(key)`` sends every row of a key to one task. When a single
bucket, thread or file can hold a third of all rows that task never ends. The
functions here cut each key into *slices* along its order (a minute, a block of
turns ...), work inside (key, slice), and carry totals from slice to slice through
a table with one row per slice. The totals are computed with map-side combine, and
only that small table is ever windowed by the bare key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_SLICE = 4096


def turn_slice(turn: Column, size: int = TURN_SLICE) -> Column:
    return F.floor(turn / F.lit(size))


def hash_slice(c: Column, digits: int = 3) -> Column:
    """``16**digits`` even slices for orders where only determinism matters."""
    return F.substring(F.md5(c.cast("string")), 1, digits)


def _same(left: DataFrame, right: DataFrame, names: Sequence[str], prefix: str) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[prefix + n])
    return cond


def join_back(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join on ``keys`` that keeps only one copy of them."""
    renamed = side.select(*[F.col(c).alias("_r_" + c) if c in keys else F.col(c) for c in side.columns])
    return df.join(renamed, _same(df, renamed, keys, "_r_"), how).drop(*["_r_" + k for k in keys])


def running(
    df: DataFrame,
    keys: Sequence[str],
    slice_by: Column,
    order: Sequence[Column],
    totals: dict[str, Column],
    *,
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running sums ``totals`` per ``keys`` in ``order``.

    ``slice_by`` must be monotone in ``order``; with ``descending`` both run backwards
    (``order`` must then already be given as descending expressions).
    """
    keys = list(keys)
    part = [*keys, "_slice"]
    staged = df.withColumns({"_slice": slice_by, **{f"_v_{n}": v for n, v in totals.items()}})
    per_slice = staged.groupBy(*part).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    slices = F.col("_slice").desc() if descending else F.col("_slice").asc()
    before = Window.partitionBy(*keys).orderBy(slices).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *part, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals]
    )
    local = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local_sums = staged.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(local), F.lit(0)) for n in totals})
    return join_back(local_sums, offsets, part).select(
        *df.columns, *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in totals]
    )


def previous(
    df: DataFrame, keys: Sequence[str], slice_by: Column, order: Sequence[str], value: str, out: str
) -> DataFrame:
    """``lag(value)`` per ``keys`` in ascending ``order`` columns, without a whole-key window."""
    keys = list(keys)
    part = [*keys, "_slice"]
    staged = df.withColumn("_slice", slice_by)
    last = staged.groupBy(*part).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    carried = last.select(*part, F.lag("_last").over(across)[value].alias("_carried"))
    local = Window.partitionBy(*part).orderBy(*order)
    local_lag = staged.withColumns(
        {"_first": F.row_number().over(local) == 1, "_lag": F.lag(value).over(local)}
    )
    return join_back(local_lag, carried, part).select(
        *df.columns, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag")).alias(out)
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], *, last: bool = False) -> DataFrame:
    """The row with the smallest (or largest) ``order`` per key, as a combinable aggregate."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    row = F.struct(*rest)
    return df.groupBy(*keys).agg(pick(row, F.struct(*order)).alias("_row")).select(
        *[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns]
    )
