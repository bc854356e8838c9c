"""Places and neighbours in a global order, by binary search among sampled bounds (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def below(value: Column, bounds: Column, steps: int) -> Column:
    """How many of the sorted ``bounds`` (filled up with nulls to ``2**steps - 1``) lie below ``value``."""

    def step(at: Column, power: Column) -> Column:
        probe = F.element_at(bounds, (at + power).cast("int"))
        return F.when(probe < value, at + power).otherwise(at)

    powers = F.array(*[F.lit(1 << i) for i in reversed(range(steps))])
    return F.aggregate(powers, F.lit(0), step)


def filled(values: list[int]) -> tuple[Column, int]:
    """A literal array for :func:`below`, and its number of steps."""
    steps = max(1, len(values).bit_length())
    cells = [*values, *[None] * ((1 << steps) - 1 - len(values))]
    text = "[" + ",".join("null" if v is None else str(v) for v in cells) + "]"
    return F.from_json(F.lit(text), "array<bigint>"), steps


def following(ids: DataFrame, ranges: int = 512) -> DataFrame:
    """``doc_id, next_id`` for every distinct non-null ``doc_id``: the next larger one, the first after the last.

    The ids are cut into ranges at approximate quantiles; each range looks up its neighbours alone, and only the
    smallest id of each range is seen by one task.
    """
    known = ids.filter("doc_id is not null").select("doc_id").distinct()
    bounds = known.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)])).first()[0]
    if bounds is None:
        return known.withColumn("next_id", F.col("doc_id"))
    array, steps = filled(sorted(set(bounds)))
    cut = known.withColumn("range", below(F.col("doc_id"), array, steps))
    firsts = cut.groupBy("range").agg(F.min("doc_id").alias("first"))
    order = Window.partitionBy(F.lit(0)).orderBy("range")
    after = firsts.select("range", F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy(F.lit(0)))).alias("after"))
    inside = Window.partitionBy("range").orderBy("doc_id")
    return cut.withColumn("inner", F.lead("doc_id").over(inside)).join(F.broadcast(after), "range").select(
        "doc_id", F.coalesce("inner", "after").alias("next_id")
    )
