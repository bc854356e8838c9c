"""Exact nearest neighbours as a join of two partitioned tables.

Corpus vectors belong to the nearest of a bounded set of pivots; a cell is cut along the angle to its pivot into slices
of bounded size, each with its least and largest angle. Questions go to slices, slices and their questions meet in a
cogroup, and nothing but pivots passes the driver.

Angles obey the triangle inequality, which rules slices out without a comparison. A first turn asks only the slice
of the home cell that lies nearest; it gives every question a k-th best score. The second turn asks those slices of any
cell in which an angle up to that score is possible:

* a member's angle to its pivot differs from the question's by no more than the angle between the two, so the slice's
  least and largest angle must come that near, and
* a member is at least as near to its own pivot as to the question's, so half the difference of the question's angles
  to the two pivots is no more than the angle between the two.

Slices next to each other in a cell are a region, and regions of neighbouring cells travel together as a unit, so that vectors are sent
once for many comparisons: a question goes once to a unit and names its regions there. A
unit that very many questions ask is sent to several tasks with a share of them each. With a score to beat, only pairs
that reach it are looked at further.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.session import materialize
from shelfmark.functions.sizing import broadcast_if_bounded

#: Rows of a slice, of a region of slices and of a unit of regions, questions that meet a unit in one task, corpus rows per pivot, and the most pivots.
SLICE, REGION, UNIT, ASKED, PER_PIVOT, MAX_PIVOTS = 4096, 8192, 65536, 65536, 8192, 4096
#: Scores that stand in memory at once.
SCORES = 1 << 22
#: Steps in which angles are counted to cut a cell; scores are rounded to six digits, angles are off by rounding errors.
STEPS, SCORE_SLACK, ANGLE_SLACK = 1024, 2e-6, 1e-7


def stack(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def choose_pivots(vectors: DataFrame, vec: str, count: int) -> np.ndarray:
    """At most ``count`` distinct vectors, picked by hash, near ones one after the other; ``count`` is bounded by ``MAX_PIVOTS``."""
    text = F.array_join(F.transform(vec, lambda x: x.cast("string")), ",")
    rows = vectors.select(vec, F.md5(text).alias("_h")).groupBy("_h").agg(F.first(vec).alias(vec)).orderBy("_h").limit(min(count, MAX_PIVOTS))
    found = [r[vec] for r in rows.collect()]
    return in_chain(stack(found)) if found else np.zeros((0, 1))


def in_chain(vectors: np.ndarray) -> np.ndarray:
    """The same rows, each followed by the most similar one that is left."""
    free, chain = np.ones(len(vectors), bool), [0]
    while len(chain) < len(vectors):
        free[chain[-1]] = False
        chain.append(int(np.where(free, vectors @ vectors[chain[-1]], -np.inf).argmax()))
    return vectors[chain]


def _at_home(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell`` and ``angle`` of the nearest pivot."""

    @F.pandas_udf("cell int, angle double")
    def place(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"cell": [], "angle": []})
        to = angles(stack(v), pivots)
        home = to.argmin(axis=1)
        return pd.DataFrame({"cell": home, "angle": to[np.arange(len(home)), home]})

    return df.withColumn("_p", place("vec")).select(*df.columns, "_p.cell", "_p.angle")


def _code() -> Column:
    return F.col("cell").cast("long") * (1 << 32) + F.col("region")


class Cells:
    """A corpus ``(chunk_id, vec)`` in cells and slices, ready to be asked."""

    def __init__(self, corpus: DataFrame, pivots: int | None = None, slice_rows: int = SLICE):
        rows = corpus.select("chunk_id", "vec").filter(F.col("vec").isNotNull())
        if pivots is None:
            pivots = 1 + rows.count() // PER_PIVOT
        self.pivots = choose_pivots(rows, "vec", pivots)
        self.schema = corpus.schema
        if not len(self.pivots):
            return
        homed = materialize(_at_home(rows, self.pivots).withColumn("step", F.floor(F.col("angle") / np.pi * STEPS).cast("int")), "homes")
        steps = homed.groupBy("cell", "step").agg(F.count("*").alias("_n"))
        up_to = Window.partitionBy("cell").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
        steps = steps.withColumn("_before", F.coalesce(F.sum("_n").over(up_to), F.lit(0)))
        # many vectors at one angle (copies, say) share a step and are dealt to its places by hash
        place = F.col("_before") + F.pmod(F.xxhash64("chunk_id"), F.col("_n"))
        together = slice_rows * max(1, REGION // slice_rows)
        self.members = materialize(
            homed.join(broadcast_if_bounded(steps), ["cell", "step"]).select(
                "chunk_id", "vec", "cell", "angle", F.floor(place / slice_rows).cast("int").alias("slice"), F.floor(place / together).cast("int").alias("region")
            ),
            "members",
        )
        self.slices = materialize(
            self.members.groupBy("cell", "region", "slice").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("rows")), "slices"
        )
        before = Window.orderBy("cell", "region").rowsBetween(Window.unboundedPreceding, -1)
        sizes = self.slices.groupBy("cell", "region").agg(F.sum("rows").alias("rows"))
        # one row per region
        self.units = materialize(
            sizes.select("cell", "region", _code().alias("code"), F.floor(F.coalesce(F.sum("rows").over(before), F.lit(0)) / UNIT).cast("int").alias("unit")), "units"
        )

    def nearest_slice(self, asked: DataFrame) -> DataFrame:
        """``asked(query_id, vec)`` with the slice of its home cell that is nearest in angle."""
        homed = _at_home(asked, self.pivots)
        apart = F.greatest(F.col("low") - F.col("angle"), F.col("angle") - F.col("high"), F.lit(0.0))
        near = homed.select("query_id", "cell", "angle").join(broadcast_if_bounded(self.slices), "cell").groupBy("query_id").agg(
            F.min_by(F.struct("cell", "region", "slice", "rows"), F.struct(apart, "slice")).alias("s")
        )
        return near.select("query_id", "s.*")

    def possible_slices(self, asked: DataFrame) -> DataFrame:
        """``query_id, cell, region, slice, rows`` in which ``asked(query_id, vec, least)`` may have a score of ``least`` or more."""
        pivots = self.pivots

        @F.pandas_udf("reach double, cells array<struct<cell: int, angle: double>>")
        def reachable(v: pd.Series, least: pd.Series) -> pd.DataFrame:
            if not len(v):
                return pd.DataFrame({"reach": [], "cells": []})
            to = angles(stack(v), pivots)
            reach = np.where(least.isna(), np.pi, np.arccos(np.clip(least.fillna(-1.0), -1.0, 1.0)) + ANGLE_SLACK)
            open_ = (to - to.min(axis=1, keepdims=True)) / 2 <= reach[:, None]
            cells = [[{"cell": int(c), "angle": float(row[c])} for c in np.flatnonzero(o)] for row, o in zip(to, open_)]
            return pd.DataFrame({"reach": reach, "cells": cells})

        to = asked.withColumn("_r", reachable("vec", F.col("least"))).select("query_id", "_r.reach", F.explode("_r.cells").alias("c"))
        apart = F.greatest(F.col("low") - F.col("angle"), F.col("angle") - F.col("high"))
        return to.select("query_id", "reach", "c.*").join(broadcast_if_bounded(self.slices), "cell").filter(apart <= F.col("reach")).select(
            "query_id", "cell", "region", "slice", "rows"
        )

    def asked_units(self, targets: DataFrame) -> DataFrame:
        """``query_id, unit, regions``: the units that ``targets(query_id, cell, region)`` ask, and the codes of the regions there."""
        met = targets.select("query_id", "cell", "region").join(broadcast_if_bounded(self.units), ["cell", "region"])
        return materialize(met.groupBy("query_id", "unit").agg(F.collect_set("code").alias("regions")), "asked-units")

    def answer(self, asked: DataFrame, targets: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        """``query_id, chunk_id, score``: the best ``k`` of each asked region for ``asked(query_id, vec, least)``, if they reach ``least``.

        With ``exclude_self`` members with the question's id are none of them, however many there are.
        """
        schema = T.StructType([
            T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("chunk_id", self.schema["chunk_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ])
        units = self.asked_units(targets)
        shares = materialize(units.groupBy("unit").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("shares")), "shares")
        small = broadcast_if_bounded(shares)
        left = units.join(small, "unit").join(asked.select("query_id", "vec", "least"), "query_id").select(
            "unit", F.pmod(F.xxhash64("query_id"), F.col("shares")).cast("int").alias("share"), "query_id", "vec", "least", "regions"
        )
        right = self.members.join(broadcast_if_bounded(self.units), ["cell", "region"]).join(small, "unit").select(
            "unit", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "code", "chunk_id", "vec"
        )

        def best(questions: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
            if questions.empty or members.empty:
                return pd.DataFrame({"query_id": questions["query_id"][:0], "chunk_id": members["chunk_id"][:0], "score": np.zeros(0)})
            members = members.sort_values(["code", "chunk_id"], ignore_index=True)
            asks, least, matrix = stack(questions["vec"]), questions["least"].fillna(-np.inf).to_numpy(dtype=np.float64), stack(members["vec"]).T
            named = np.concatenate(questions["regions"].to_list())
            by_region = np.argsort(named, kind="stable")
            asking = np.repeat(np.arange(len(asks)), questions["regions"].map(len))[by_region]
            named = named[by_region]
            own_q = own_m = np.zeros(0, np.int64)
            if exclude_self:
                ids = questions["query_id"].reset_index(drop=True).rename("id").rename_axis("q").reset_index()
                own = ids.merge(members["chunk_id"].rename("id").rename_axis("m").reset_index(), on="id")
                own_q, own_m = own["q"].to_numpy(), own["m"].to_numpy()
            found = []
            codes, starts = np.unique(members["code"].to_numpy(), return_index=True)
            for code, begin, end in zip(codes, starts, [*starts[1:], len(members)]):
                rows = asking[slice(*np.searchsorted(named, [code, code + 1]))]
                here = (own_m >= begin) & (own_m < end)
                here_q, here_m = own_q[here], own_m[here] - begin
                step = max(1, SCORES // (end - begin))
                for start in range(0, len(rows), step):
                    some = rows[start : start + step]
                    raw = asks[some] @ matrix[:, begin:end]
                    at = np.minimum(np.searchsorted(some, here_q), len(some) - 1)
                    itself = some[at] == here_q
                    raw[at[itself], here_m[itself]] = -np.inf
                    q, m, scores = best_reaching(raw, least[some], k)
                    found.append((some[q], m + begin, scores))
            none = np.zeros(0, np.int64)
            q, m, scores = map(np.concatenate, zip((none, none, np.zeros(0)), *found))
            return pd.DataFrame({"query_id": questions["query_id"].to_numpy()[q], "chunk_id": members["chunk_id"].to_numpy()[m], "score": scores})

        by = ["unit", "share"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(best, schema)


def best_reaching(raw: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rounded score of the best ``k`` columns of each row, ties by column, that reach ``least`` of the row; ``-inf`` is none."""
    reach = raw >= (least - SCORE_SLACK)[:, None]
    many = np.flatnonzero(reach.sum(axis=1) > 4 * k)
    if len(many):
        # equal rounded scores lie within the slack of the k-th best
        kth = np.partition(raw[many], -k, axis=1)[:, -k]
        reach[many] &= raw[many] >= (kth - SCORE_SLACK)[:, None]
    q, m = np.nonzero(reach)
    real = np.isfinite(raw[q, m])
    q, m = q[real], m[real]
    scores = np.floor(raw[q, m] * 1e6 + 0.5) / 1e6
    order = np.lexsort((m, -scores, q))
    q, m, scores = q[order], m[order], scores[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], m[keep], scores[keep]


def cell_topk(
    queries: DataFrame, corpus: DataFrame, k: int = 10, *, exclude_self: bool = False, pivots: int | None = None, slice_rows: int = SLICE, least: float | None = None
) -> DataFrame:
    """Exact best ``k`` corpus vectors per question by cosine, ties by id: ``query_id, chunk_id, score, rank``.

    ``queries(query_id, vec)`` and ``corpus(chunk_id, vec)`` hold unit vectors and unique ids; rows without a vector take
    no part. With ``exclude_self`` a row is not its own neighbour. With ``least`` scores below it may be missing: where none can be, nothing is asked.
    Both tables may have any size.
    """
    if exclude_self:  # without an id nothing tells a row from itself
        queries, corpus = queries.filter(F.col("query_id").isNotNull()), corpus.filter(F.col("chunk_id").isNotNull())
    asked = materialize(queries.select("query_id", "vec").filter(F.col("vec").isNotNull()), "query-vectors")
    cells = Cells(corpus, pivots, slice_rows)
    if not len(cells.pivots):
        return asked.select("query_id", F.lit(None).cast(corpus.schema["chunk_id"].dataType).alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id").asc())
    floor = F.lit(None if least is None else least - SCORE_SLACK).cast("double")
    first = materialize(cells.nearest_slice(asked), "first-slices")
    found = materialize(cells.answer(asked.withColumn("least", floor), first, k, exclude_self), "first-answers")
    reached = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == k).select("query_id", (F.col("score") - SCORE_SLACK).alias("least"))
    # a null counts for nothing; the region of the first turn is asked again with a score to beat
    asked = materialize(asked.join(reached, "query_id", "left").withColumn("least", F.greatest("least", floor)), "questions")
    hits = cells.answer(asked, cells.possible_slices(asked), k, exclude_self)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
