"""Exact nearest neighbours and exact greedy near-duplicate removal over unit vectors.

A bounded number of questions travels to the corpus and is answered in a narrow pass; more of
them are joined with it cell by cell (``cells``). For deduplication, cells are ranges of the order, two of
which meet in a task; the links between near rows decide what is kept. Identical vectors are collapsed first, so a huge
group of copies costs as much as one vector.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.session import materialize
from shelfmark.functions.windows import first_per_key
from shelfmark.operators.cells import cell_topk, stack

BLOCK = 1024
#: Questions that travel to the tasks together.
QUESTIONS = 2048
#: Most rows of a cell, cells that are made of fewer rows, earlier neighbours that a row names, and rows decided one after the other.
PER_CELL, CELLS, LINKS, BATCH = 131072, 16, 16, 65536
#: Rows that are compared together, groups of them that are met at once, and axes along which groups are told apart.
LEAF, BOXES, AXES = 256, 16, 8


def best_of_batch(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For ``scores`` (questions x rows, ``-inf`` for none): positions of the best ``k`` rows of each, ties by id."""
    order = np.argsort(ids, kind="stable")
    keep = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]]
    asked = np.repeat(np.arange(len(scores)), keep.shape[1])
    rows = keep.ravel()
    real = np.isfinite(scores[asked, rows])
    return asked[real], rows[real]


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, *, exclude_self: bool = False, least: float | None = None) -> DataFrame:
    """Exact best ``k`` corpus vectors per query by cosine, ties by id.

    ``queries(query_id, vec)`` and ``corpus(chunk_id, vec)`` hold unit vectors; rows without a vector take no part.
    With ``exclude_self`` a row is not its own neighbour. With ``least`` only scores from there on are asked for, others may be
    missing. Returns ``query_id, chunk_id, score, rank``. Up to ``QUESTIONS``
    questions travel to the tasks; one narrow pass over the corpus multiplies batches of rows and hands on at most ``k``
    rows per question and batch. More questions are joined with the corpus by cells, without passing the driver.
    """
    need = k + 1 if exclude_self else k
    asked = materialize(queries.select("query_id", "vec").filter(F.col("vec").isNotNull()), "query-vectors")
    if asked.count() > QUESTIONS:
        return cell_topk(asked, corpus, k, exclude_self=exclude_self, least=least)
    rows = corpus.select("chunk_id", "vec").filter(F.col("vec").isNotNull())
    schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", corpus.schema["chunk_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    block = asked.collect()
    if not block:
        return corpus.sparkSession.createDataFrame([], T.StructType([*schema, T.StructField("rank", T.IntegerType())]))
    shipped = corpus.sparkSession.sparkContext.broadcast(([r["query_id"] for r in block], stack([r["vec"] for r in block])))

    def best(batches):
        names, matrix = shipped.value
        names = np.array(names, dtype=object)
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                part = batch.iloc[start : start + BLOCK]
                scores = np.floor(matrix @ stack(part["vec"]).T * 1e6 + 0.5) / 1e6
                ids = part["chunk_id"].to_numpy()
                q, d = best_of_batch(ids, scores, need)
                yield pd.DataFrame({"query_id": names[q], "chunk_id": ids[d], "score": scores[q, d]})

    hits = rows.mapInPandas(best, schema)
    if exclude_self:
        hits = hits.filter(F.col("query_id") != F.col("chunk_id"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id").asc())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _matrix(rows: pa.Table) -> np.ndarray:
    values = rows["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64, copy=False).reshape(rows.num_rows, -1)


def _places(sorted_keys: np.ndarray) -> np.ndarray:
    """Position of each entry among the entries of its key."""
    return np.arange(len(sorted_keys)) - np.searchsorted(sorted_keys, sorted_keys)


def _leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of ``points`` in groups of at most ``most`` that lie together: halved along the column of largest variance."""
    open_, leaves = [np.arange(len(points))], []
    while open_:
        rows = open_.pop()
        if len(rows) <= most:
            leaves.append(rows)
            continue
        order = np.argsort(points[rows, points[rows].var(axis=0).argmax()], kind="stable")
        open_ += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]
    return leaves


def _first(i: np.ndarray, j: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with the ``most`` smallest ``j`` of each ``i``."""
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    keep = _places(i) < most
    return i[keep], j[keep]


def earlier_neighbours(rows: pa.Table, others: pa.Table, threshold: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in ``rows`` and ``others`` (both sorted by ``ord``) of pairs in which the other is earlier and near.

    A row names its first ``most`` such others; the third array holds the rows that have more. Rows that lie together are
    compared with the groups of others that their boxes along the main axes do not rule out: the square of the distance
    of two rows is the sum of their squared lengths less twice their score.
    """
    exact, exact_others = _matrix(rows), _matrix(others)
    fast, fast_others = exact.astype(np.float32), exact_others.astype(np.float32)
    ords, other_ords = (t["ord"].to_numpy() for t in (rows, others))
    # what rounding to single precision can add to a score
    slack = np.finfo(np.float32).eps * (exact.shape[1] + 8)
    # a row with a value missing is near nothing, wherever it is put
    placed, placed_others = (np.nan_to_num(m) for m in (exact, exact_others))
    axes = np.linalg.eigh(placed_others.T @ placed_others)[1][:, ::-1][:, :AXES]

    def grouped(matrix: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        points, squares = matrix @ axes, np.einsum("nd,nd->n", matrix, matrix)
        leaves = _leaves(points, LEAF)
        return leaves, *(np.stack([of(values[leaf], axis=0) for leaf in leaves]) for of, values in ((np.min, points), (np.max, points), (np.max, squares)))

    leaves, low, high, size = grouped(placed)
    other_leaves, other_low, other_high, other_size = grouped(placed_others)
    fast_leaves = [fast_others[other] for other in other_leaves]
    found, left, right = np.zeros(len(ords), np.int64), [], []
    for n, leaf in enumerate(leaves):
        apart = np.maximum(0.0, np.maximum(low[n] - other_high, other_low - high[n]))
        near_boxes = np.flatnonzero((apart * apart).sum(axis=1) <= (size[n] + other_size) * (1 + 1e-9) - 2 * threshold + 1e-9)
        here, one, two = fast[leaf], [], []
        for start in range(0, len(near_boxes), BOXES):
            met = near_boxes[start : start + BOXES]
            other = np.concatenate([other_leaves[b] for b in met])
            scores = here @ np.concatenate([fast_leaves[b] for b in met]).T
            at = np.flatnonzero(scores >= threshold - slack)
            i, j = leaf[at // len(other)], other[at % len(other)]
            near = other_ords[j] < ords[i]
            doubt = np.flatnonzero(near & (scores.ravel()[at] < threshold + slack))
            for part in np.array_split(doubt, 1 + len(doubt) // (1 << 16)):
                near[part] = np.einsum("nd,nd->n", exact[i[part]], exact_others[j[part]]) >= threshold
            i, j = i[near], j[near]
            if len(i):
                np.add.at(found, i, 1)
                i, j = _first(np.concatenate([*one, i]), np.concatenate([*two, j]), most)
                one, two = [i], [j]
        left += one
        right += two
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), np.flatnonzero(found > most)


def _links(asked: DataFrame, alive: DataFrame, threshold: float) -> DataFrame:
    """``ord, near``: the first ``LINKS`` earlier neighbours in ``alive`` of each row of ``asked``; an empty array stands for none.

    ``more`` tells that there are others. Both hold ``ord, vec, cell`` with cells in ``ord`` order; two cells meet in a task.
    """
    homes = sorted(r["cell"] for r in alive.select("cell").distinct().collect())
    few = asked.count() <= PER_CELL and len(homes) > CELLS
    groups = [0] if few else homes  # few rows travel together
    tasks = 2 * len(groups) * len(homes)

    def each(of: list[int], wanted: Callable[[Column], Column]) -> Column:
        every = F.array(*[F.lit(c).cast("int") for c in of])
        return F.explode(every if few else F.filter(every, wanted))

    mine = F.lit(0).cast("int") if few else F.col("cell")
    left = asked.select(mine.alias("x"), "ord", "vec", each(homes, lambda y: y <= F.col("cell")).alias("y"))
    right = alive.select(F.col("cell").alias("y"), "ord", "vec", each(groups, lambda x: x >= F.col("cell")).alias("x"))
    ord_type = asked.schema["ord"].dataType.simpleString()

    def meet(rows: pa.Table, others: pa.Table) -> pa.Table:
        schema = pa.schema([("ord", rows.schema.field("ord").type), ("near", others.schema.field("ord").type)])
        if not rows.num_rows or not others.num_rows:
            return schema.empty_table()
        rows, others = rows.sort_by("ord"), others.sort_by("ord")
        i, j, more = earlier_neighbours(rows, others, threshold, LINKS)
        ords = pa.chunked_array([*rows["ord"].take(pa.array(i)).chunks, *rows["ord"].take(pa.array(more)).chunks], schema.field("ord").type)
        near = pa.chunked_array([*others["ord"].take(pa.array(j)).chunks, pa.nulls(len(more), schema.field("near").type)], schema.field("near").type)
        return pa.Table.from_arrays([ords, near], schema=schema)

    by = ["x", "y"]
    found = left.repartition(tasks, *by).groupBy(*by).cogroup(right.repartition(tasks, *by).groupBy(*by)).applyInArrow(meet, f"ord {ord_type}, near {ord_type}")
    # a null neighbour stands for those beyond the first
    named = found.groupBy("ord").agg(F.array_sort(F.collect_list("near")).alias("near"), (F.count("*") > F.count("near")).alias("more"))
    return named.select("ord", F.slice("near", 1, LINKS).alias("near"), (F.col("more") | (F.size("near") > LINKS)).alias("more"))


def _judge(links: DataFrame, known: DataFrame) -> DataFrame:
    """``ord, near, more, kept`` after the verdicts ``known(ord, kept)``: neighbours left open, and the row's own verdict if it follows."""
    near = links.select("ord", "more", F.explode_outer("near").alias("n")).join(known.select(F.col("ord").alias("n"), "kept"), "n", "left")
    each = near.groupBy("ord", "more").agg(
        F.collect_list(F.when(F.col("kept").isNull(), F.col("n"))).alias("near"), F.coalesce(F.max("kept"), F.lit(False)).alias("falls")
    )
    verdict = F.when(F.col("falls"), False).when((F.size("near") == 0) & ~F.col("more"), True)
    return each.select("ord", "near", "more", verdict.alias("kept"))


def _in_order(rows: pa.Table) -> pa.Table:
    """Verdicts on the first open rows one after the other; a row's open neighbours are earlier, so they are here too."""
    rows = rows.sort_by("ord")
    state, verdicts = {}, []
    for o, near, more, kept in zip(*(rows[c].to_pylist() for c in ("ord", "near", "more", "kept"))):
        if kept is None:
            seen = {state.get(n) for n in near}
            kept = False if True in seen else None if None in seen or more else True
        state[o] = kept
        verdicts.append(state[o])
    return pa.table([rows["ord"], pa.array(verdicts, pa.bool_())], ["ord", "kept"])


def semantic_dedup(
    records: DataFrame, threshold: float = 0.92, *, cells: int | None = None, batch: int = BATCH
) -> DataFrame:
    """Greedy near-duplicate removal: in ``ord`` order keep a row unless it is at least
    ``threshold`` similar to a row already kept. ``records(ord, vec)``, ``ord`` unique.

    Every pair of distinct vectors is compared once, cell by cell, and a row names its first earlier neighbours only. A row
    without any is kept, a row next to a kept one falls, a row whose neighbours have all fallen is kept. Rounds of joins
    decide as long as they decide a good part of what is open, then the first ``batch`` open rows are decided in order.
    Rows that named all they may and are still open ask again, among the kept and the open ones.
    """
    rows = first_per_key(records.select("ord", "vec"), ["vec"], [F.col("ord")]).select("ord", "vec").filter(F.col("ord").isNotNull())
    rows = materialize(rows, "dedup")
    if cells is None:
        total = rows.count()
        cells = max(-(-total // PER_CELL), min(CELLS, 1 + total // BLOCK))
    rows = materialize(rows.repartitionByRange(cells, "ord").withColumn("cell", F.spark_partition_id()), "dedup")
    ord_type = records.schema["ord"].dataType.simpleString()
    asked = alive = rows
    kept_parts = []
    while True:
        links = materialize(_links(asked, alive, threshold), "links")
        free = materialize(asked.select("ord").join(links, "ord", "left_anti").withColumn("kept", F.lit(True)), "verdicts")
        # kept in an earlier turn: whoever names them falls
        verdicts = [free, *([alive.join(asked, "ord", "left_anti").select("ord", F.lit(True).alias("kept"))] if kept_parts else [])]
        known, turn, open_links = reduce(DataFrame.unionByName, verdicts), [free], links
        before = links.count()
        while before:
            judged = materialize(_judge(open_links, known), "judged")
            known, open_links = judged.filter(F.col("kept").isNotNull()).select("ord", "kept"), judged.filter(F.col("kept").isNull()).drop("kept")
            turn.append(known)
            left = open_links.count()
            if left and (left <= batch or left > before / 2):
                first = _judge(open_links.orderBy("ord").limit(batch), known)
                ordered = materialize(first.groupBy().applyInArrow(_in_order, f"ord {ord_type}, kept boolean"), "verdicts").filter(F.col("kept").isNotNull())
                if not (decided := ordered.count()):
                    break
                turn.append(ordered)
                known, open_links = known.unionByName(ordered), open_links.join(ordered, "ord", "left_anti")
                left -= decided
            before = left
        decided = reduce(DataFrame.unionByName, turn)
        kept_parts.append(decided.filter("kept").select("ord"))
        if not before:
            break
        fallen = decided.filter(~F.col("kept"))
        alive = materialize(alive.join(fallen, "ord", "left_anti"), "dedup")
        asked = materialize(asked.join(decided, "ord", "left_anti"), "dedup")
    return records.join(reduce(DataFrame.unionByName, kept_parts), "ord", "left_semi")
