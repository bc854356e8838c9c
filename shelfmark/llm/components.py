"""Connected components of a graph given as an edge table.

Union-find inside each Arrow batch first contracts the edges to spanning forests; the forests are then merged by
alternating two star steps ("hang every neighbour on the smallest one") until nothing changes. Every step is a
combinable ``min`` per node and a join that AQE can split, so a node may have any number of neighbours; each round
is written to the shared work folder, so lineage stays short and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.session import materialize


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        tree = [(v, find(v)) for v in parent]
        tree = [(v, r) for v, r in tree if v != r]
        yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in tree], pa.int64()) for i in (0, 1)], ["u", "v"])


def _hang(pairs: DataFrame, keep: str) -> DataFrame:
    """Replace each edge ``(u, v)`` that passes ``keep`` by ``(v, smallest neighbour of u, u included)``."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u").filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """``(id, label)`` for every node of ``edges(a, b)``: label is the smallest id that can be reached.

    Loops and repeated edges are allowed; null ends are not. No edges give no rows.
    """
    now = materialize(edges.select("a", "b").mapInArrow(_forests, "u long, v long").distinct(), "forest")
    mark = _mark(now)
    while True:
        both = now.union(now.select(F.col("v"), F.col("u")))
        large = _hang(both, "v > u").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        # the small star keeps the link from u itself to its smallest neighbour
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = materialize(hung.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("label"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).union(roots.distinct())
