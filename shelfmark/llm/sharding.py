"""Shards of near-equal bytes from sampled splitters, DataFrame functions only.

Documents are ordered by the hash of their text, so equal texts are neighbours. Splitters come from a size-weighted
sample of that key and cut the order into ranges; a text whose copies outgrow ``whole`` of a shard is a range of its
own and is subdivided at quantiles of ``doc_id``. Totals per range give every row its exact offset, and the offset
gives shard and slot, so no task sees more than one range and the sample only decides how the work is cut, never
the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.session import materialize
from shelfmark.functions.windows import running
from shelfmark.llm.ordered import below, filled

#: Ranges the order is cut into, and sampled keys per range.
RANGES, PER_RANGE = 512, 64
#: Pieces a hot text is subdivided into.
PIECES = 64


def shards(docs: DataFrame, n: int = 8, whole: float = 0.01, text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    Law ``bytes``: the sizes (UTF-8 bytes plus 1) of the ``n`` shards are equal but for one document and one group
    of equal texts; groups up to ``whole`` of a shard stay together, larger ones are cut. ``slot`` counts from 0
    without gaps in each shard. A null text has size 1 and the key of the empty text; null and repeated ``doc_id``
    are rows like any other (nulls first). An empty table gives an empty table; other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = materialize(
        docs.select(
            "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
            F.md5(body.cast("binary")).alias("key"),
        ).withColumn("place", F.conv(F.substring("key", 1, 15), 16, 10).cast("long")),
        "sizes",
    )
    total = base.agg(F.sum("size")).first()[0] or 1
    limit = total * whole / n
    # fewer than n / whole texts can exceed the limit, so this table and its places are bounded
    hot = base.groupBy("key", "place").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > limit)
    cuts = (
        base.join(F.broadcast(hot.select("key")), "key").groupBy("key", "place")
        .agg(F.percentile_approx("doc_id", [i / PIECES for i in range(1, PIECES)]).alias("ids"))
    )
    cuts = materialize(cuts.select("key", "place", F.array_sort(F.array_distinct("ids")).alias("ids")), "hot-texts")
    rate = RANGES * PER_RANGE / total
    uniform = F.pmod(F.xxhash64("key", "doc_id"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    splitters = base.filter(uniform < F.col("size") * rate).agg(
        F.percentile_approx("place", [i / RANGES for i in range(1, RANGES)]).alias("at")
    ).first()[0]
    bounds = sorted({*(splitters or []), *(r[0] for r in cuts.select("place").collect())})
    array, steps = filled(bounds)
    ranged = base.join(F.broadcast(cuts.select("key", "ids")), "key", "left")
    ranged = ranged.withColumn("range", below(F.col("place"), array, steps))
    padded = F.concat("ids", F.array_repeat(F.lit(None).cast("long"), PIECES - F.size("ids")))
    piece = F.coalesce(below(F.col("doc_id"), padded, PIECES.bit_length() - 1), F.lit(0))
    ranged = ranged.withColumn(
        "slice", F.struct("range", F.when(F.col("ids").isNull(), 0).otherwise(1 + piece).alias("piece"))
    ).withColumn("small", F.col("ids").isNull()).drop("ids", "range")
    order = [F.col(c) for c in ("place", "key", "doc_id")]
    placed = running(ranged, [], F.col("slice"), order, {"bytes_to": F.col("size"), "rows_to": F.lit(1)})
    start = F.col("bytes_to") - F.col("size")
    # a small group lies in one slice: it goes where its first row goes
    group_start = F.min(start).over(Window.partitionBy("slice", "key"))
    placed = placed.withColumn("start", F.when(F.col("small"), group_start).otherwise(start))
    placed = placed.withColumn("shard", F.least(F.lit(n - 1), F.expr(f"start * {n} div {total}")).cast("int"))
    ahead = placed.groupBy("shard").agg(F.min("rows_to").alias("first_row"))
    return placed.join(F.broadcast(ahead), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rows_to") - F.col("first_row")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
