"""Mixing sources to target weights by a low-discrepancy schedule, DataFrame functions only.

The mix is a row of slots of ``block`` words each. Slot ``i`` sits at the golden-ratio point ``i * phi mod 1``; the
cumulative target shares cut [0, 1) into one interval per source, so every stretch of the schedule holds each source
in its share, up to a few slots. The slots of a source are ranked, and rank ``r`` takes words ``r * block`` up to
``(r + 1) * block`` of that source's documents, laid end to end in shuffled (hash) order and repeated as often as
the target asks. A source is full at its target: later slots of it are void, and what the points leave short (a few
slots) is appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.session import materialize
from shelfmark.functions.windows import running

# The golden ratio as a fraction of 2**32, and the weights in turn over the sources.
GOLDEN, TURN = 2654435769, 1 << 32
WEIGHTS = (3, 1, 2)
#: Intervals of [0, 1) that slots and sources meet in.
CELLS = 4096
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add ``turn`` (place in code point order, null last) and ``target`` to ``source, source_size``: ``share`` of all words, by weight, none above ``most`` times its size.

    Sources above their limit stop there and the rest is reshared. In the order of limit over weight the stopped
    sources come first, so running sums over that order give the level for each number of stopped sources; the largest is the final one.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("turn", F.row_number().over(by_name) - 1).withColumns({
        "weight": F.element_at(F.array(*map(F.lit, weights)), F.col("turn") % len(weights) + 1),
        "most": F.col("source_size") * F.lit(most),
    })
    by_limit = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    leveled = weighed.withColumn("level", level)
    # the level rises as long as the next source is stopped below it and falls afterwards
    free = F.max("level").over(everything)
    return leveled.select("source", "turn", "source_size", F.least(F.col("most"), F.col("weight") * free).alias("target"))


def schedule(goals: DataFrame, block: int) -> DataFrame:
    """``slot, turn, rank, words``: which source each slot takes its next ``words`` (``block``, the last one fewer) from.

    ``goals`` has ``turn`` (a number per source), ``target`` and ``take`` (the target in whole words).
    """
    spark = goals.sparkSession
    total, take = goals.agg(F.sum("target"), F.sum("take")).first()
    total = total or 1.0
    n = -(-(take or 0) // block)
    upto = Window.partitionBy(F.lit(0)).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum("target").over(upto)
    on_line = lambda c: F.round(c / F.lit(total) * F.lit(TURN)).cast("long")
    edges = goals.withColumns({"need": F.ceil(F.col("take") / F.lit(block)), "hi": on_line(cum), "lo": on_line(cum - F.col("target"))})
    width = TURN // CELLS
    cells = edges.filter("hi > lo").select(
        "turn", "need", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("cell")
    )
    # the multiplier is cut in two so that no product leaves 63 bits, whatever the slot
    point = f"((id % {TURN}) * {GOLDEN >> 16} % {TURN} * {1 << 16} + (id % {TURN}) * {GOLDEN & 0xFFFF}) % {TURN}"
    points = spark.range(n).select(F.col("id").alias("slot"), F.expr(point).alias("x"))
    hit = points.withColumn("cell", F.expr(f"x div {width}")).join(cells, "cell").filter("x >= lo and x < hi").select("slot", "turn", "need")
    ranked = running(hit, ["turn"], F.expr("slot div 8192"), [F.col("slot")], {"upto": F.lit(1)})
    drawn = ranked.filter("upto <= need").select("slot", "turn", (F.col("upto") - 1).cast("long").alias("rank"))
    got = hit.groupBy("turn").agg(F.count("*").alias("got"))
    short = edges.join(got, "turn", "left").fillna(0, ["got"]).filter("got < need")
    appended = short.select(F.lit(None).cast("long").alias("slot"), "turn", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank"))
    words = F.least(F.lit(block).cast("long"), F.col("take") - F.col("rank") * block)
    return drawn.unionByName(appended).join(goals.select("turn", "take"), "turn").select("slot", "turn", "rank", words.alias("words"))


def mix(docs: DataFrame, block: int = 64, text: str = "text") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    ``taken`` counts the words that the slots take from the document, repeats counted. Null texts have no words; a
    null source is a source (last in order); in the shuffled order a null ``doc_id`` comes first and rows that repeat
    a ``doc_id`` go by size. No words or no rows: nothing is taken. Other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = materialize(
        docs.select("doc_id", "source", F.regexp_count(body, F.lit(WORDS)).cast("long").alias("size"))
        .withColumn("shuffled", F.md5(F.col("doc_id").cast("string"))), "sizes",
    )
    goals = materialize(
        targets(base.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("take", F.round("target").cast("long")), "targets"
    )
    of = goals.select(F.col("source").alias("of"), "turn", "source_size", "target")
    sized = base.join(of, F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
    order = [F.col(c) for c in ("shuffled", "doc_id", "size")]
    laid = running(sized, ["turn"], F.substring("shuffled", 1, 3), order, {"end": F.col("size")}).drop("shuffled")
    # a line may be read more than once: the document stands once in each pass, cut where the blocks of the slots meet
    passes = F.ceil(F.col("target") / F.col("source_size"))
    placed = laid.withColumn("pass", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.lit(0), passes.cast("int") - 1))))
    placed = placed.withColumn("to", F.col("end") + F.col("pass") * F.col("source_size")).withColumn("from", F.col("to") - F.col("size"))
    cut = placed.withColumn("rank", F.explode_outer(F.expr(f"sequence(`from` div {block}, (`to` - 1) div {block})")))
    met = cut.join(schedule(goals, block).select("turn", "rank", "words"), ["turn", "rank"], "left")
    read = F.least(F.col("to"), F.col("rank") * block + F.coalesce("words", F.lit(0))) - F.greatest(F.col("from"), F.col("rank") * block)
    return met.groupBy("turn", "end", "doc_id", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.greatest(read, F.lit(0))), F.lit(0)).alias("taken"), F.count_if(F.col("size") == 0).alias("blank")
    ).withColumn("row", F.explode(F.sequence(F.lit(1), F.greatest(F.col("blank"), F.lit(1))))).select("doc_id", "size", "source_size", "target", "taken")
