"""Retrieval evaluation: sampling, scoring against labels, summaries, reports."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import strip
from shelfmark.functions.windows import first_per_key
from shelfmark.operators.quality import MIN_SAMPLE_CHARS, is_boilerplate, is_noise_question

# Fixed values of the evaluation.
SEED = 42
UNKNOWN_GROUP = "未知"
MIN_GROUP = 3
LOW_RECALL, LOW_PRECISION, LOW_FAITHFULNESS = 0.5, 0.5, 0.6
METRICS = ["context_precision", "context_recall", "faithfulness"]
PREVIEW_CHARS = 80


def seeded(key: Column, seed: int = SEED) -> Column:
    """A random-looking order that is the same on every run and cluster."""
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))


def stratified_sample(chunks: DataFrame, max_chunks: int, seed: int = SEED) -> DataFrame:
    """Up to ``max_chunks`` chunks, spread evenly over industries.

    Short chunks and boiler-plate are not eligible. The per-group limit of ``max_chunks``
    runs before the shuffle, so a dominant industry sends few rows.
    """
    group = F.coalesce(F.nullif(strip(F.col("industry")), F.lit("")), F.lit(UNKNOWN_GROUP))
    fit = chunks.filter(
        (F.length(strip(F.col("content"))) >= MIN_SAMPLE_CHARS) & ~is_boilerplate(F.col("content"))
    ).withColumns({"industry": group, "_order": seeded(F.col("chunk_id"), seed)})
    groups = fit.agg(F.countDistinct("industry")).scalar()
    share = F.greatest(F.lit(1), F.floor(F.lit(max_chunks) / groups))
    pick = Window.partitionBy("industry").orderBy("_order", "chunk_id")
    taken = fit.withColumn("_n", F.row_number().over(pick)).filter(F.col("_n") <= max_chunks).filter(F.col("_n") <= share)
    return taken.orderBy("_order", "chunk_id").limit(max_chunks).drop("_n", "_order")


def sample_n(records: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows (all of them when there are fewer), the same on every run."""
    return records.orderBy(seeded(F.col(key), seed), key).limit(n)


def prefix_dedup(records: DataFrame, order: str, text: str = "question", chars: int = 10) -> DataFrame:
    """First row in ``order`` per leading ``chars`` characters."""
    keyed = records.withColumn("_prefix", F.substring(text, 1, chars))
    return first_per_key(keyed, ["_prefix"], [F.col(order)]).drop("_prefix")


def judged(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """Ranked rows with ``rel`` (1 or 0) from the relevant pairs ``truth(query_id, chunk_id)``."""
    marks = truth.select("query_id", "chunk_id", F.lit(1).alias("_rel"))
    return ranked.join(marks, ["query_id", "chunk_id"], "left").withColumn("rel", F.coalesce("_rel", F.lit(0))).drop("_rel")


def average_precision(judged_rows: DataFrame, k: int = 10) -> DataFrame:
    """AP@k per query; 0 when nothing relevant was returned. ``rank`` is at most ``k``.

    Precisions are summed as whole multiples of 1/lcm(1..k), so the sum does not depend on
    the order in which rows arrive.
    """
    unit = math.lcm(*range(1, k + 1))
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = judged_rows.withColumn("share", F.sum("rel").over(upto) * F.floor(F.lit(unit) / F.col("rank")))
    sums = rows.groupBy("query_id").agg(F.sum(F.col("share") * F.col("rel")).alias("s"), F.sum("rel").alias("r"))
    value = F.try_divide(F.col("s"), F.col("r") * unit)
    return sums.select("query_id", F.round(F.coalesce(value, F.lit(0.0)), 4).alias("context_precision"))


def recall(judged_rows: DataFrame, relevant: DataFrame) -> DataFrame:
    """Hit and recall per query; ``relevant(query_id, n_relevant)``. No relevant row at all gives NULL."""
    found = judged_rows.groupBy("query_id").agg(F.sum("rel").alias("found"))
    return found.join(relevant, "query_id", "left").select(
        "query_id",
        (F.col("found") > 0).alias("hit"),
        F.round(F.try_divide(F.col("found"), F.col("n_relevant")), 4).alias("context_recall"),
    )


def eval_summary(records: DataFrame) -> DataFrame:
    """Means of the metrics over all records and per industry, in one pass.

    ``scope`` is global or industry. A missing precision (NULL or NaN) counts as 0, other NULL metrics do not count; blank industries form no
    group and industries with fewer than three records are left out.
    """
    r = records.withColumns({
        "industry": strip(F.coalesce("industry", F.lit(""))),
        "context_precision": F.nanvl(F.coalesce("context_precision", F.lit(0.0)), F.lit(0.0)),
    })
    sets = r.groupingSets([[], [F.col("industry")]], F.col("industry"))
    out = sets.agg(
        F.grouping("industry").alias("is_global"),
        # scores have four decimals; decimal means do not depend on row order
        *[F.round(F.avg(F.col(m).cast("decimal(9,4)")), 4).cast("double").alias(m) for m in METRICS],
        F.count("*").alias("n"),
    )
    keep = (F.col("is_global") == 1) | ((F.col("n") >= MIN_GROUP) & (F.col("industry") != ""))
    return out.filter(keep).select(
        F.when(F.col("is_global") == 1, "global").otherwise("industry").alias("scope"), "industry", *METRICS, "n"
    )


def eval_flags(summary: DataFrame) -> DataFrame:
    def low(c: str, limit: float) -> Column:
        return F.coalesce(F.col(c) < limit, F.lit(False))

    return summary.select(
        "scope", "industry",
        low("context_recall", LOW_RECALL).alias("low_recall"),
        low("context_precision", LOW_PRECISION).alias("low_precision"),
        low("faithfulness", LOW_FAITHFULNESS).alias("low_faithfulness"),
    )


def industry_dist(records: DataFrame) -> DataFrame:
    return records.groupBy("industry").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "industry")


def filter_counts(records: DataFrame) -> DataFrame:
    """``records(question, contexts_count)``: totals, noise dropped, share without any context."""
    noise = is_noise_question(F.col("question"))
    kept = ~noise
    empty = F.count_if(kept & (F.col("contexts_count") == 0))
    return records.agg(
        F.count("*").alias("total"), F.count_if(noise).alias("dropped"), F.count_if(kept).alias("kept"),
        F.round(F.coalesce(F.try_divide(empty, F.count_if(kept)), F.lit(0.0)), 4).alias("empty_ratio"),
    )


def eval_detail(records: DataFrame) -> DataFrame:
    """Report rows of ``records`` with ``contexts`` and ``sources`` arrays, in the fixed column order."""
    preview = F.regexp_replace(F.substring(F.coalesce("chunk_text", F.lit("")), 1, PREVIEW_CHARS), "\n", " ")
    return records.select(
        "question", "industry", "page", preview.alias("chunk_text_preview"), *METRICS, "retrieve_ok",
        F.size("contexts").alias("contexts_count"), F.to_json("sources").alias("sources"),
    )


# Categories in order of precedence and the words that name them.
INDUSTRY_KEYWORDS = {
    "半导体": ["半导体", "芯片", "存储", "AI算力", "光刻机"],
    "房地产开发": ["房地产", "宅地", "楼面价", "住宅", "土拍"],
    "能源金属": ["金属", "锂", "铜", "黄金", "钢铁", "锡", "稀土"],
    "电力": ["电力", "风电", "光伏", "核电", "火电"],
    "教育": ["教育", "学习", "早教行业", "AI教育", "在线教育", "升学", "课堂活动"],
    "互联网电商": ["电商", "GMV", "跨境电商", "物流"],
}


def industry_tag(text: Column, keywords: dict[str, list[str]] = INDUSTRY_KEYWORDS) -> Column:
    """The first category one of whose words stands in ``text``; NULL if none does."""
    hits = [F.when(reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words]), name) for name, words in keywords.items()]
    return F.coalesce(*hits)
