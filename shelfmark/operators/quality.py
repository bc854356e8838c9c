"""Corpus quality: page profiles, issue labels, duplicate files, boiler-plate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import cjk_count, strip

# Thresholds, labels and patterns of the quality checks.
MIN_CJK_RATIO = 0.1
MAX_SCANNED_RATIO = 0.3
SCANNED_PAGE_CHARS = 50
FULL_SCAN, PARTIAL_SCAN, GARBLED = "全量扫描版", "部分扫描", "疑似乱码"
BOILERPLATE = (
    "免责声明|分析师声明|评级说明|风险提示.*本报告|版权所有.*禁止|执业编号|"
    "请务必阅读正文之后的免责|本报告仅供.*客户使用|证券投资咨询业务资格"
)
BOILERPLATE_CHARS = 600
NOISE_KEYWORDS = [
    "免责声明", "版权所有", "联系我们", "客服电话", "扫码关注",
    "转载请注明", "本报告仅供", "投资者须知", "风险提示",
    "请联系", "官方网站", "邮箱", "传真",
]
MIN_QUESTION_CHARS = 5
MIN_SAMPLE_CHARS = 100


def doc_profile(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page, text, has_image)`` to one profile per document."""
    scanned = (F.length(strip(F.col("text"))) < SCANNED_PAGE_CHARS) & F.col("has_image")
    sums = pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"),
        F.sum(F.length("text")).alias("total_chars"),
        F.sum(cjk_count(F.col("text"))).alias("cjk"),
        F.count_if(scanned).alias("scanned"),
    )
    return sums.select(
        "doc_id", "pages", "total_chars",
        F.floor(F.col("total_chars") / F.col("pages")).alias("avg_chars"),
        F.coalesce(F.try_divide(F.col("cjk"), F.col("total_chars")), F.lit(0.0)).alias("cjk_ratio"),
        (F.col("scanned") / F.col("pages")).alias("scanned_ratio"),
    )


def doc_issues(profile: DataFrame) -> DataFrame:
    """Labels of each profiled document, joined by `` | ``; empty when it is sound."""
    full = F.col("total_chars") < 100 * F.col("pages")
    issues = F.array_compact(
        F.array(
            F.when(full, FULL_SCAN),
            F.when(~full & (F.col("scanned_ratio") > MAX_SCANNED_RATIO), PARTIAL_SCAN),
            F.when(~full & (F.col("total_chars") >= 50) & (F.col("cjk_ratio") < MIN_CJK_RATIO), GARBLED),
        )
    )
    return profile.withColumn("issues", F.array_join(issues, " | "))


def dup_groups(files: DataFrame) -> DataFrame:
    """Files ``(path, hash)`` sharing their hash with another one, with the size of the group.

    Counts combine before the shuffle; members stay rows, they are never collected.
    """
    groups = files.groupBy("hash").agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)
    return files.join(groups, "hash").select("hash", "path", "copies")


def is_boilerplate(content: Column) -> Column:
    """Legal or contact text near the start of a chunk."""
    return F.regexp_like(F.substring(content, 1, BOILERPLATE_CHARS), F.lit(f"(?s){BOILERPLATE}"))


def is_noise_question(question: Column) -> Column:
    """Blank, very short, or about contacts and disclaimers."""
    q = strip(F.coalesce(question, F.lit("")))
    return (F.length(q) < MIN_QUESTION_CHARS) | F.regexp_like(q, F.lit("|".join(NOISE_KEYWORDS)))
