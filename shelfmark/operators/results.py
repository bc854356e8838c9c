"""Turning ranked chunk ids into the rows a caller reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.sizing import broadcast_if_bounded
from shelfmark.functions.text import strip, trim_clean_end, trim_three_dots

# Fixed values of the result format.
MAX_CONTENT_CHARS = 800
UNKNOWN = "unknown"
NO_PAGE = -1


def source_line(source: Column, page: Column) -> Column:
    return F.when(page >= 1, F.concat(F.lit("[来源："), source, F.lit("  第 "), page.cast("string"), F.lit(" 页]"))).otherwise(
        F.concat(F.lit("[来源："), source, F.lit("]"))
    )


def result_rows(ranked: DataFrame, chunks: DataFrame, max_chars: int = MAX_CONTENT_CHARS) -> DataFrame:
    """Add content with its source line, source, page and industry to ranked chunk ids.

    The ranked side has at most k rows per query; the corpus is never shuffled while that
    side passes the size check.
    """
    cols = [c for c in ranked.columns if c not in ("content", "source", "page", "industry")]
    joined = chunks.select("chunk_id", "content", "source", "page", "industry").join(
        broadcast_if_bounded(ranked.select(*cols)), "chunk_id"
    )
    source = F.coalesce("source", F.lit(UNKNOWN))
    page = F.coalesce(F.col("page").cast("bigint"), F.lit(NO_PAGE).cast("bigint"))
    return joined.select(
        *cols,
        F.concat(source_line(source, page), F.lit("\n"), trim_three_dots(F.col("content"), max_chars)).alias("content"),
        source.alias("source"),
        page.alias("page"),
        F.coalesce("industry", F.lit(UNKNOWN)).alias("industry"),
    )


def flat_source(chunk_id: Column, source: Column) -> Column:
    """Part of the chunk id before ``::``, else the file name, with forward slashes."""
    head = strip(F.substring_index(F.coalesce(chunk_id, F.lit("")), "::", 1))
    base = F.substring_index(F.regexp_replace(F.coalesce(source, F.lit("")), "/+$", ""), "/", -1)
    return F.regexp_replace(F.when(head != "", head).otherwise(base), r"\\", "/")


def result_flat(chunks: DataFrame, max_chars: int = MAX_CONTENT_CHARS) -> DataFrame:
    """Flat rows without a source line; blank content is dropped, blank metadata becomes NULL."""
    kept = chunks.filter(strip(F.col("content")) != "")
    return kept.select(
        F.nullif("chunk_id", F.lit("")).alias("chunk_id"),
        trim_clean_end(F.col("content"), max_chars).alias("content"),
        flat_source(F.col("chunk_id"), F.col("source")).alias("source"),
        "page",
        F.nullif("doc_type", F.lit("")).alias("doc_type"),
        F.nullif("industry", F.lit("")).alias("industry"),
    )
