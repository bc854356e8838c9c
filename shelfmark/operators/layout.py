"""From positioned page blocks to text in reading order, and from cell rows to tables.

A page (and a table on it) is bounded by paper size, so its blocks may meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import strip

# Fixed values of the page model.
BAND = 0.07
COLUMN_GAP = 0.12
TABLE_OVERLAP = 0.4
MIN_BLOCK_CHARS = 3


def outside_bands(blocks: DataFrame) -> DataFrame:
    """Drop page headers, footers and blocks of fewer than three characters."""
    return blocks.filter(
        (F.col("y0") >= F.col("page_h") * BAND)
        & (F.col("y1") <= F.col("page_h") * (1 - BAND))
        & (F.length(strip(F.col("text"))) >= MIN_BLOCK_CHARS)
    )


def overlap_share(blocks: DataFrame, boxes: DataFrame) -> Column:
    """Area shared with the box as a part of the block's own area."""
    wide = F.least(blocks["x1"], boxes["x1"]) - F.greatest(blocks["x0"], boxes["x0"])
    high = F.least(blocks["y1"], boxes["y1"]) - F.greatest(blocks["y0"], boxes["y0"])
    zero = F.lit(0.0)
    own = (blocks["x1"] - blocks["x0"]) * (blocks["y1"] - blocks["y0"])
    return F.greatest(zero, wide) * F.greatest(zero, high) / F.greatest(F.lit(1e-6), own)


def suppress_table_text(blocks: DataFrame, boxes: DataFrame, share: float = TABLE_OVERLAP) -> DataFrame:
    """Drop blocks lying mostly inside any table box of their page."""
    same_page = (blocks["doc_id"] == boxes["doc_id"]) & (blocks["page"] == boxes["page"])
    return blocks.join(boxes, same_page & (overlap_share(blocks, boxes) >= share), "left_anti")


def reading_order(blocks: DataFrame) -> DataFrame:
    """One row per page: ``doc_id, page, two_columns, n_blocks, page_text``.

    Two columns when both halves start blocks and the gap between them is wide enough; then
    the left column is read before the right one, otherwise the page is read top down.
    """
    item = F.struct("y0", "block_no", "x0", "x1", "text")
    right = F.col("w") / 2
    gap = F.min(F.when(F.col("x0") >= F.col("page_w") / 2, F.col("x0"))) - F.max(
        F.when(F.col("x0") < F.col("page_w") / 2, F.col("x1"))
    )
    pages = blocks.groupBy("doc_id", "page").agg(
        F.collect_list(item).alias("items"),
        F.max("page_w").alias("w"),
        F.coalesce(gap > F.max("page_w") * COLUMN_GAP, F.lit(False)).alias("two_columns"),
    )
    placed = F.array_sort(
        F.transform(
            "items",
            lambda b: F.struct(
                F.when(F.col("two_columns") & (b["x0"] >= right), 1).otherwise(0).alias("side"),
                b["y0"].alias("y0"), b["block_no"].alias("block_no"), b["text"].alias("text"),
            ),
        )
    )
    return pages.select(
        "doc_id", "page", "two_columns", F.size("items").alias("n_blocks"),
        strip(F.array_join(F.transform(placed, lambda b: b["text"]), "\n")).alias("page_text"),
    ).filter(F.col("page_text") != "")


def page_text(parts: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Join the chunks of a page in chunk number order; empty pages are dropped."""
    listed = parts.groupBy("doc_id", "page").agg(
        F.count("*").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("chunk_no", "text"))).alias("items")
    )
    return listed.select(
        "doc_id", "page", "n_chunks",
        strip(F.array_join(F.transform("items", lambda c: c["text"]), separator)).alias("page_text"),
    ).filter(F.col("page_text") != "")


def table_markdown(rows: DataFrame, *, escape_bars: bool = False) -> DataFrame:
    """``rows(table_id, row_no, cells)`` to one Markdown table per ``table_id``.

    The first row is the header; other rows are cut or filled up to its width, white space
    in cells is collapsed, NULL is empty. ``escape_bars`` is the variant for reports.
    """

    def clean(cell):
        text = F.coalesce(cell, F.lit(""))
        if escape_bars:
            return F.regexp_replace(text, r"\|", r"\\|")
        return strip(F.regexp_replace(text, r"(?U)\s+", " "))

    def line(cells):
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    lists = rows.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("r"))
    header = F.col("r")[0]["cells"]
    width = F.size(header)
    lists = lists.filter(width > 0)

    def fit(cells):
        padded = F.concat(F.transform(cells, clean), F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(cells))))
        return F.slice(padded, F.lit(1), width)

    body = F.transform(F.slice("r", F.lit(2), F.size("r")), lambda x: line(fit(x["cells"])))
    rule = line(F.array_repeat(F.lit("---"), width))
    return lists.select(
        "table_id", F.array_join(F.concat(F.array(line(F.transform(header, clean)), rule), body), "\n").alias("markdown")
    )
