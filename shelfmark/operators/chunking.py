"""Splitting texts into overlapping chunks along a ladder of separators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import strip

# Chunk sizes and separator ladders (regular expressions, coarse to fine).
CHUNK_SIZE, CHUNK_OVERLAP = 500, 50
LADDERS = {
    "pdf": ["\n\n", "\n", "。", "！", "？", "；", "，", " ", ""],
    "py": ["\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", ""],
    "md": ["\n#{1,6} ", "```\n", "\n\\*\\*\\*+\n", "\n---+\n", "\n___+\n", "\n\n", "\n", " ", ""],
    "markdown": ["\n#{1,6} ", "```\n", "\n\\*\\*\\*+\n", "\n---+\n", "\n___+\n", "\n\n", "\n", " ", ""],
    "txt": ["\n\n", "\n", " ", ""],
}


def chunk_spans(text: str, ladder: list[str], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of ``text`` that make up its chunks.

    Pieces always stay contiguous, so a chunk is a window over cut positions: it grows while
    it fits in ``size`` and then slides until at most ``overlap`` characters are repeated.
    """

    def windows(cuts: list[int]) -> Iterator[tuple[int, int]]:
        tail = 0
        for head in range(1, len(cuts)):
            if cuts[head] - cuts[tail] > size and head - 1 > tail:
                yield cuts[tail], cuts[head - 1]
                while cuts[head - 1] - cuts[tail] > overlap or (
                    cuts[head] - cuts[tail] > size and tail < head - 1
                ):
                    tail += 1
        yield cuts[tail], cuts[-1]

    def descend(lo: int, hi: int, level: int) -> Iterator[tuple[int, int]]:
        found: list[int] = []
        while level < len(ladder) and ladder[level]:
            found = [m.start() + lo for m in re.finditer(ladder[level], text[lo:hi])]
            if found:
                break
            level += 1
        cuts = found if level < len(ladder) and ladder[level] else list(range(lo, hi))
        cuts = sorted({lo, hi, *cuts})
        run = [lo]
        for left, right in zip(cuts, cuts[1:]):
            if right - left < size or level + 1 >= len(ladder):
                run.append(right)
                continue
            if len(run) > 1:
                yield from windows(run)
            yield from descend(left, right, level + 1)
            run = [right]
        if len(run) > 1:
            yield from windows(run)

    if text:
        yield from descend(0, len(text), 0)


def split_column(text: Column, kind: str | Column = "pdf", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of chunk texts; ``kind`` picks the ladder (a file suffix, or a column of them)."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, kinds in batches:
            yield pd.Series(
                [
                    [] if t is None else [
                        c for a, b in chunk_spans(t, LADDERS.get(k, LADDERS["txt"]), size, overlap) if (c := t[a:b].strip())
                    ]
                    for t, k in zip(texts, kinds)
                ]
            )

    return split(text, F.lit(kind) if isinstance(kind, str) else kind)


def chunk_table(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    """The chunker as a table function ``(text, kind) -> (chunk_no, content)`` for lateral joins and SQL.

    A chunk is handed on as it is cut, so a very long text never stands in memory a second time as a list of chunks.
    """

    class Chunks:
        def eval(self, text: str, kind: str):
            no = 0
            for a, b in chunk_spans(text or "", LADDERS.get(kind, LADDERS["txt"]), size, overlap):
                content = text[a:b].strip()
                if content:
                    yield no, content
                    no += 1

    return F.udtf(Chunks, returnType="chunk_no int, content string", useArrow=True)


def register_chunker(spark: SparkSession, name: str = "chunk_text", **sizes) -> None:
    """Make the table function known to SQL: ``FROM docs, LATERAL chunk_text(text, 'pdf')``."""
    spark.udtf.register(name, chunk_table(**sizes))


def chunk_docs_lateral(docs: DataFrame, text_col: str = "text", kind: str | Column = "pdf", **sizes) -> DataFrame:
    """The rows of :func:`chunk_docs`, by a lateral join with the table function."""
    rest = [c for c in docs.columns if c != text_col]
    stripped = docs.withColumn(text_col, strip(F.col(text_col)))
    column = F.lit(kind) if isinstance(kind, str) else kind
    return stripped.lateralJoin(chunk_table(**sizes)(F.col(text_col).outer(), column if isinstance(kind, str) else column.outer())).select(*rest, "chunk_no", "content")


def chunk_docs(docs: DataFrame, text_col: str = "text", kind: str | Column = "pdf", **sizes) -> DataFrame:
    """Explode each document into ``chunk_no, content``; the other columns are kept.

    Narrow: no shuffle, one Arrow batch of documents at a time.
    """
    rest = [c for c in docs.columns if c != text_col]
    cut = docs.select(*rest, F.posexplode(split_column(strip(F.col(text_col)), kind, **sizes)).alias("chunk_no", "content"))
    return cut.filter(F.col("content") != "")
