"""Text to vector, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64
#: Characters whose terms stand in memory together, and terms whose codes a task remembers.
PIECE_CHARS, CODES = 1 << 20, 1 << 17


class _TermCodes(dict):
    """Term to ``2 * slot + (1 if the sign is negative)``; forgets everything when it gets large."""

    def __init__(self, dimensions: int, limit: int = CODES):
        super().__init__()
        self.dimensions, self.limit = dimensions, limit

    def __missing__(self, term: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        digest = md5(term.encode()).hexdigest()  # the sign comes from another part of the hash
        code = self[term] = int(digest[:8], 16) % self.dimensions * 2 + (digest[8] >= "8")
        return code


def hash_counts(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Signed white-space term counts per slot, as whole numbers in doubles; about ``PIECE_CHARS`` characters at a time."""
    width = 2 * dimensions

    def pieces(texts: pd.Series) -> Iterator[list[str]]:
        piece, chars = [], 0
        for t in texts:
            piece.append(t or "")
            chars += len(piece[-1])
            if chars >= PIECE_CHARS:
                yield piece
                piece, chars = [], 0
        if piece:
            yield piece

    def count(codes: _TermCodes, texts: list[str]) -> np.ndarray:
        rows = [t.split() for t in texts]
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(rows)), dtype=np.int64, count=sizes.sum())
        cells = np.repeat(np.arange(len(rows)) * width, sizes) + flat
        both = np.bincount(cells, minlength=len(rows) * width).reshape(len(rows), dimensions, 2)
        return (both[:, :, 0] - both[:, :, 1]).astype(np.float64)

    @F.pandas_udf("array<double>")
    def count_slots(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codes = _TermCodes(dimensions)
        for texts in batches:
            yield pd.Series([v for piece in pieces(texts) for v in count(codes, piece)])

    return count_slots(text)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""

    @F.pandas_udf("array<double>")
    def unit(raw: pd.Series) -> pd.Series:
        if not len(raw):
            return raw
        m = np.stack([np.asarray(x, dtype=np.float64) for x in raw])
        size = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return pd.Series(list(np.divide(m, size, out=m, where=size > 1e-10)))

    return unit(v)


def embed(df: DataFrame, text_col: str, out: str = "vec", fn: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add a unit vector. ``fn`` maps the text column to a raw vector column.

    The default hashes terms into ``DIMENSIONS`` slots. To use a model, pass an iterator
    ``pandas_udf`` that loads it once per Python worker.
    """
    return df.withColumn(out, normalise((fn or hash_counts)(F.col(text_col))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, 0 when either side has no length."""
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )
    size = norm(F.transform(a, lambda x: x.cast("double"))) * norm(F.transform(b, lambda x: x.cast("double")))
    return F.when(size > 1e-10, dot / size).otherwise(F.lit(0.0))
