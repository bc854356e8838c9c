"""Broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 200_000
MAX_BYTES = 64 * 1024 * 1024


def is_bounded(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and about ``max_bytes`` bytes.

    Rows and bytes are summed where they are read; each task hands on two numbers.
    """
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, total = df.agg(F.count("*"), size).first()
    return rows <= max_rows and (total or 0) <= max_bytes


def broadcast_if_bounded(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Hint a broadcast after a size check; beyond it the join is left to shuffle + AQE."""
    return F.broadcast(df) if is_bounded(df, max_rows, max_bytes) else df


def spread(scan: DataFrame, most: int = 64) -> DataFrame:
    """Give CPU-heavy row work enough tasks when a *file scan* has too few.

    A big table has more splits than that and is returned as it is, without a shuffle.
    """
    tasks = min(scan.sparkSession.sparkContext.defaultParallelism, most)
    return scan if scan.rdd.getNumPartitions() >= tasks else scan.repartition(tasks)


def spread_rows(df: DataFrame, per_task: int) -> DataFrame:
    """Give CPU-heavy work on short rows a task per ``per_task`` rows, however few bytes they take; a stream is left alone.

    The count reads only what decides the number of rows.
    """
    if df.isStreaming:
        return df
    rows = df.agg(F.count("*")).first()[0]
    return df.repartition(-(-rows // per_task)) if rows > per_task else df
