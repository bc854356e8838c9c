"""Writers: table exports, reports, thread documents, timing logs."""

from __future__ import annotations

import time
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from shelfmark.operators.evaluation import eval_detail, eval_summary
from shelfmark.operators.transcripts import message_view, thread_markdown

EXPORT_MODES = ("timestamp", "overwrite", "append")


class HeaderMismatch(ValueError):
    """An append would put values under other column names."""


class BadMode(ValueError):
    """Unknown export mode."""


#: Quotes inside a cell are doubled, so cells may hold quotes and line breaks.
CSV = {"header": True, "escape": '"'}


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line; text is written as it is, not escaped."""
    df.write.mode(mode).json(path)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.csv(path, **CSV, multiLine=True)
    except AnalysisException:
        return None


def stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")


def export_table(df: DataFrame, path: str, mode: str = "timestamp", *, keep_backup: bool = False) -> str:
    """Write ``df`` as CSV with a header and return where it went.

    ``timestamp`` takes a new folder, ``overwrite`` replaces, ``append`` adds to a table with
    the same header. ``keep_backup`` first copies what is there to a stamped folder.
    """
    if mode not in EXPORT_MODES:
        raise BadMode(f"mode must be one of {sorted(EXPORT_MODES)}")
    spark, now = df.sparkSession, stamp()
    if mode == "timestamp":
        path = f"{path}_{now}"
        df.write.options(**CSV).csv(path)
        return path
    there = _existing(spark, path)
    if there is not None:
        if mode == "append" and there.columns != df.columns:
            raise HeaderMismatch(f"table has {there.columns}, rows have {df.columns}")
        if keep_backup:
            there.write.options(**CSV).csv(f"{path}_backup_{now}")
    df.write.mode(mode).options(**CSV).csv(path)
    return path


def write_eval_report(records: DataFrame, folder: str) -> tuple[str, str]:
    """Summary as JSON lines and detail as CSV, in stamped folders below ``folder``."""
    now = stamp()
    summary, detail = f"{folder}/eval_summary_{now}", f"{folder}/eval_detail_{now}"
    eval_summary(records).withColumn("generated_at", F.current_timestamp()).write.json(summary)
    eval_detail(records).write.option("header", True).csv(detail)
    return summary, detail


def export_threads(messages: DataFrame, path: str, fmt: str = "markdown") -> None:
    """Conversations as text or JSON lines, a folder per conversation range.

    Rows are range partitioned by conversation and position, so a conversation is one run of
    lines in file order however long it is.
    """
    if fmt == "markdown":
        parts = thread_markdown(messages)
        ordered = parts.repartitionByRange("conv_id", "part").sortWithinPartitions("conv_id", "part")
        ordered.select(F.rtrim(F.col("section"), F.lit("\n")).alias("value")).write.option("lineSep", "\n\n").text(path)
    elif fmt == "json":
        rows = message_view(messages)
        rows.repartitionByRange("conv_id", "seq").sortWithinPartitions("conv_id", "seq").write.json(path)
    else:
        raise ValueError(f"unknown format {fmt}")


@contextmanager
def timed(spark: SparkSession, stage: str, log_path: str, doc_count: int | None = None, token_count: int | None = None, **meta):
    """Append one timing record for the block to a JSON log, also when the block fails."""
    start, status = time.perf_counter(), "success"
    try:
        yield
    except Exception as e:
        status = f"failed: {type(e).__name__}"
        raise
    finally:
        seconds = time.perf_counter() - start
        row = spark.range(1).select(
            F.current_timestamp().alias("ts"), F.lit(stage).alias("stage"), F.lit(status).alias("status"),
            F.lit(round(seconds, 3)).alias("elapsed_s"),
            F.lit(None if token_count is None else round(token_count / seconds, 1)).cast("double").alias("tokens_per_sec"),
            F.lit(None if doc_count is None else round(doc_count / seconds, 3)).cast("double").alias("docs_per_sec"),
            F.create_map(*[F.lit(str(x)) for kv in meta.items() for x in kv]).cast("map<string,string>").alias("meta")
            if meta else F.lit(None).cast("map<string,string>").alias("meta"),
        )
        row.write.mode("append").json(log_path)
