"""Readers for corpora, tables of records and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.text import strip
from shelfmark.functions.windows import join_back, running

# File kinds of a corpus, record layouts.
CORPUS_SUFFIXES = (".pdf", ".docx", ".txt", ".csv", ".md", ".markdown", ".xlsx", ".xls", ".py")
SHEET = "__sheet__"
EVAL_SCHEMA = "question string, ground_truth string, source_file string, page int, industry string, chunk_text string"
USAGE_SCHEMA = (
    "ts timestamp, username string, thread_id string, question string, latency_ms double, "
    "prompt_tokens bigint, completion_tokens bigint, reasoning_tokens bigint, cache_hit_tokens bigint, "
    "cache_miss_tokens bigint, total_tokens bigint, estimated_cost_usd double, llm_call_count bigint, tool_runs_count bigint"
)
STAGE_SCHEMA = "ts timestamp, stage string, status string, elapsed_s double, tokens_per_sec double, docs_per_sec double"


def list_corpus(spark: SparkSession, root: str, suffixes=CORPUS_SUFFIXES) -> DataFrame:
    """``(path, length, modified)`` of all files below ``root`` of a known kind.

    The file content is not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    pattern = "(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"
    return files.filter(F.lower("path").rlike(pattern)).select(
        "path", "length", F.col("modificationTime").alias("modified")
    )


def hash_files(spark: SparkSession, paths_root: str, suffixes=CORPUS_SUFFIXES) -> DataFrame:
    """``(path, hash)`` by content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths_root)
    pattern = "(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"
    return files.filter(F.lower("path").rlike(pattern)).select("path", F.md5("content").alias("hash"))


def read_text_docs(spark: SparkSession, paths) -> DataFrame:
    """One row per text file: ``(path, text)``."""
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all cells as text (line breaks in quotes included), plus the 0-based row number ``row``."""
    return with_row_number(spark.read.csv(path, header=True, multiLine=True, escape='"'))


def with_row_number(df: DataFrame) -> DataFrame:
    """Dense 0-based ``row`` in scan order, from one count per scan task.

    Scan order is stable for files that do not change, which is what ids derived from it need.
    """
    marked = df.withColumn("_id", F.monotonically_increasing_id())
    marked = marked.withColumns({"_task": F.shiftright("_id", 33), "_local": F.col("_id").bitwiseAND((1 << 33) - 1)})
    counts = marked.groupBy("_task").agg(F.count("*").alias("_n"))
    from pyspark.sql import Window

    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    return join_back(marked, offsets, ["_task"]).select(*df.columns, (F.col("_from") + F.col("_local")).alias("row"))


def rows_to_text(df: DataFrame, name: str, row: str = "row") -> DataFrame:
    """Each row as a sentence ``header：value；header：value``; blank cells and blank rows drop out."""
    cells = [c for c in df.columns if c not in (row, SHEET)]
    parts = [
        F.when(strip(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}："), F.col(c).cast("string"))) for c in cells
    ]
    return df.select(
        F.concat(F.lit(f"{name}::row_"), F.col(row).cast("string")).alias("chunk_id"),
        F.lit(name).alias("source"),
        F.col(row).cast("bigint").alias("row"),
        F.concat_ws("；", *parts).alias("content"),
    ).filter(F.col("content") != "")


def union_sheets(sheets: dict[str, DataFrame], order: dict[str, Column], slice_rows: int = 4096) -> DataFrame:
    """Stack sheets with unequal columns; adds the sheet name and a running ``row`` number.

    ``order`` gives the row order of each sheet as a whole-number column.
    """
    out = None
    for no, (name, df) in enumerate(sheets.items()):
        part = df.withColumns({SHEET: F.lit(name), "_no": F.lit(no), "_key": order[name].cast("bigint")})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    slices = F.struct(F.col("_no"), F.floor(F.col("_key") / slice_rows))
    numbered = running(out, [], slices, [F.col("_no"), F.col("_key")], {"row": F.lit(1)})
    return numbered.withColumn("row", F.col("row") - 1).drop("_no", "_key")


def read_eval_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records; lines that are not valid JSON are skipped."""
    return spark.read.schema(EVAL_SCHEMA).option("mode", "DROPMALFORMED").json(path).filter(
        strip(F.coalesce("question", F.lit(""))) != ""
    )


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USAGE_SCHEMA).json(path)


def stream_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(USAGE_SCHEMA).json(path)


def read_chunks(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def chunks_of(chunks: DataFrame, source: str) -> DataFrame:
    """Chunks of one source; the predicate reaches the scan."""
    return chunks.filter(F.col("source") == source)
