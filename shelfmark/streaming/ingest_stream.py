"""Incremental ingest: new documents in, chunks and manifest out.

Both tables are logs with one folder per micro-batch. A batch writes its chunks first and
its manifest entries after them, and rewrites its own folders when repeated. The current
corpus is what the newest manifest entry of each path points to, so a changed file replaces
all its old chunks without touching old folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.windows import first_per_key
from shelfmark.operators.chunking import chunk_docs
from shelfmark.operators.ingest import changed_docs
from shelfmark.sources.versions import VersionLog
from shelfmark.streaming.runner import run

CHUNK_SCHEMA = "path string, chunk_no int, content string, batch long"
#: Batches between two snapshots of the manifest.
COMPACT = 20
MANIFEST_SCHEMA = "path string, hash string, chunks long, batch long"


def _log(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Manifest entries of the batches up to ``before`` (all without it): the newest snapshot and the batches behind it."""
    files = VersionLog(spark, root)

    def numbers(folder: str) -> list[int]:
        done = [int(n.removeprefix("batch=")) for n in files.folders(f"{root}/{folder}") if n.startswith("batch=")]
        return [n for n in done if (before is None or n < before) and files.exists(f"{root}/{folder}/batch={n}/_SUCCESS")]

    snapshot = max(numbers("snapshots"), default=-1)
    parts = [spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/snapshots/batch={snapshot}")] if snapshot >= 0 else []
    later = [f"{root}/manifest/batch={n}" for n in numbers("manifest") if n > snapshot]
    if later:
        parts.append(spark.read.schema(MANIFEST_SCHEMA).option("basePath", f"{root}/manifest").parquet(*later))
    out = spark.createDataFrame([], MANIFEST_SCHEMA)
    for part in parts:
        out = out.unionByName(part.select(*out.columns))
    return out


def read_manifest(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Newest entry per path, of the batches up to ``before``."""
    return first_per_key(_log(spark, root, before), ["path"], [F.col("batch")], last=True)


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Current chunks: those written by the batch the manifest names for their path."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{root}/chunks")
    return chunks.join(read_manifest(spark, root).select("path", "batch"), ["path", "batch"], "left_semi").drop("batch")


def ingest_batch(docs: DataFrame, batch: int, root: str, compact: int = COMPACT) -> None:
    """One micro-batch of ``docs(path, text)``: skip what is unchanged, cut, write, commit.

    A path that comes twice counts once: its last version by ``seq`` if there is such a column, else by hash. Texts are
    shuffled only if they are new or changed. Every ``compact`` batches the manifest is written as a snapshot, so a batch
    reads one snapshot and the few batches behind it, however long the stream has run.
    """
    spark = docs.sparkSession
    order = [F.col("seq"), F.col("hash")] if "seq" in docs.columns else [F.col("hash")]
    hashed = docs.withColumn("hash", F.md5("text"))
    last = hashed.groupBy("path").agg(F.max_by("hash", F.struct(*order)).alias("hash"))
    # Earlier batches only: an own half-written entry of a failed attempt must not count.
    known = read_manifest(spark, root, before=batch)
    todo = changed_docs(last, known).filter(F.col("status").isin("new", "changed")).select("path", "hash")
    work = hashed.join(todo, ["path", "hash"], "left_semi").select("path", "text").dropDuplicates(["path"])
    cut = chunk_docs(work)
    cut.write.mode("overwrite").parquet(f"{root}/chunks/batch={batch}")
    written = spark.read.schema(CHUNK_SCHEMA).parquet(f"{root}/chunks/batch={batch}")
    counts = written.groupBy("path").agg(F.count("*").alias("chunks"))
    entries = todo.join(counts, "path", "left").select("path", "hash", F.coalesce("chunks", F.lit(0).cast("bigint")).alias("chunks"))
    entries.write.mode("overwrite").parquet(f"{root}/manifest/batch={batch}")
    if batch % compact == compact - 1:
        # the folder's name is the last batch that is in it; the entries keep the numbers of their own
        read_manifest(spark, root, before=batch + 1).write.mode("overwrite").parquet(f"{root}/snapshots/batch={batch}")


def ingest_stream(docs: DataFrame, root: str, checkpoint: str | None = None, compact: int = COMPACT) -> None:
    """Drain a stream of ``docs(path, text)`` into the tables below ``root``."""
    run(docs, lambda df, batch: ingest_batch(df, batch, root, compact), checkpoint=checkpoint or f"{root}/checkpoint")
