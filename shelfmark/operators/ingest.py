"""Incremental corpus maintenance: what changed, what to write, what to remember."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.windows import first_per_key, hash_slice, running

# Fixed value: chunks per write batch.
BATCH_SIZE = 5000


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; the bare file name when it lies elsewhere."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(
        F.substring_index(path, "/", -1)
    )


def industry_of(path: Column, root: str) -> Column:
    """First folder below ``root``; NULL outside of it."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.split_part(relative_path(path, root), F.lit("/"), F.lit(1)))


def chunk_identity(parts: DataFrame, root: str) -> DataFrame:
    """Add ``chunk_id`` and ``industry`` to ``parts(path, page, kind, no)``; kind is chunk or table."""
    name = relative_path(F.col("path"), root)
    return parts.withColumns(
        {
            "chunk_id": F.format_string("%s::page_%d::%s_%d", name, F.col("page"), F.col("kind"), F.col("no")),
            "industry": industry_of(F.col("path"), root),
        }
    )


def changed_docs(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(path, hash, status)`` with status new, changed, unchanged or missing.

    ``docs(path, hash)`` is the present corpus, ``manifest(path, hash)`` the last run.
    """
    old = manifest.select("path", F.col("hash").alias("_old"), F.lit(True).alias("_known"))
    status = (
        F.when(F.col("hash").isNull(), "missing")
        .when(F.col("_known").isNull(), "new")
        .when(F.col("hash").eqNullSafe(F.col("_old")), "unchanged")
        .otherwise("changed")
    )
    return docs.select("path", "hash").join(old, "path", "full_outer").select("path", "hash", status.alias("status"))


def upsert(target: DataFrame, updates: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Rows of ``updates`` replace rows of ``target`` with the same key; the last by ``seq`` wins.

    Running it twice gives the same table.
    """
    newest = first_per_key(updates, key, [F.col(seq)], last=True).drop(seq)
    kept = target.join(newest.select(*key), key, "left_anti")
    return kept.unionByName(newest.select(*target.columns))


def replace_sources(target: DataFrame, updates: DataFrame, touched: DataFrame) -> DataFrame:
    """Drop every chunk of a touched source before adding ``updates``.

    Unlike a bare upsert this leaves no stale chunk when a file got shorter, and removes
    files that are gone (touched, with no updates).
    """
    return target.join(touched.select("source").distinct(), "source", "left_anti").unionByName(
        updates.select(*target.columns)
    )


def insert_ignore(target: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Add rows whose key is not there yet; among new rows the first by ``seq`` wins."""
    first = first_per_key(new, key, [F.col(seq)]).drop(seq)
    return target.unionByName(first.join(target.select(*key), key, "left_anti").select(*target.columns))


def delete_keys(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows left after deleting ``keys``."""
    return target.join(keys.select(key).distinct(), key, "left_anti")


def deletion_report(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``(key, deleted, found)`` per requested key: tells a missing key from a deleted one."""
    counted = target.join(keys.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias("deleted"))
    return keys.select(key).distinct().join(counted, key, "left").select(
        key, F.coalesce("deleted", F.lit(0).cast("bigint")).alias("deleted"), F.col("deleted").isNotNull().alias("found")
    )


def batch_pack(files: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Assign chunks of ``files(path, n_chunks)`` to write batches of exactly ``batch_size``.

    Files follow each other in hash order; a file may span batches and is complete with
    ``last_batch``, the batch holding its last chunk.
    """
    order = [F.md5("path"), F.col("path")]
    ended = running(
        files.filter(F.col("n_chunks") > 0), [], hash_slice(F.col("path")), order, {"end": F.col("n_chunks").cast("bigint")}
    )
    start = F.col("end") - F.col("n_chunks")
    return ended.select(
        "path", "n_chunks",
        F.floor(start / batch_size).alias("first_batch"),
        F.floor((F.col("end") - 1) / batch_size).alias("last_batch"),
    )


def manifest_after(manifest: DataFrame, docs: DataFrame, packed: DataFrame, committed: int) -> DataFrame:
    """The manifest once batches up to ``committed`` are written.

    Only files whose last chunk is in a written batch get their new hash.
    """
    done = packed.filter(F.col("last_batch") <= committed).select("path").join(docs.select("path", "hash"), "path")
    return manifest.select("path", "hash").join(done.select("path"), "path", "left_anti").unionByName(done)


def index_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_type", "industry").agg(F.count("*").alias("chunk_count"))
