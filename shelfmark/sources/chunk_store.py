"""A stored chunk table with upserts that rewrite only what they touch.

Chunks lie in buckets by the hash of their source and, inside a bucket, in a folder per industry, so a read by source or
industry opens few folders. An upsert reads the buckets its sources fall into, writes them anew into a folder of its own
version, and commits a pointer that says in which version's folder each bucket lies now (``sources/versions``). Buckets it
does not touch keep their files, a writer that dies leaves the old table, and a reader that opened a version keeps it
until it is vacuumed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.sizing import broadcast_if_bounded
from shelfmark.operators import ingest
from shelfmark.sources.versions import VersionLog

BUCKETS = 64
NO_INDUSTRY = "__none__"


@dataclass(frozen=True)
class Store:
    """One committed version: ``at`` maps each bucket with rows to the version whose folder holds it."""

    root: str
    version: int
    buckets: int
    schema: T.StructType
    at: dict[int, int] = field(default_factory=dict)
    note: dict = field(default_factory=dict)


def open_store(spark: SparkSession, root: str) -> Store | None:
    """The newest committed version; None before the first."""
    version, d = VersionLog(spark, root).latest()
    if not version:
        return None
    at = {int(b): v for b, v in d["at"].items()}
    return Store(root.rstrip("/"), version, d["buckets"], T.StructType.fromJson(d["schema"]), at, d.get("note", {}))


def bucket_of(source, buckets: int):
    return F.pmod(F.xxhash64(source), F.lit(buckets)).cast("int")


def _folders(spark: SparkSession, store: Store, buckets) -> DataFrame:
    paths = [f"{store.root}/data/version={store.at[b]}/bucket={b}" for b in buckets if b in store.at]
    layout = T.StructType([*store.schema.fields, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])
    if not paths:
        return spark.createDataFrame([], layout)
    return spark.read.schema(layout).option("basePath", f"{store.root}/data").parquet(*paths)


def read_store(spark: SparkSession, store: Store, source: str | None = None, industry: str | None = None) -> DataFrame:
    """All chunks, or those of one source or industry: only the bucket of the source and the folders of the industry are opened.

    A filter that a caller adds on ``industry``, a join with a small filtered table included, prunes folders as well. A
    chunk without an industry has ``NO_INDUSTRY``, which is a folder's name.
    """
    buckets = sorted(store.at)
    if source is not None:
        hashed = spark.range(1).select(bucket_of(F.lit(source), store.buckets)).first()[0]
        buckets = [hashed]
    rows = _folders(spark, store, buckets)
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    if industry is not None:
        rows = rows.filter(F.col("industry") == industry)
    return rows.select(*store.schema.fieldNames())


def upsert_chunks(
    updates: DataFrame, root: str, removed: DataFrame | None = None, *, by: str = "chunk_id", seq: str | None = None,
    buckets: int = BUCKETS, note: dict | None = None,
) -> Store:
    """Put ``updates(chunk_id, source, industry, ...)`` into the table below ``root`` and return its new version.

    With ``by="chunk_id"`` a chunk replaces the one of its id within its source and others stay; with ``by="source"`` a
    source that comes replaces all its old chunks. ``removed(source)`` go. Of rows with one id the last by ``seq`` counts
    (``seq`` is not stored). ``note`` is kept with the version: an upsert whose note equals the last one has been done
    before and changes nothing, so a repeated micro-batch is harmless. ``buckets`` counts when the table is made.
    """
    spark, log = updates.sparkSession, VersionLog(updates.sparkSession, root)
    old = open_store(spark, root)
    if old and note and old.note == note:
        return old
    columns = [c for c in updates.columns if c != seq]
    if old:
        buckets, columns = old.buckets, old.schema.fieldNames()
    fresh = updates.withColumn("industry", F.coalesce("industry", F.lit(NO_INDUSTRY)))
    if seq:
        fresh = ingest.first_per_key(fresh, ["chunk_id"], [F.col(seq)], last=True)
    fresh = fresh.select(*columns, bucket_of(F.col("source"), buckets).alias("bucket"))
    schema = old.schema if old else fresh.drop("bucket").schema
    touched = fresh.select("source")
    if removed is not None:
        touched = touched.unionByName(removed.select("source"))
    # one number per bucket at most
    hit = [r[0] for r in touched.select(bucket_of(F.col("source"), buckets).alias("b")).distinct().collect()]
    if old:
        before = _folders(spark, old, hit).drop("version")
        if by == "source":
            before = before.join(broadcast_if_bounded(touched.distinct()), "source", "left_anti")
        else:
            if removed is not None:
                before = before.join(broadcast_if_bounded(removed.select("source").distinct()), "source", "left_anti")
            before = before.join(fresh.select("source", "chunk_id"), ["source", "chunk_id"], "left_anti")
        fresh = before.select(*fresh.columns).unionByName(fresh)
    version = log.next()
    path = f"{root.rstrip('/')}/data/version={version}"
    # a source that holds a third of all chunks fills several tasks of its bucket
    fresh.hint("rebalance", "bucket").sortWithinPartitions("bucket", "industry", "source").write.mode("overwrite").partitionBy("bucket", "industry").parquet(path)
    at = {**(old.at if old else {})}
    for b in hit:
        at.pop(b, None)
    at |= {int(name.removeprefix("bucket=")): version for name in log.folders(path) if name.startswith("bucket=")}
    log.commit(version, {"buckets": buckets, "schema": schema.jsonValue(), "at": at, "note": note or {}})
    return open_store(spark, root)


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete folders that none of the newest ``keep`` versions names and return their number.

    Nobody may be reading an older version, and no upsert may be running: its folder is not named yet.
    """
    log = VersionLog(spark, root)
    documents = [d for n in log.numbers() if (d := log.read(n)) is not None][-keep:]
    named = {(v, int(b)) for d in documents for b, v in d["at"].items()}
    gone = 0
    data = f"{root.rstrip('/')}/data"
    for version in log.folders(data):
        number = int(version.removeprefix("version="))
        for bucket in log.folders(f"{data}/{version}"):
            if bucket.startswith("bucket=") and (number, int(bucket.removeprefix("bucket="))) not in named:
                log.delete(f"{data}/{version}/{bucket}")
                gone += 1
    return gone
