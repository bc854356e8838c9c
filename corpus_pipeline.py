"""The training-data pipeline: documents in, sharded mix out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.session import materialize, prepare, work_dir
from shelfmark.llm import decontam, kneser, mixing, neardup, sharding

SHARDS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held(docs: DataFrame) -> DataFrame:
    """``id`` and the whole row, so that no column of ``docs`` can clash with what a stage adds."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies between the fences of their language.

    Rows that repeat a ``doc_id`` go only if all of them are rejected. No documents or no labels: nothing goes.
    """
    judged = kneser.quality(docs, _table(spark, sf_dir, "labels"))
    rejected = judged.groupBy(F.col("doc_id").alias("id")).agg(F.max("kept").alias("kept")).filter("not kept").select("id")
    return _held(docs).join(rejected, "id", "left_anti").select("row.*")


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every group of near copies (five-word shingles, similarity 0.8).

    Documents without shingles or id stay. Rows that repeat a ``doc_id`` with the same text are copies, of which one stays
    (the first by its other columns as JSON); with different texts each is judged by its own text: the text of least MD5
    has the id's place in the order, the others come after all ids.
    """
    rows = _held(docs).withColumn("text", F.col("row.text"))
    repeated = rows.filter("id is not null").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    repeated = materialize(repeated, "repeated-ids")
    if not repeated.isEmpty():
        # every further text of an id gets a number of its own above all ids
        hashed = rows.join(repeated, "id", "left_semi").select("id", F.md5(F.coalesce("text", F.lit(""))).alias("h")).distinct()
        first = hashed.groupBy("id").agg(F.min("h").alias("h"))
        top = rows.agg(F.max("id")).first()[0]
        further = hashed.join(first, ["id", "h"], "left_anti").repartitionByRange("id", "h").sortWithinPartitions("id", "h")
        further = materialize(further.withColumn("own", F.lit(top + 1) + F.monotonically_increasing_id()), "further-texts")
        rows = rows.withColumn("h", F.md5(F.coalesce("text", F.lit("")))).join(further, ["id", "h"], "left")
        rows = rows.select(F.coalesce("own", "id").alias("id"), "row", "text")
    kept = neardup.near_duplicates(rows.select(F.col("id").alias("doc_id"), "text"), k=5, share=80)
    kept = kept.filter("kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    stay = rows.join(kept, "id", "left_semi")
    if not repeated.isEmpty():
        stay = stay.groupBy("id").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return stay.select("row.*").unionByName(docs.filter("doc_id is null"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that is a benchmark item up to a fifth of its words."""
    return decontam.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes words from, once for each reading of them that it begins (once or twice).

    A document that the mix does not reach, or that has no words, is left out. Rows that repeat a ``doc_id`` stand as
    often as the one read most; rows without an id stay once.
    """
    times = mixing.mix(docs).filter("taken > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("times")
    )
    read = _held(docs).join(times, "id").select("row", F.explode(F.sequence(F.lit(1), "times")))
    return read.select("row.*").unionByName(docs.filter("doc_id is null"))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.shards(docs, SHARDS)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", first_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed),
    ("sharding", sharded),
]

#: Training a model, edit distances and shingle verification have no SQL form: the tests check run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared work folder and read again."""
    prepare(spark)
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = work_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
