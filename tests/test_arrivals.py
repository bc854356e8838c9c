"""Streams over tables in folders and over parts of several files."""

from pyspark.sql import functions as F

from shelfmark.functions.session import work_dir
from shelfmark.plans.bindings import Tables
from shelfmark.plans.streams import stream_ingest
from shelfmark.streaming.runner import arrivals, collect_batches, stream_table


def test_a_part_of_many_files_is_one_batch(spark):
    parts = [spark.range(i * 1000, i * 1000 + n, numPartitions=8).toDF("id") for i, n in enumerate([500, 3, 0, 700])]
    folder = work_dir(spark, "arrivals")
    got = collect_batches(arrivals(parts, folder, files=6), "append").groupBy("batch").agg(F.min("id"), F.max("id"), F.count("*")).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 499, 500), (1, 1000, 1002, 3), (3, 3000, 3699, 700)]
    sizes = [r[0] for r in spark.read.parquet(f"{folder}/part=0").groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(sizes) == 6 and max(sizes) < 200


def test_a_table_may_be_a_folder_of_files(spark):
    folder = work_dir(spark, "tables")
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows.repartition(3).write.parquet(f"{folder}/documents.parquet")
    assert collect_batches(stream_table(spark, folder, "documents", rows.schema), "append").count() == 40
    assert stream_ingest(Tables(spark, folder)).count() == 40
