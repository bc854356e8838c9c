"""Rows that are easily lost or miscounted."""

import math

from pyspark.sql import functions as F

from shelfmark.operators import cache, evaluation, fusion
from shelfmark.operators import requests as rq
from shelfmark.operators import transcripts as tr
from shelfmark.sources import corpus, sinks
from shelfmark.streaming import ingest_stream


def test_results_without_id_stay_apart(spark):
    schema = "query_id int, chunk_id string, rank int, content string"
    lexical = spark.createDataFrame([(1, None, 1, "one text"), (1, None, 2, "two text"), (1, "a", 3, "three")], schema)
    dense = spark.createDataFrame([(1, None, 1, "two text"), (1, "a", 2, "three")], schema)
    rows = fusion.rrf_fuse(lexical, dense).orderBy("rank").collect()
    assert [(r["chunk_id"], r["bm25_rank"], r["vec_rank"]) for r in rows] == [(None, 2, 1), ("a", 3, 2), (None, 1, None)]
    assert fusion.rrf_fuse(lexical.drop("content"), None).count() == 3


def test_exact_only_entries_do_not_answer_near_questions(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    schema = "entry_id int, query_hash string, vec array<double>, created_at timestamp_ntz, expires_at timestamp_ntz, write_semantic boolean"
    rows = spark.sql("SELECT timestamp_ntz'2023-12-31' c, timestamp_ntz'2024-02-01' e").first()
    entries = spark.createDataFrame(
        [(1, "h1", [1.0, 0.0], rows.c, rows.e, False), (2, "h2", None, rows.c, rows.e, True), (3, "h3", [0.98, math.sqrt(1 - 0.98**2)], rows.c, rows.e, True)], schema
    )
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, vec array<double>")
    assert [r["entry_id"] for r in cache.semantic_probe(asked, entries, now).collect()] == [3]


def test_budget_counter_stops(spark):
    limited = spark.createDataFrame(
        [(i, f"2024-01-01 00:0{i}:00", "b", 300, False) for i in range(5)], "request_id int, ts string, bucket string, tokens int, rejected boolean"
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows = rq.token_budget(limited, 600).orderBy("request_id").collect()
    assert [r["used_before"] for r in rows] == [0, 300, 600, 600, 600]
    assert [r["reason"] for r in rows] == [None, None, "budget", "budget", "budget"]


def test_null_latency_is_no_observation(spark):
    rows = rq.latency_hist(spark.createDataFrame([("a", 1.0), ("a", None)], "l string, v double"), ["l"], "v", [2.0]).collect()
    assert {r["count"] for r in rows} == {1}


def test_missing_precision_counts_as_zero(spark):
    rows = [("x", 1.0, 1.0, 1.0), ("x", float("nan"), None, 1.0), ("x", None, 1.0, None)]
    got = evaluation.eval_summary(spark.createDataFrame(rows, "industry string, context_precision double, context_recall double, faithfulness double"))
    total = got.filter("scope = 'global'").first()
    assert (total["context_precision"], total["context_recall"], total["faithfulness"]) == (0.3333, 1.0, 1.0)


def test_payload_of_which_nothing_fits_keeps_its_flags(spark):
    items = spark.createDataFrame([(1, 0, "x" * 50), (1, 1, "y"), (2, 0, "z")], "payload_id int, pos int, piece string")
    rows = {r["payload_id"]: r for r in tr.bounded_payload(items, 10).collect()}
    assert (rows[1]["piece"], rows[1]["kept_results"], rows[1]["total_results"], rows[1]["truncated"]) == (None, 0, 2, True)
    assert rows[2]["piece"] == "z" and not rows[2]["truncated"]


def test_cells_keep_line_breaks_and_quotes(spark, tmp_path):
    rows = [("a\nb", 'say "hi", you'), ("c", "d")]
    path = sinks.export_table(spark.createDataFrame(rows, "x string, y string"), str(tmp_path / "t"), "overwrite")
    assert sorted((r["x"], r["y"]) for r in corpus.read_rows(spark, path).collect()) == sorted(rows)
    sinks.export_table(spark.createDataFrame([("e", "f")], "x string, y string"), path, "append", keep_backup=True)
    assert corpus.read_rows(spark, path).count() == 3


def test_path_twice_in_a_batch_keeps_its_last_version(spark, tmp_path):
    docs = spark.createDataFrame([("p", "old words here", 1), ("p", "new words here", 2), ("q", "other", 1)], "path string, text string, seq int")
    ingest_stream.ingest_batch(docs, 0, str(tmp_path))
    got = {(r["path"], r["content"]) for r in ingest_stream.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {("p", "new words here"), ("q", "other")}


def test_industry_tag_takes_the_first_category(spark):
    texts = spark.createDataFrame([("芯片与电力",), ("风电",), ("nothing",), (None,)], "t string")
    assert [r[0] for r in texts.select(evaluation.industry_tag(F.col("t"))).collect()] == ["半导体", "电力", None, None]
