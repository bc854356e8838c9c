"""Fact extraction: work per clause, and how many tasks share it."""

import time

from pyspark.sql import functions as F

from shelfmark.operators import facts as fx


def test_a_clause_takes_the_last_actual_period_before_it(spark):
    texts = ["某公司2024年收入为1元，净利润为2元，预计2025年收入为3元，毛利率为4%，FY23市值为5元，收入为6元；2026E年收入为7元，收入为8元",
             "某公司2026E年收入为1元，净利润为2元", "，，某公司1H25收入为1元，，净利润为2元", "没有数字", "", None]
    got = fx.extract_facts(spark.createDataFrame(list(enumerate(texts)), "page int, text string"), min_chars=1)
    years = {(r.page, r.fact_no): (r.year, r.is_estimate) for r in got.collect()}
    assert years == {
        (0, 0): ("2024", 0), (0, 1): ("2024", 0), (0, 2): ("2025", 1), (0, 3): ("2024", 0), (0, 4): ("FY23", 0), (0, 5): ("FY23", 0),
        (0, 6): ("2026", 1), (0, 7): ("FY23", 0), (1, 0): ("2026", 1), (2, 0): ("1H25", 0), (2, 2): ("1H25", 0),
    }


def test_short_pages_are_shared_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(fx, "PAGES_PER_TASK", 50, raising=False)
    pages = spark.range(400, numPartitions=1).select("id", F.lit("某公司2024年收入为1元，净利润为2元").alias("text"))
    got = fx.extract_facts(pages, min_chars=1).withColumn("task", F.spark_partition_id())
    assert got.count() == 800 and got.select("task").distinct().count() == 8


def test_a_page_of_many_clauses_is_read_in_proportion(spark):
    n = 6000
    pages = spark.createDataFrame([(1, "某公司2024年收入为1元" + "，净利润为2元" * n)], "id int, text string")
    start = time.time()
    assert fx.extract_facts(pages).filter("year = '2024'").count() == n + 1
    assert time.time() - start < 10
