"""Metric facts and evaluation."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import evaluation as ev
from shelfmark.operators import facts as fx

SENTENCE = "豪威集团2024年收入为3574百万美元，预计2025年净利润达到50.5亿元人民币，市场份额占比15.2%，ROE为12.3%。"


def test_example_sentence_gives_four_facts(spark):
    df = spark.createDataFrame([(1, SENTENCE), (2, "没有数字的句子"), (3, None)], "page int, text string")
    got = [tuple(r)[2:] for r in fx.extract_facts(df, min_chars=1).orderBy("fact_no").collect()]
    assert got == [
        ("豪威集团", "收入", "收入", 3574.0, "百万美元", "2024", 0),
        ("豪威集团", "净利润", "净利润", 50.5, "亿元人民币", "2025", 1),
        ("豪威集团", "市场份额", "市场份额占比", 15.2, "%", "2024", 0),
        ("豪威集团", "ROE", "ROE", 12.3, "%", "2024", 0),
    ]
    assert fx.extract_facts(df).count() == 0  # pages below a hundred characters are skipped


def test_other_periods_and_negative_numbers(spark):
    df = spark.createDataFrame([(1, "某公司1H25净利率为-3.5%；FY24收入1,234.5亿元；2026E年毛利率为40%")], "page int, text string")
    got = [(r.metric, r.value, r.unit, r.year, r.is_estimate) for r in fx.extract_facts(df, min_chars=1).orderBy("fact_no").collect()]
    assert got == [("净利率", -3.5, "%", "1H25", 0), ("收入", 1234.5, "亿元", "FY24", 0), ("毛利率", 40.0, "%", "2026", 1)]


def test_json_facts_need_company_metric_year(spark):
    rows = [
        (1, '```json\n[{"company": "A", "metric": "收入", "year": "2024", "value": 1.5}, {"company": "", "metric": "x", "year": "1"}]\n```'),
        (2, '[{"company": "A"'), (3, "[]"), (4, None),
    ]
    got = fx.facts_from_json(spark.createDataFrame(rows, "page int, json string")).collect()
    assert [(r.page, r.company, r.value, r.is_estimate) for r in got] == [(1, "A", 1.5, 0)]


def test_best_fact_prefers_confidence_then_page(spark):
    rows = [("A", "m", "24", 1, 1, 0, "low"), ("A", "m", "24", 3, 9, 1, "late"), ("A", "m", "24", 3, 2, 2, "best"), ("A", "m", "24", 3, 2, 3, "dup")]
    df = spark.createDataFrame(rows, "company string, metric string, year string, confidence int, source_page int, seq int, v string")
    assert [r.v for r in fx.best_fact(df).collect()] == ["best"]


def test_only_queries_are_accepted(spark):
    df = spark.createDataFrame([("A", 1.0)], "company string, value double")
    rows = fx.query_metrics(spark, df, "select value from financial_metrics where company = :c", {"c": "A"}).collect()
    assert rows[0].value == 1.0
    with pytest.raises(fx.BadInput):
        fx.query_metrics(spark, df, "WITH x AS (SELECT 1 AS a) INSERT INTO t SELECT a FROM x")
    assert not spark.catalog.tableExists("financial_metrics")
    for bad in ("DROP TABLE x", "  insert into t values (1)", ""):
        with pytest.raises(fx.BadInput):
            fx.query_metrics(spark, df, bad)


def test_citation_line(spark):
    df = spark.createDataFrame([("A", "收入", 1, 2.5, None, "2025", "a.pdf", 3), ("B", "x", 0, None, "%", "24", None, None)],
                               "company string, metric string, is_estimate int, value double, unit string, year string, source_file string, source_page int")
    first = df.select(fx.fact_lines(None)).first()[0]
    assert first == "A | 收入（预测值） = 2.5  [2025]\n  📄 来源: a.pdf · 第 3 页"


def test_average_precision_and_recall(spark):
    rows = [(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1)]
    ranked = spark.createDataFrame(rows, "query_id int, chunk_id string, rank int")
    truth = spark.createDataFrame([(1, "a"), (1, "c"), (1, "z")], "query_id int, chunk_id string")
    j = ev.judged(ranked, truth)
    assert {r.query_id: r.context_precision for r in ev.average_precision(j).collect()} == {1: 0.8333, 2: 0.0}
    sizes = spark.createDataFrame([(1, 3), (2, 0)], "query_id int, n_relevant long")
    got = {r.query_id: (r.hit, r.context_recall) for r in ev.recall(j, sizes).collect()}
    assert got == {1: (True, 0.6667), 2: (False, None)}


def test_summary_skips_small_and_blank_groups(spark):
    rows = [("a", 1.0, None, 0.5)] * 3 + [("b", 0.0, 1.0, 0.5)] * 2 + [(" ", 0.5, 0.0, None), (None, 0.5, 0.0, None)]
    df = spark.createDataFrame(rows, "industry string, context_precision double, context_recall double, faithfulness double")
    got = {(r.scope, r.industry): (r.context_precision, r.context_recall, r.faithfulness, r.n) for r in ev.eval_summary(df).collect()}
    assert got == {("global", None): (0.5714, 0.5, 0.5, 7), ("industry", "a"): (1.0, None, 0.5, 3)}
    flags = {r.scope: (r.low_recall, r.low_precision, r.low_faithfulness) for r in ev.eval_flags(ev.eval_summary(df)).collect()}
    assert flags == {"global": (False, False, True), "industry": (False, False, True)}


def test_samples_are_even_and_repeatable(spark):
    rows = [(f"{g}{i}", g, "x" * 120) for g, n in (("a", 50), ("b", 3), (None, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "chunk_id string, industry string, content string")
    one = ev.stratified_sample(df, 12).collect()
    counts = {g: sum(r.industry == g for r in one) for g in ("a", "b", ev.UNKNOWN_GROUP)}
    assert counts == {"a": 4, "b": 3, ev.UNKNOWN_GROUP: 4}
    assert sorted(one) == sorted(ev.stratified_sample(df.repartition(7), 12).collect())
    assert ev.stratified_sample(df, 2).count() == 2
    assert ev.sample_n(df, "chunk_id", 500).count() == len(rows)


def test_detail_columns(spark):
    df = spark.createDataFrame(
        [("q", "i", 1, "a\nb" + "c" * 100, 1.0, None, None, True, ["x", "y"], [("f", 1)])],
        "question string, industry string, page int, chunk_text string, context_precision double, context_recall double, "
        "faithfulness double, retrieve_ok boolean, contexts array<string>, sources array<struct<file:string,page:int>>",
    )
    r = ev.eval_detail(df).first()
    assert r.chunk_text_preview == "a b" + "c" * 77 and r.contexts_count == 2 and r.sources == '[{"file":"f","page":1}]'


def test_statements_see_the_fact_table_alone(spark, tmp_path):
    facts = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "company string, value double")
    base = fx.MetricBase(facts)
    spark.createDataFrame([("s",)], "secret string").createOrReplaceTempView("secrets")
    spark.range(3).write.parquet(path := str(tmp_path / "other"))
    spark.sql(f"CREATE TABLE catalogued USING parquet LOCATION '{path}'")
    try:
        refused = [
            "SELECT * FROM secrets", f"SELECT * FROM parquet.`{path}`", "SELECT * FROM catalogued", "SELECT * FROM default.catalogued",
            "SELECT (SELECT max(secret) FROM secrets) AS x FROM financial_metrics", f"SELECT * FROM financial_metrics WHERE value IN (SELECT id FROM parquet.`{path}`)",
            "SELECT * FROM financial_metrics WHERE EXISTS (SELECT 1 FROM spark_catalog.default.catalogued)",
            "SELECT * FROM financial_metrics JOIN catalogued ON true", "SELECT * FROM range(5)", "SELECT * FROM global_temp.secrets",
            "SELECT value FROM (WITH f AS (SELECT * FROM catalogued) SELECT 1 AS value FROM f)", "SELECT nothing FROM financial_metrics", "SELECT FROM WHERE",
        ]
        for sql in refused:
            with pytest.raises(fx.BadInput):
                base.query(sql)
        assert base.query("SELECT sum(value) AS s FROM Financial_Metrics f WHERE company IN (SELECT company FROM financial_metrics)").first().s == 3.0
        assert base.query("SELECT value FROM financial_metrics WHERE company = :c", {"c": "B"}).first().value == 2.0
        assert base.query("SELECT 'UnresolvedRelation [x]' AS t FROM financial_metrics LIMIT 1").first().t
        assert spark.table("secrets").count() == 1 and not spark.catalog.tableExists("financial_metrics")
    finally:
        spark.sql("DROP TABLE catalogued")
        spark.catalog.dropTempView("secrets")
