"""Corpus maintenance."""

import hashlib

from pyspark.sql import functions as F

from shelfmark.operators import ingest, layout, quality


def test_changed_docs(spark):
    docs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("gone", "9")], "path string, hash string")
    got = {r.path: r.status for r in ingest.changed_docs(docs, old).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "new", "gone": "missing"}


def test_upsert_is_idempotent_and_last_wins(spark):
    target = spark.createDataFrame([("a", "old"), ("b", "old")], "chunk_id string, content string")
    new = spark.createDataFrame([("b", "1", 1), ("b", "2", 2), ("c", "3", 1)], "chunk_id string, content string, seq int")
    once = ingest.upsert(target, new, ["chunk_id"], "seq")
    twice = ingest.upsert(once, new, ["chunk_id"], "seq")
    want = [("a", "old"), ("b", "2"), ("c", "3")]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))


def test_insert_ignore_keeps_the_first(spark):
    target = spark.createDataFrame([("a", "old")], "k string, v string")
    new = spark.createDataFrame([("a", "x", 1), ("b", "late", 2), ("b", "early", 1)], "k string, v string, seq int")
    assert sorted(map(tuple, ingest.insert_ignore(target, new, ["k"], "seq").collect())) == [("a", "old"), ("b", "early")]


def test_replace_sources_leaves_no_stale_chunk(spark):
    target = spark.createDataFrame([("s1", 0), ("s1", 1), ("s2", 0), ("s3", 0)], "source string, no int")
    new = spark.createDataFrame([("s1", 0)], "source string, no int")
    touched = spark.createDataFrame([("s1",), ("s3",)], "source string")
    assert sorted(map(tuple, ingest.replace_sources(target, new, touched).collect())) == [("s1", 0), ("s2", 0)]


def test_batches_are_cut_exactly_and_files_end_with_their_last_chunk(spark):
    sizes = {f"f{i}": n for i, n in enumerate([3, 4, 12, 1, 5, 9, 2, 7])}
    files = spark.createDataFrame(list(sizes.items()), "path string, n_chunks long")
    got = {r.path: (r.first_batch, r.last_batch) for r in ingest.batch_pack(files, 5).collect()}
    at, want = 0, {}
    for path in sorted(sizes, key=lambda p: (hashlib.md5(p.encode()).hexdigest(), p)):
        numbers = [i // 5 for i in range(at, at + sizes[path])]
        want[path] = (numbers[0], numbers[-1])
        at += sizes[path]
    assert got == want


def test_manifest_commits_complete_files_only(spark):
    docs = spark.createDataFrame([("a", "n1"), ("b", "n2")], "path string, hash string")
    packed = spark.createDataFrame([("a", 5, 0, 0), ("b", 9, 0, 1)], "path string, n_chunks long, first_batch long, last_batch long")
    old = spark.createDataFrame([("b", "o2"), ("z", "o9")], "path string, hash string")
    got = ingest.manifest_after(old, docs, packed, committed=0)
    assert sorted(map(tuple, got.collect())) == [("a", "n1"), ("b", "o2"), ("z", "o9")]


def test_delete_report_tells_missing_from_deleted(spark):
    target = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, n int")
    keys = spark.createDataFrame([("a",), ("x",)], "k string")
    assert sorted(map(tuple, ingest.deletion_report(target, keys, "k").collect())) == [("a", 2, True), ("x", 0, False)]
    assert [tuple(r) for r in ingest.delete_keys(target, keys, "k").collect()] == [("b", 1)]


def blocks(spark, rows):
    cols = "doc_id int, page int, block_no int, text string, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double"
    return spark.createDataFrame([(1, 1, i, t, float(x0), float(y0), float(x1), float(y0) + 10, 600.0, 800.0) for i, (t, x0, y0, x1) in enumerate(rows)], cols)


def test_two_columns_are_read_left_first(spark):
    page = blocks(spark, [("right top", 400, 100, 550), ("left low", 50, 300, 250), ("left top", 50, 100, 250)])
    r = layout.reading_order(page).first()
    assert r.two_columns and r.page_text == "left top\nleft low\nright top"


def test_narrow_gap_is_one_column(spark):
    page = blocks(spark, [("right", 310, 100, 550), ("left", 50, 300, 290), ("mid", 50, 50, 250)])
    r = layout.reading_order(page).first()
    assert not r.two_columns and r.page_text == "mid\nright\nleft"


def test_bands_and_short_blocks_go(spark):
    page = blocks(spark, [("header", 0, 55, 9), ("kept", 0, 57, 9), ("ab", 0, 100, 9), ("footer", 0, 735, 9)])
    assert [r.text for r in layout.outside_bands(page).collect()] == ["kept"]


def test_table_text_is_suppressed_from_forty_percent(spark):
    page = blocks(spark, [("inside", 0, 0, 100), ("edge", 60, 0, 160), ("free", 70, 0, 170)])
    box = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0)], "doc_id int, page int, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in layout.suppress_table_text(page, box).collect()] == ["free"]


def test_markdown_tables(spark):
    rows = [(1, 0, ["a", " b\n c "]), (1, 1, ["1"]), (1, 2, ["x|y", None, "spare"]), (2, 0, [])]
    df = spark.createDataFrame(rows, "table_id int, row_no int, cells array<string>")
    out = {r.table_id: r.markdown for r in layout.table_markdown(df).collect()}
    assert out == {1: "| a | b c |\n| --- | --- |\n| 1 |  |\n| x|y |  |"}
    escaped = {r.table_id: r.markdown for r in layout.table_markdown(df, escape_bars=True).collect()}
    assert "x\\|y" in escaped[1]


def test_document_issues(spark):
    rows = [(1, 1, "x" * 20, True), (2, 1, "y" * 300, False), (3, 1, "中" * 300, False), (3, 2, "", True)]
    pages = spark.createDataFrame(rows, "doc_id int, page int, text string, has_image boolean")
    got = {r.doc_id: r.issues for r in quality.doc_issues(quality.doc_profile(pages)).collect()}
    assert got == {1: quality.FULL_SCAN, 2: quality.GARBLED, 3: quality.PARTIAL_SCAN}


def test_boilerplate_only_near_the_start(spark):
    rows = [("本报告仅供\n某客户使用",), ("x" * 600 + "免责声明",), ("正文",)]
    df = spark.createDataFrame(rows, "c string")
    assert [r[0] for r in df.select(quality.is_boilerplate(F.col("c"))).collect()] == [True, False, False]
    q = spark.createDataFrame([("短",), ("请联系客服",), ("公司收入是多少",), (None,)], "q string")
    assert [r[0] for r in q.select(quality.is_noise_question(F.col("q"))).collect()] == [True, True, False, True]
