"""Text helpers against plain Python."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as tx

SAMPLES = [186.5, 187.5, 0.0, 0.125, 0.375, 1.25, 1.15, 2.675, 0.05, 0.0036, 999.95, 12345.005, 0.995, 6.52949999]


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_fixed_text_rounds_like_python(spark, digits):
    df = spark.createDataFrame(pd.DataFrame({"x": SAMPLES + [-s for s in SAMPLES if s > 1]}))
    for r in df.select("x", tx.fixed_text(F.col("x"), digits).alias("t")).collect():
        assert r.t == f"{r.x:.{digits}f}"


def test_strip_and_tokens_treat_unicode_space_like_python(spark):
    raw = ["  a　b\xa0", "\n\t", "", "x y  z", "\x1cq\x1f"]
    df = spark.createDataFrame([(s,) for s in raw], "s string")
    rows = df.select("s", tx.strip(F.col("s")).alias("strip"), tx.tokens(F.col("s")).alias("tok")).collect()
    for r in rows:
        assert r["strip"] == r.s.strip() and r.tok == r.s.split()


@pytest.mark.parametrize(
    "raw,want",
    [
        ("```sql\nSELECT 1\n```", "SELECT 1"),
        ("```\nselect 2```", "select 2"),
        ("Sure: SELECT a FROM t;", "SELECT a FROM t;"),
        ("nothing here", "nothing here"),
    ],
)
def test_extract_sql(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(tx.extract_sql(F.col("s"))).first()[0] == want


@pytest.mark.parametrize(
    "raw,want",
    [
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ('{"a": 1}', '{"a": 1}'),
        ('see {"a": {"b": 2}} ok', '{"a": {"b": 2}}'),
        ("see {broken} ok", "see {broken} ok"),
    ],
)
def test_extract_json(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(tx.extract_json_object(F.col("s"))).first()[0] == want


def test_trims_and_clamp(spark):
    df = spark.createDataFrame([(" Hello World ", "12"), ("Hi", "x"), (None, "-4")], "s string, n string")
    s = F.col("s")
    rows = df.select(
        tx.trim_three_dots(s, 5).alias("a"), tx.trim_one_dot(s, 5).alias("b"), tx.trim_clean_end(s, 6).alias("c"),
        tx.trim_one_dot(s, 0).alias("d"), tx.clamp_int(F.col("n"), 3, 1, 10).alias("n"),
    ).collect()
    assert [tuple(r) for r in rows] == [("He...", "Hell…", "Hello...", "", 10), ("Hi", "Hi", "Hi", "", 3), ("", "", "", "", 1)]


def test_char_bigrams(spark):
    df = spark.createDataFrame([("豪威 集团",), ("x",), ("",)], "s string")
    assert [r[0] for r in df.select(tx.char_bigrams(F.col("s"))).collect()] == [["豪威", "威集", "集团"], ["x"], []]
