"""Extra columns with the names that operators and stages use themselves change nothing."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.session import prepare
from shelfmark.llm import queries
from tests.conftest import DATA

#: Names that the operators of this folder, the library's helpers and the pipeline give to columns on the way.
NAMES = (
    "trusted q mid low high kept smoothed s q1 q3 of all_mid _gone _kept _id _copy _times id row key n size hash bucket target turn taken rank words "
    "place piece slice small start shard slot label rep leader last n_shingles s1 s2 bands component_id alone bits extra most f least code rest i j side "
    "_own _other _slices t doc run h word form root a b n_a n_b conv head pos m fault initial symbol segment cost audit spread held_out score law"
).split()


def extended(df):
    return df.withColumns({c: F.lit(7).cast("int") for c in NAMES if c not in df.columns})


def plain(rows, columns):
    return Counter(tuple(round(r[c], 5) if isinstance(r[c], float) else r[c] for c in columns) for r in rows)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.startswith("op")])
def test_operators(spark, name, tmp_path):
    prepare(spark)
    keep = {"documents": 60, "conversations": 60, "labels": 10**6, "benchmark": 10**6}
    folders = {}
    for kind in ("bare", "wide"):
        folders[kind] = str(tmp_path / kind)
        for table, n in keep.items():
            df = spark.read.parquet(f"{DATA}/{table}.parquet")
            df = df.filter(F.col(df.columns[0]) < n)
            (extended(df) if kind == "wide" else df).write.parquet(f"{folders[kind]}/{table}.parquet")
    bare, wide = (queries.QUERIES[name](spark, folders[kind]) for kind in ("bare", "wide"))
    assert bare.columns == wide.columns and plain(bare.collect(), bare.columns) == plain(wide.collect(), bare.columns)


def test_stages(spark):
    import corpus_pipeline

    prepare(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        bare, wide = stage(spark, docs, DATA), stage(spark, extended(docs), DATA)
        if name != "sharding":
            assert wide.columns == extended(docs).columns
        assert plain(bare.collect(), bare.columns) == plain(wide.collect(), bare.columns), name


def test_near_dedup_keeps_every_text_of_a_repeated_id(spark):
    import corpus_pipeline

    text = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "abcde"}
    near = text["a"].replace("a29", "other")
    rows = [(1, text["b"], "x"), (1, text["a"], "x"), (1, text["a"], "w"), (2, near, "x"), (3, text["c"], "x"), (3, text["d"], "x"), (4, text["d"], "x"), (5, text["b"], "x"),
            (None, text["a"], "x"), (6, None, "x"), (6, "", "x"), (7, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    stay = [tuple(r) for r in corpus_pipeline.first_of_near_copies(spark, docs, DATA).collect()]
    groups = {c: [r for r in stay if r[1] and r[1].startswith(c)] for c in "abcd"}
    assert (None, text["a"], "x") in groups["a"] and len(groups["a"]) == 2 and len(groups["b"]) == len(groups["c"]) == len(groups["d"]) == 1
    assert groups["c"] == [(3, text["c"], "x")] and len([r for r in stay if not r[1]]) == 2
