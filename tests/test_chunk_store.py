"""The stored chunk table: upserts, what they leave alone, pruned reads, dead writers."""

import os
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.session import work_dir
from shelfmark.sources import chunk_store as store
from shelfmark.sources.versions import VersionLog

SCHEMA = "chunk_id string, source string, industry string, content string"


def rows(*names, text="x"):
    return [(f"{s}::{i}", s, None if s == "d" else "bank" if s < "c" else "chips", f"{text} {i}") for s in names for i in range(3)]


def put(spark, data, root, removed=(), **how):
    gone = spark.createDataFrame([(s,) for s in removed], "source string") if removed else None
    return store.upsert_chunks(spark.createDataFrame(data, SCHEMA), root, gone, buckets=8, **how)


def read(spark, root, **which):
    return sorted(map(tuple, store.read_store(spark, store.open_store(spark, root), **which).collect()))


def shown(data):
    return sorted((i, s, k or store.NO_INDUSTRY, t) for i, s, k, t in data)


def files(spark, root):
    df = store.read_store(spark, store.open_store(spark, root)).select(F.input_file_name().alias("f")).distinct()
    return {r.f: os.path.getmtime(r.f.removeprefix("file:").replace("///", "/")) for r in df.collect()}


def test_upsert_by_id_by_source_and_removal(spark):
    root = work_dir(spark, "store")
    assert store.open_store(spark, root) is None
    put(spark, rows("a", "b", "c", "d"), root)
    assert read(spark, root) == shown(rows("a", "b", "c", "d"))
    new = rows("a", text="new")[:1] + [("b::9", "b", "bank", "added")]
    for _ in range(2):  # a repeated upsert changes nothing
        put(spark, new, root)
        assert read(spark, root) == shown(rows("a")[1:] + rows("b", "c", "d") + new)
    put(spark, rows("a", text="short")[:2], root, removed=["c", "nowhere"], by="source")
    left = rows("a", text="short")[:2] + rows("b", "d") + [("b::9", "b", "bank", "added")]
    assert read(spark, root) == shown(left)
    put(spark, [], root, removed=["a", "b", "d"])
    assert read(spark, root) == [] and store.open_store(spark, root).at == {}
    put(spark, rows("e"), root)
    assert read(spark, root, source="e") == shown(rows("e")) and read(spark, root, source="a") == []


def test_last_of_repeated_ids_counts(spark):
    root = work_dir(spark, "store")
    twice = spark.createDataFrame([("a::0", "a", "k", "old", 1), ("a::0", "a", "k", "new", 2)], f"{SCHEMA}, seq int")
    store.upsert_chunks(twice, root, seq="seq")
    assert read(spark, root) == [("a::0", "a", "k", "new")]


def test_untouched_files_stay_and_unnamed_ones_go(spark):
    root = work_dir(spark, "store")
    put(spark, rows(*"abcdefgh"), root)
    before = files(spark, root)
    put(spark, rows("a", text="new"), root)
    after = files(spark, root)
    kept = before.keys() & after.keys()
    assert kept and all(before[f] == after[f] for f in kept)
    changed = {re.search(r"bucket=\d+", f)[0] for f in before.keys() ^ after.keys()}
    assert len(changed) == 1
    assert store.vacuum(spark, root, keep=2) == 0 and store.vacuum(spark, root) == 1
    assert files(spark, root) == after


def test_dead_writer_and_repeated_batch(spark, monkeypatch):
    root = work_dir(spark, "store")
    put(spark, rows("a", "b"), root, note={"batch": 0})
    with monkeypatch.context() as m:
        m.setattr(VersionLog, "commit", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            put(spark, rows("a", text="half"), root, note={"batch": 1})
    assert read(spark, root) == shown(rows("a", "b"))
    done = put(spark, rows("a", text="full"), root, note={"batch": 1})
    assert put(spark, rows("a", text="full"), root, note={"batch": 1}).version == done.version
    assert read(spark, root) == shown(rows("a", text="full") + rows("b"))


def test_reads_open_the_folders_they_need(spark):
    root = work_dir(spark, "store")
    now = put(spark, rows(*"abcdefgh"), root)
    one = store.read_store(spark, now, "e", "chips")
    plan = one._jdf.queryExecution().toString()
    assert len(one.inputFiles()) < len(files(spark, root))
    assert re.search(r"PartitionFilters: \[[^\]]*industry", plan) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(source,e\)", plan)
    kinds = spark.createDataFrame([("bank", 1), ("chips", 2)], "industry string, wanted int")
    kinds.write.parquet(small := work_dir(spark, "kinds"))
    joined = store.read_store(spark, now).join(spark.read.parquet(small).filter("wanted = 1"), "industry")
    assert "dynamicpruning" in joined._jdf.queryExecution().toString()
    assert sorted(r.source for r in joined.select("source").distinct().collect()) == ["a", "b"]
