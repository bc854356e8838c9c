"""Files in and out, and streams against their batch forms."""

import hashlib
import json
import os
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from shelfmark.operators import requests as rq
from shelfmark.operators.chunking import chunk_docs
from shelfmark.sources import corpus, sinks
from shelfmark.streaming import ingest_stream as ing
from shelfmark.streaming import request_stream as rs
from shelfmark.streaming.runner import stream_table

T0 = datetime(2024, 5, 1, 10, 0, 0)


def put(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_listing_and_whole_texts(spark, tmp_path):
    for name in ("a.PDF", "x/b.md", "x/c.exe", "d.txt", "e.py"):
        put(tmp_path / name, f"content of {name}\nsecond line")
    names = sorted(Path(r.path).name for r in corpus.list_corpus(spark, str(tmp_path)).collect())
    assert names == ["a.PDF", "b.md", "d.txt", "e.py"]
    docs = corpus.read_text_docs(spark, [str(tmp_path / "d.txt"), str(tmp_path / "x/b.md")]).collect()
    assert {Path(r.path).name: r.text for r in docs}["b.md"] == "content of x/b.md\nsecond line"
    assert corpus.hash_files(spark, str(tmp_path)).count() == 4


def test_rows_to_text_from_csv(spark, tmp_path):
    put(tmp_path / "t.csv", "name,city,note\nA,Rome,\n,,\nB, ,x\n")
    df = corpus.read_rows(spark, str(tmp_path / "t.csv"))
    rows = corpus.rows_to_text(df, "t.csv").orderBy("row").collect()
    assert [(r.chunk_id, r.content) for r in rows] == [("t.csv::row_0", "name：A；city：Rome"), ("t.csv::row_2", "name：B；note：x")]


def test_row_numbers_run_over_many_tasks(spark):
    df = corpus.with_row_number(spark.range(100).repartition(7))
    assert sorted(r.row for r in df.collect()) == list(range(100))


def test_eval_records_skip_bad_lines(spark, tmp_path):
    put(tmp_path / "q.jsonl", '{"question": "问", "page": 3}\n\nnot json\n{"question": " "}\n{"question": "b"}\n')
    rows = corpus.read_eval_jsonl(spark, str(tmp_path / "q.jsonl")).collect()
    assert sorted((r.question, r.page) for r in rows) == [("b", None), ("问", 3)]


def test_usage_log_and_jsonl(spark, tmp_path):
    put(tmp_path / "u/usage.jsonl", json.dumps({"ts": "2024-05-01T10:00:00+00:00", "username": "a", "thread_id": "t", "total_tokens": 7}) + "\n")
    r = corpus.read_usage(spark, str(tmp_path / "u")).first()
    assert r.total_tokens == 7 and r.ts == datetime(2024, 5, 1, 10) and corpus.stream_usage(spark, str(tmp_path / "u")).isStreaming
    sinks.write_jsonl(spark.createDataFrame([("问",)], "q string"), str(tmp_path / "out"))
    assert "问" in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))


def test_export_modes(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    path = str(tmp_path / "table")
    with pytest.raises(sinks.BadMode):
        sinks.export_table(a, path, "replace")
    stamped = sinks.export_table(a, path, "timestamp")
    assert stamped != path and Path(stamped).exists()
    sinks.export_table(a, path, "append")
    sinks.export_table(a, path, "append", keep_backup=True)
    assert spark.read.option("header", True).csv(path).count() == 2
    assert len(list(tmp_path.glob("table_backup_*"))) == 1
    with pytest.raises(sinks.HeaderMismatch):
        sinks.export_table(a.withColumnRenamed("v", "w"), path, "append")
    sinks.export_table(a, path, "overwrite")
    assert spark.read.option("header", True).csv(path).count() == 1


def test_thread_export(spark, tmp_path):
    rows = [(1, i, "user", None, f"t{i}", [], None) for i in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, seq long, role string, name string, text string, call_ids array<string>, reply_to string")
    sinks.export_threads(df, str(tmp_path / "md"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*")))
    assert text.startswith("# 对话记录：1\n\n总消息数：3\n\n---\n\n## 消息 1 - user\n\nt0\n\n## 消息 2 - user")
    sinks.export_threads(df, str(tmp_path / "js"), "json")
    assert spark.read.json(str(tmp_path / "js")).count() == 3


def test_timing_log(spark, tmp_path):
    log = str(tmp_path / "log")
    with sinks.timed(spark, "parse", log, doc_count=10, files=2):
        pass
    with pytest.raises(ValueError), sinks.timed(spark, "embed", log):
        raise ValueError("x")
    rows = {r.stage: r for r in spark.read.json(log).collect()}
    assert rows["parse"].status == "success" and rows["parse"].docs_per_sec > 0 and rows["embed"].status == "failed: ValueError"


def test_eval_report(spark, tmp_path):
    df = spark.createDataFrame(
        [("q", "i", 1, "t", 1.0, 0.5, None, True, ["x"], [("f", 1)])] * 3,
        "question string, industry string, page int, chunk_text string, context_precision double, context_recall double, "
        "faithfulness double, retrieve_ok boolean, contexts array<string>, sources array<struct<file:string,page:int>>",
    )
    summary, detail = sinks.write_eval_report(df, str(tmp_path))
    assert spark.read.json(summary).count() == 2 and spark.read.option("header", True).csv(detail).count() == 3


# --- streams ---------------------------------------------------------------------------------


def event_files(spark, folder, n_files=3):
    """Requests of two buckets in time order, one file per time range."""
    rows = [(i, T0 + timedelta(seconds=7 * i), "hot" if i % 3 else "cold", i % 11, i % 4) for i in range(120)]
    schema = "request_id long, ts timestamp, bucket string, tokens long, user_id long"
    for f in range(n_files):
        part = rows[f * len(rows) // n_files:(f + 1) * len(rows) // n_files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.read.schema(schema).parquet(str(folder))


def stream_of(spark, folder, batch):
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_admission_over_batches_equals_batch(spark, tmp_path):
    batch = event_files(spark, tmp_path / "e")
    streamed = rs.admission(stream_of(spark, tmp_path / "e", batch), limit=4, budget=150)
    direct = rq.token_budget(rq.rate_limit(batch, 4), 150)
    cols = ["request_id", "n", "rejected", "retry_after", "used_before", "reason"]
    got, want = (sorted(map(tuple, d.select(*cols).collect())) for d in (streamed, direct))
    assert got == want and {r[5] for r in want} == {None, "rpm", "budget"}
    assert streamed.select("batch").distinct().count() == 3


def test_keyed_state_equals_batch(spark, tmp_path):
    batch = event_files(spark, tmp_path / "e", 2)
    streamed = rs.window_admission(stream_of(spark, tmp_path / "e", batch), limit=4)
    want = rq.rate_limit(batch, 4).select("request_id", "n", "rejected")
    assert sorted(map(tuple, streamed.select("request_id", "n", "rejected").collect())) == sorted(map(tuple, want.collect()))


def test_window_counts_drop_late_rows(spark, tmp_path):
    schema = "request_id long, ts timestamp, bucket string"
    seen = set()
    for k, minute in enumerate((0, 30, 31, 0)):  # the last file is half an hour late
        spark.createDataFrame([(k, T0 + timedelta(minutes=minute), "b")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        for f in (tmp_path / "e").glob("part-*"):
            if f not in seen:
                seen.add(f)
                os.utime(f, (1_700_000_000 + 60 * k,) * 2)  # the order in which the source takes them
    batch = spark.read.schema(schema).parquet(str(tmp_path / "e"))
    counts = rs.window_counts(stream_of(spark, tmp_path / "e", batch), limit=1).collect()
    assert sorted(r.n for r in counts) == [1, 1, 1]


def test_ingest_replaces_changed_documents_and_survives_replay(spark, tmp_path):
    schema = "path string, text string"

    def write(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))

    root = str(tmp_path / "kb")
    write([("a", "word " * 400), ("b", "stays")])
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "docs"))
    ing.ingest_stream(docs, root)
    write([("a", "short now"), ("b", "stays"), ("c", "new")])
    ing.ingest_stream(docs, root)  # same checkpoint: only the new file
    ing.ingest_batch(spark.read.schema(schema).parquet(str(tmp_path / "docs")).filter("text <> 'x'").limit(0), 2, root)
    got = sorted((r.path, r.content) for r in ing.read_corpus(spark, root).collect())
    assert got == [("a", "short now"), ("b", "stays"), ("c", "new")]
    second = spark.createDataFrame([("a", "short now"), ("b", "stays"), ("c", "new")], schema)
    ing.ingest_batch(second, 1, root)  # the batch is repeated after a failure
    assert sorted((r.path, r.content) for r in ing.read_corpus(spark, root).collect()) == got
    known = {r.path: r.batch for r in ing.read_manifest(spark, root).collect()}
    assert known == {"a": 1, "b": 0, "c": 1}


def test_stream_table_reads_the_named_files(spark, tables):
    s = stream_table(spark, tables.folder, "events", tables["events"].schema)
    assert s.isStreaming and chunk_docs(tables["documents"].limit(1)).count() > 0


def test_manifest_snapshots_stand_for_the_batches_before(spark, tmp_path):
    schema, root = "path string, text string, seq int", str(tmp_path / "kb")
    state = {}
    for batch in range(7):
        rows = [(f"p{i}", f"text {i} of {batch if i % 3 == batch % 3 else 'ever'}", 1) for i in range(batch + 3)]
        rows += [("twice", f"draft {batch}", 1), ("twice", "final", 2)]
        ing.ingest_batch(spark.createDataFrame(rows, schema), batch, root, compact=3)
        for path, text, _ in rows:
            if state.get(path, ("", 0))[0] != text and not text.startswith("draft"):
                state[path] = (text, batch)
        known = {r.path: (r.hash, r.batch) for r in ing.read_manifest(spark, root).collect()}
        assert known == {p: (hashlib.md5(t.encode()).hexdigest(), b) for p, (t, b) in state.items()}
    assert sorted(p.name for p in (tmp_path / "kb/snapshots").iterdir()) == ["batch=2", "batch=5"]
    for n in (0, 1, 3):  # what a snapshot covers is not read any more
        for f in (tmp_path / f"kb/manifest/batch={n}").iterdir():
            f.write_bytes(b"")
    assert {r.path: r.batch for r in ing.read_manifest(spark, root).collect()} == {p: b for p, (_, b) in state.items()}
    assert {r.path: r.content for r in ing.read_corpus(spark, root).collect()} == {p: t for p, (t, _) in state.items()}
