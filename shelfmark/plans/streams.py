"""Bound queries: streams drained over the given tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from shelfmark.functions.session import materialize, work_dir
from shelfmark.functions.text import query_hash
from shelfmark.operators import requests as rq
from shelfmark.plans.bindings import strip_sql, with_sql
from shelfmark.plans.registry import query
from shelfmark.plans.request_log import BUDGET, BUDGETED, LIMIT, LIMITED, REQUESTS, ROUTE, ROUTES, WINDOW, hist_sql, requests_of
from shelfmark.streaming import event_order as eo
from shelfmark.streaming import ingest_stream as ing
from shelfmark.streaming import request_stream as rs
from shelfmark.streaming.runner import arrivals, stream_table


def request_stream(t):
    """Events as requests; the time column becomes a TIMESTAMP, which watermarks need."""
    events = stream_table(t.spark, t.folder, "events", t["events"].schema)
    return requests_of(events.withColumn("ts", F.col("ts").cast("timestamp")))


@query("stream_rate", with_sql(REQUESTS, LIMITED) + f"""
SELECT bucket, window_start, count(*) AS n, greatest(0, count(*) - {LIMIT}) AS rejected FROM lim GROUP BY ALL""")
def stream_rate(t):
    return rs.window_counts(request_stream(t), LIMIT, "1 hour")


@query("stream_admission", with_sql(REQUESTS, LIMITED, BUDGETED) + " SELECT request_id, bucket, n, rejected, used_before, reason FROM bud")
def stream_admission(t):
    r = request_stream(t).select("request_id", "ts", "bucket", "tokens")
    return rs.admission(r, LIMIT, BUDGET, WINDOW).select("request_id", "bucket", "n", "rejected", "used_before", "reason")


@query("stream_window_state", with_sql(REQUESTS, LIMITED) + " SELECT request_id, bucket, window_start, n, rejected FROM lim")
def stream_window_state(t):
    return rs.window_admission(request_stream(t).select("request_id", "ts", "bucket"), LIMIT, WINDOW)


@query("stream_sessions", with_sql(REQUESTS) + """,
gaps AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 120 SECOND THEN 0 ELSE 1 END AS starts FROM req WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 120000000 AS end_us, count(*) AS events, CAST(sum(tokens) AS BIGINT) AS tokens
FROM numbered GROUP BY user_id, s
HAVING epoch_us(max(ts)) + 120000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 FROM req) - 120000000""")
def stream_sessions(t):
    """Sessions the watermark has closed; the last ones stay open in the state."""
    return rs.sessions(request_stream(t))


@query("stream_counters", with_sql(REQUESTS) + f"""
SELECT method, {ROUTE} AS template, CAST(coalesce(status, 0) AS VARCHAR) AS status, count(*) AS n FROM req
WHERE event_type <> 'signup' GROUP BY ALL""")
def stream_counters(t):
    return rs.counters(request_stream(t), ROUTES)


@query("stream_latency", with_sql(REQUESTS) + hist_sql("method", "duration_s", rq.LATENCY_BOUNDS))
def stream_latency(t):
    return rs.latency_counts(request_stream(t), ["method"], "duration_s", rq.LATENCY_BOUNDS)


@query("stream_ingest")
def stream_ingest(t):
    """Documents streamed into chunk and manifest logs; the corpus read back (equal to ``chunk_docs``)."""
    docs = stream_table(t.spark, t.folder, "documents", t["documents"].schema)
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    root = work_dir(t.spark, "ingest")
    ing.ingest_stream(docs.select(path.alias("path"), "text"), root)
    return ing.read_corpus(t.spark, root)


@query("stream_manifest", """
WITH f AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, doc_id, text FROM documents)
SELECT path, md5(text) AS hash, CASE WHEN doc_id % 5 = 3 THEN 4 ELSE doc_id % 5 END AS batch FROM f""")
def stream_manifest(t):
    """Five micro-batches with a snapshot after every second: each brings a fifth of the documents, two of them an early state of the
    fourth fifth, whose present state comes last, with some documents again that did not change."""
    docs, old = t["documents"], F.concat("text", F.lit(" (old)"))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    fifth = F.col("doc_id") % 5
    rows = docs.select(path.alias("path"), "text", fifth.alias("fifth"))
    stale = docs.filter(fifth == 3).select(path.alias("path"), old.alias("text"))
    now = [rows.filter(F.col("fifth") == i).select("path", "text") for i in range(5)]
    parts = [now[0], now[1].unionByName(stale), now[2].unionByName(now[0]), stale.unionByName(now[1]), now[4].unionByName(now[3]).unionByName(now[2])]
    root = work_dir(t.spark, "ingest")
    ing.ingest_stream(arrivals(parts, work_dir(t.spark, "arrivals")), root, compact=2)
    return ing.read_manifest(t.spark, root).select("path", "hash", F.col("batch").cast("long"))


# --- streams whose files arrive out of order -------------------------------------------------

LATENESS = 3600
HEARTBEAT = "2024-03-01"


def shuffled_arrivals(t, rows, key: str, tick):
    """``rows`` in three files by the time they arrive, up to almost ``LATENESS`` seconds after their event time, then ``tick``.

    The tick is a heartbeat long after the last row: it lets the watermark pass all of them.
    """
    delay = F.pmod(F.xxhash64(key), F.lit(LATENESS - 60))
    arrives = F.unix_seconds("ts") + delay
    first = F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    ten_days = 10 * 86400
    rows = materialize(rows, "arrivals")  # each part is a filter of them
    parts = [rows.filter(F.least(F.lit(2), F.greatest(F.lit(0), F.floor((arrives - first) / ten_days))) == i) for i in range(3)]
    return arrivals([*parts, t.spark.createDataFrame([tick], rows.schema)], work_dir(t.spark, "arrivals"))


def shares(t) -> int:
    """Keys that share out the requests, so that a key's rows stay few and all tasks have keys."""
    return max(64, t["events"].count() // 50_000)


def heartbeat():
    return datetime.datetime.fromisoformat(HEARTBEAT)


@query("stream_ordered_admission", with_sql(REQUESTS, LIMITED, BUDGETED) + " SELECT request_id, bucket, n, rejected, used_before, reason FROM bud")
def stream_ordered_admission(t):
    """Both counters as operator state, over files that arrive up to an hour out of order."""
    rows = requests_of(t["events"].withColumn("ts", F.col("ts").cast("timestamp"))).select("request_id", "ts", "bucket", "tokens")
    stream = shuffled_arrivals(t, rows, "request_id", (-1, heartbeat(), "heartbeat", 0))
    return eo.admission_in_order(stream, LIMIT, BUDGET, WINDOW, f"{LATENESS} seconds").select("request_id", "bucket", "n", "rejected", "used_before", "reason")


#: Frames of each event taken as a request: seconds after its start, kind, and the share of tokens; by event_id % 4.
FRAMES = {
    0: [(0, "start", 0), (10, "token", 1), (30, "token", 2), (50, "done", 0), (60, "token", 9)],
    1: [(0, "start", 0), (20, "token", 1), (40, "disconnect", 1), (70, "done", 0)],
    2: [(0, "start", 0), (20, "token", 1), (100, "token", 1), (130, "token", 9), (150, "done", 0)],
    3: [(0, "start", 0), (119, "token", 3), (120, "error", 0)],
}
FRAMES_SQL = "frames AS (" + " UNION ALL ".join(
    f"SELECT request_id, epoch_us(ts) + {s} * 1000000 AS us, '{kind}' AS kind, {share} * tokens AS tokens FROM req WHERE request_id % 4 = {k}"
    for k, frames in FRAMES.items() for s, kind, share in frames) + ")"


@query("stream_request_endings", with_sql(REQUESTS, FRAMES_SQL) + """,
starts AS (SELECT request_id, min(us) AS start_us FROM frames GROUP BY ALL),
ends AS (SELECT s.request_id, start_us, least(start_us + 120000000, coalesce(min(us) FILTER (kind IN ('done', 'disconnect', 'error')), start_us + 120000000)) AS end_us
  FROM starts s JOIN frames f USING (request_id) GROUP BY s.request_id, start_us)
SELECT request_id, coalesce(max(kind) FILTER (us = end_us AND kind IN ('done', 'disconnect', 'error')), 'timeout') AS outcome, start_us, end_us,
  count(*) FILTER (us <= end_us) AS frames, CAST(sum(tokens) FILTER (us <= end_us) AS BIGINT) AS tokens
FROM ends JOIN frames USING (request_id) GROUP BY request_id, start_us, end_us""")
def stream_request_endings(t):
    """Requests that end by done, disconnect, error or the deadline, with frames that arrive out of order and frames after the end."""
    requests = requests_of(t["events"].withColumn("ts", F.col("ts").cast("timestamp")))
    frames = F.explode(F.element_at(F.create_map(*[
        x for k, frames in FRAMES.items()
        for x in (F.lit(k).cast("long"), F.array(*[F.struct(F.lit(s).alias("s"), F.lit(kind).alias("kind"), F.lit(share).alias("share")) for s, kind, share in frames]))
    ]), F.col("request_id") % 4)).alias("f")
    rows = requests.select("request_id", "ts", "tokens", frames).select(
        "request_id", F.timestamp_add("SECOND", F.col("f.s"), F.col("ts")).alias("ts"), F.col("f.kind").alias("kind"), (F.col("f.share") * F.col("tokens")).alias("tokens")
    )
    stream = shuffled_arrivals(t, rows.withColumn("_k", F.struct("request_id", "ts")), "_k", (-1, heartbeat(), "start", 0, (-1, heartbeat()))).drop("_k")
    return eo.request_endings(stream, shares=shares(t), lateness=f"{LATENESS} seconds")


CACHE_EVENTS = f"""asked AS (SELECT d.doc_id AS id, md5(lower({strip_sql('d.text')})) AS query_hash, e.ts, l.doc_id IS NOT NULL AS admitted
  FROM documents d JOIN events e ON e.event_id = d.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id)"""


@query("stream_cache_answers", with_sql(CACHE_EVENTS) + """,
newest AS (SELECT p.id, max_by(a.id, a.ts) AS entry_id, max(a.ts) AS since, p.ts FROM asked p JOIN asked a ON a.admitted AND a.query_hash = p.query_hash AND a.ts <= p.ts
  WHERE NOT p.admitted GROUP BY p.id, p.ts)
SELECT id AS query_id, query_hash, CASE WHEN since + INTERVAL 5 DAY > newest.ts THEN entry_id END AS entry_id
FROM asked LEFT JOIN newest USING (id) WHERE NOT admitted""")
def stream_cache_answers(t):
    """Labelled documents are admitted to the cache for five days, the others ask it, each at its own time; files arrive out of order."""
    times = t["events"].select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    docs = t["documents"].select(F.col("doc_id").alias("id"), query_hash(F.col("text")).alias("query_hash")).join(times, "id")
    kept = t["labels"].select(F.col("doc_id").alias("id"), F.lit("admit").alias("kind")).distinct()
    kind = F.coalesce("kind", F.lit("probe"))
    rows = docs.join(kept, "id", "left").select(
        "id", "ts", kind.alias("kind"), "query_hash", F.when(kind == "admit", F.col("ts") + F.expr("INTERVAL 5 DAY")).alias("expires_at")
    )
    stream = shuffled_arrivals(t, rows, "id", (-1, heartbeat(), "admit", "heartbeat", heartbeat()))
    return eo.cache_answers(stream, shares=shares(t), lateness=f"{LATENESS} seconds")


LATE_FROM = "2024-01-16"
LATE = f"""sent AS (SELECT *, CASE WHEN ts >= TIMESTAMP '{LATE_FROM}' THEN 2 WHEN request_id % 7 = 0 THEN 3 ELSE 1 END AS file, epoch_us(ts) // 3600000000 * 3600 AS window_start FROM req),
mark AS (SELECT max(epoch_us(ts)) // 1000 - 120000 AS watermark FROM sent WHERE file = 1),
judged AS (SELECT *, file = 3 AND (window_start + 3600) * 1000 <= watermark AS late FROM sent, mark)"""


@query("stream_late_rows", with_sql(REQUESTS, LATE) + """
SELECT bucket, window_start, count(*) AS n, (SELECT count(*) FROM judged WHERE late) AS late FROM judged WHERE NOT late GROUP BY ALL""")
def stream_late_rows(t):
    """Every seventh request of the first half arrives after the second half: counted if its window is still open, else reported as late.

    Spark turns rows away by the watermark that the batch before had, here that of the first half.
    """
    rows = requests_of(t["events"].withColumn("ts", F.col("ts").cast("timestamp"))).select("request_id", "ts", "bucket")
    early, seventh = F.col("ts") < F.lit(LATE_FROM).cast("timestamp"), F.col("request_id") % 7 == 0
    parts = [rows.filter(early & ~seventh), rows.filter(~early), rows.filter(early & seventh)]
    counts, late = rs.window_counts_and_late(arrivals(parts, work_dir(t.spark, "arrivals")), "1 hour")
    return counts.withColumn("late", F.lit(late).cast("long"))
