"""Bound queries: conversations and tool logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.session import work_dir
from shelfmark.operators import ingest
from shelfmark.operators import transcripts as tr
from shelfmark.plans.bindings import WS_SQL, strip_sql, with_sql
from shelfmark.plans.registry import query

MAX_TOKENS = 400

ENVELOPES = {
    0: "not json",
    1: "[1, 2]",
    2: '{"tool": "x", "query": "q2"}',
    3: '{"ok": true, "query": "q3", "meta": {"has_relevant_content": true}}',
    4: '{"ok": false, "query": "q4", "error": {"code": "E4", "message": "m"}, "meta": {"has_relevant_content": false}}',
}
ENVELOPE_SQL = "CASE n % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in ENVELOPES.items()) + " END"
CALL = "'c-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || '-{}'"

MESSAGES = f"""base AS (SELECT conv_id, turn, role AS r0, text, length(text) AS n, role <> 'system' AND turn % 3 = 2 AS is_ai FROM conversations),
messages AS (
  SELECT conv_id, turn * 10 AS seq, CASE WHEN is_ai THEN 'assistant' ELSE 'user' END AS role,
         CASE WHEN r0 = 'system' THEN 'system_monitor' END AS name, text,
         CASE WHEN is_ai AND n % 2 = 0 THEN [{CALL.format('a')}, {CALL.format('b')}] ELSE [] END AS call_ids, NULL::VARCHAR AS reply_to FROM base
  UNION ALL SELECT conv_id, turn * 10 + 1, 'tool', CASE WHEN n % 3 = 2 THEN 'search' ELSE 'query_internal_knowledge' END, {ENVELOPE_SQL}, [], {CALL.format('a')}
    FROM base WHERE is_ai AND n % 2 = 0 AND n % 7 < 5
  UNION ALL SELECT conv_id, turn * 10 + 2, 'tool', 'query_internal_knowledge', {ENVELOPE_SQL}, [], {CALL.format('b')}
    FROM base WHERE is_ai AND n % 2 = 0 AND n % 7 < 4)"""


def envelope(n):
    out = None
    for k, v in ENVELOPES.items():
        out = F.when(n % 5 == k, v) if out is None else out.when(n % 5 == k, v)
    return out


def messages(t):
    """Conversations with every third turn as an answer; answers of even length made two tool calls."""
    c = t["conversations"].withColumns(
        {"n": F.length("text"), "is_ai": (F.col("role") != "system") & (F.col("turn") % 3 == 2)}
    )
    none = F.array().cast("array<string>")

    def call(x):
        return F.format_string(f"c-%d-%d-{x}", F.col("conv_id"), F.col("turn"))

    null = F.lit(None).cast("string")
    calling = F.col("is_ai") & (F.col("n") % 2 == 0)
    said = c.select(
        "conv_id", (F.col("turn") * 10).alias("seq"), F.when(F.col("is_ai"), "assistant").otherwise("user").alias("role"),
        F.when(F.col("role") == "system", "system_monitor").alias("name"), "text",
        F.when(calling, F.array(call("a"), call("b"))).otherwise(none).alias("call_ids"), null.alias("reply_to"),
    )

    def reply(x, place, name, cond):
        return c.filter(calling & cond).select(
            "conv_id", (F.col("turn") * 10 + place).alias("seq"), F.lit("tool").alias("role"), name.alias("name"),
            envelope(F.col("n")).alias("text"), none.alias("call_ids"), call(x).alias("reply_to"),
        )

    first = F.when(F.col("n") % 3 == 2, "search").otherwise("query_internal_knowledge")
    a = reply("a", 1, first, F.col("n") % 7 < 5)
    b = reply("b", 2, F.lit("query_internal_knowledge"), F.col("n") % 7 < 4)
    return said.unionByName(a).unionByName(b)


def trim_sql(src: str) -> str:
    return f"""(SELECT m.* FROM {src} m JOIN (SELECT conv_id, coalesce(min(seq) FILTER (WHERE role = 'user' AND suffix // 3 <= {MAX_TOKENS}),
    max(seq) FILTER (WHERE role = 'user'), max(seq)) AS start FROM (
      SELECT conv_id, seq, role, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY seq DESC) AS BIGINT) AS suffix FROM {src})
    GROUP BY conv_id) s USING (conv_id) WHERE seq >= start)"""


def collapse_sql(src: str) -> str:
    return f"""(SELECT conv_id, min(seq) AS seq, any_value(role) AS role, CASE WHEN count(*) = 1 THEN any_value(name) END AS name,
    string_agg(CASE WHEN size = 1 THEN text WHEN i = 1 THEN regexp_replace(text, '{WS_SQL}+$', '')
      WHEN i = size THEN regexp_replace(text, '^{WS_SQL}+', '') ELSE {strip_sql('text')} END, chr(10) || chr(10) ORDER BY seq) AS text,
    arg_min(call_ids, seq) AS call_ids, arg_min(reply_to, seq) AS reply_to, count(*) AS merged
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, island ORDER BY seq) AS i, count(*) OVER (PARTITION BY conv_id, island) AS size FROM (
    SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY seq) AS island FROM (
      SELECT *, CASE WHEN role = 'user' AND lag(role) OVER (PARTITION BY conv_id ORDER BY seq) = 'user' THEN 0 ELSE 1 END AS starts FROM {src})))
  GROUP BY conv_id, island)"""


def repair_sql(src: str) -> str:
    return f"""slots AS (SELECT *, CAST(sum(CASE WHEN role <> 'tool' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY seq) AS BIGINT) AS slot FROM {src}),
calls AS (SELECT conv_id, slot, seq, unnest(call_ids) AS reply_to, generate_subscripts(call_ids, 1) - 1 AS pos FROM slots WHERE role = 'assistant'),
repaired AS (
  SELECT conv_id, seq, role, name, text, reply_to, slot, CASE WHEN role = 'tool' THEN 1 ELSE 0 END AS part, CASE WHEN role = 'tool' THEN seq ELSE 0 END AS pos FROM slots
  UNION ALL SELECT conv_id, seq, 'tool', NULL, '{tr.PLACEHOLDER}', reply_to, slot, 2, pos FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM slots s WHERE s.role = 'tool' AND s.conv_id = c.conv_id AND s.slot = c.slot AND s.reply_to = c.reply_to))
SELECT conv_id, seq, role, name, text, reply_to, slot, part, pos FROM repaired"""


OUT = ["conv_id", "seq", "role", "name", "text", "reply_to", "slot", "part", "pos"]


@query("history_trim", with_sql(MESSAGES) + f" SELECT conv_id, seq, role, text FROM {trim_sql('messages')}")
def history_trim(t):
    return tr.history_trim(messages(t), MAX_TOKENS).select("conv_id", "seq", "role", "text")


@query("collapse_users", with_sql(MESSAGES) + f" SELECT conv_id, seq, role, text, merged FROM {collapse_sql('messages')}")
def collapse_users(t):
    return tr.collapse_users(messages(t)).select("conv_id", "seq", "role", "text", "merged")


@query("dangling_repair", with_sql(MESSAGES, repair_sql("messages")))
def dangling_repair(t):
    return tr.dangling_repair(messages(t)).select(*OUT)


@query("transcript_clean", with_sql(
    MESSAGES, "plain AS (SELECT * FROM messages WHERE coalesce(role = 'user' AND name IN ('system_monitor', 'system_terminator'), false) = false)",
    f"trimmed AS {trim_sql('plain')}", f"merged AS {collapse_sql('trimmed')}", repair_sql("merged")))
def transcript_clean(t):
    """All cleaning steps in their order."""
    return tr.transcript_clean(messages(t), MAX_TOKENS).select(*OUT)


LAST_USER = """lastu AS (SELECT conv_id, max(seq) FILTER (WHERE role = 'user' AND coalesce(name, '') NOT IN ('system_monitor', 'system_terminator')) AS last_user
  FROM messages GROUP BY conv_id)"""


@query("turn_tool_count", with_sql(MESSAGES, LAST_USER) + """,
c AS (SELECT conv_id, max(last_user) AS last_user, count(*) FILTER (WHERE role = 'tool' AND name = 'query_internal_knowledge' AND seq > last_user) AS tool_count
  FROM messages JOIN lastu USING (conv_id) GROUP BY conv_id)
SELECT *, tool_count >= 3 AS capped FROM c""")
def turn_tool_count(t):
    return tr.turn_tool_count(messages(t))


@query("fail_streak", with_sql(MESSAGES, LAST_USER) + """,
looked AS (SELECT conv_id, seq, CASE WHEN json_valid(text) THEN CAST(text::JSON->>'$.meta.has_relevant_content' AS BOOLEAN) END AS ok
  FROM messages JOIN lastu USING (conv_id) WHERE role = 'tool' AND name = 'query_internal_knowledge' AND seq > last_user),
good AS (SELECT conv_id, coalesce(max(seq) FILTER (WHERE ok), -1) AS g FROM looked GROUP BY conv_id),
s AS (SELECT conv_id, count(*) FILTER (WHERE NOT ok AND seq > g) AS streak FROM looked JOIN good USING (conv_id) GROUP BY conv_id)
SELECT conv_id, coalesce(streak, 0) AS streak, coalesce(streak, 0) >= 2 AS refuse FROM (SELECT DISTINCT conv_id FROM messages) LEFT JOIN s USING (conv_id)""")
def fail_streak(t):
    return tr.fail_streak(messages(t))


@query("last_n_runs", """
SELECT thread_id, event_id, tool FROM (SELECT user_id AS thread_id, event_id, event_type AS tool,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 50""")
def last_n_runs(t):
    runs = t["events"].select(F.col("user_id").alias("thread_id"), "event_id", F.col("event_type").alias("tool"))
    return tr.last_n_runs(runs, "thread_id", "event_id")


@query("bounded_payload", """
WITH items AS (SELECT conv_id AS payload_id, turn AS pos, '{"content": "' || text || '"}' AS piece FROM conversations),
u AS (SELECT *, sum(length(piece)) OVER (PARTITION BY payload_id ORDER BY pos) <= 1500 AS fits FROM items),
f AS (SELECT payload_id, count(*) FILTER (WHERE fits) AS kept_results, count(*) AS total_results FROM u GROUP BY ALL)
SELECT f.payload_id, pos, piece, kept_results, total_results, kept_results < total_results AS truncated
FROM f LEFT JOIN (SELECT * FROM u WHERE fits) k ON f.payload_id = k.payload_id""")
def bounded_payload(t):
    piece = F.concat(F.lit('{"content": "'), "text", F.lit('"}'))
    items = t["conversations"].select(F.col("conv_id").alias("payload_id"), F.col("turn").alias("pos"), piece.alias("piece"))
    return tr.bounded_payload(items, 1500)


@query("history_page", """
SELECT conv_id, turn AS seq, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END AS type, text AS content,
  CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, total, 6 < total AS has_more
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)
WHERE n > 3 AND n <= 6""")
def history_page(t):
    """Second page of three messages."""
    return tr.history_page(t["conversations"].withColumnRenamed("turn", "seq"), page=2, page_size=3)


@query("thread_markdown", """
SELECT conv_id, 0 AS part, '# 对话记录：' || CAST(conv_id AS VARCHAR) || chr(10) || chr(10) || '总消息数：' || CAST(count(*) AS VARCHAR) || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS section
FROM conversations GROUP BY conv_id
UNION ALL SELECT conv_id, n, '## 消息 ' || CAST(n AS VARCHAR) || ' - ' || role || chr(10) || chr(10) || text || chr(10) || chr(10)
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)""")
def thread_markdown(t):
    return tr.thread_markdown(t["conversations"].withColumnRenamed("turn", "seq"))


def doomed(t):
    """Threads with a system message, and some customer ids that name no thread."""
    return t["conversations"].filter("role = 'system'").select("conv_id").unionByName(
        t["customer"].select((F.col("c_custkey") + 1000000000).alias("conv_id"))
    )


@query("delete_threads", """
SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
def delete_threads(t):
    return ingest.delete_keys(t["conversations"].select("conv_id", "turn"), doomed(t), "conv_id")


@query("delete_report", """
SELECT conv_id, count(*) AS deleted, true AS found FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conv_id
UNION ALL SELECT c_custkey + 1000000000, 0, false FROM customer""")
def delete_report(t):
    return ingest.deletion_report(t["conversations"].select("conv_id", "turn"), doomed(t), "conv_id")


def checkpoints(t):
    return t["events"].select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("checkpoint_id"), "ts")


@query("thread_list", """
SELECT user_id AS thread_id, count(*) AS checkpoint_count, max(event_id) AS last_checkpoint_id, min(event_id) AS first_checkpoint_id
FROM events GROUP BY user_id ORDER BY last_checkpoint_id DESC, thread_id LIMIT 100""")
def thread_list(t):
    return tr.thread_list(checkpoints(t))


@query("thread_stats", """
SELECT user_id AS thread_id, count(*) AS n, (SELECT count(DISTINCT user_id) FROM events) AS total_threads, (SELECT count(*) FROM events) AS total_checkpoints
FROM events GROUP BY user_id ORDER BY n DESC, thread_id LIMIT 5""")
def thread_stats(t):
    return tr.thread_stats(checkpoints(t))


@query("thread_summary_stats", """
SELECT CAST(user_id AS VARCHAR) AS thread_id, count(*) AS n, count(*) AS n_most, (SELECT count(*) FROM events) AS total_checkpoints, true AS threads_in_error
FROM events GROUP BY user_id ORDER BY n DESC, thread_id LIMIT 5""")
def thread_summary_stats(t):
    """The statistics from summaries of three batches, stored one after the other; the estimate is held against the exact number."""
    path = work_dir(t.spark, "summaries")
    for batch in range(3):
        tr.append_summary(checkpoints(t).filter(F.col("checkpoint_id") % 3 == batch), path, batch)
    rows = tr.summarised_stats(t.spark.read.schema(tr.SUMMARY).parquet(path))
    exact = checkpoints(t).agg(F.count_distinct("thread_id")).scalar()
    close = F.abs(F.col("total_threads") - exact) <= F.greatest(F.lit(1.0), 3 * 1.04 / 2 ** (tr.SKETCH_BITS / 2) * exact)
    return rows.select("thread_id", "n", "n_most", "total_checkpoints", close.alias("threads_in_error"))


@query("cleanup_threads", """
SELECT user_id AS thread_id, count(*) AS n FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00'""")
def cleanup_threads(t):
    return tr.cleanup_threads(checkpoints(t), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


EVENT_ENVELOPE = """r AS (SELECT event_id, CASE event_type
  WHEN 'click' THEN '{"ok": true, "query": "q' || CAST(event_id AS VARCHAR) || '", "meta": {"has_relevant_content": true}}'
  WHEN 'view' THEN '{"query": "q' || CAST(event_id AS VARCHAR) || '"}'
  WHEN 'error' THEN '{"ok": false, "error": {"code": "E1", "message": "m"}}'
  WHEN 'purchase' THEN '[1]' ELSE 'oops' END AS content, event_type FROM events)"""


def event_envelopes(t):
    eid, kind = F.col("event_id").cast("string"), F.col("event_type")
    content = (
        F.when(kind == "click", F.concat(F.lit('{"ok": true, "query": "q'), eid, F.lit('", "meta": {"has_relevant_content": true}}')))
        .when(kind == "view", F.concat(F.lit('{"query": "q'), eid, F.lit('"}')))
        .when(kind == "error", '{"ok": false, "error": {"code": "E1", "message": "m"}}')
        .when(kind == "purchase", "[1]").otherwise("oops")
    )
    return t["events"].select("event_id", content.alias("content"))


@query("tool_runs", with_sql(EVENT_ENVELOPE) + """
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'q' || CAST(event_id AS VARCHAR) END AS query,
  CASE event_type WHEN 'click' THEN true WHEN 'view' THEN NULL ELSE false END AS ok,
  CASE event_type WHEN 'error' THEN 'E1' WHEN 'click' THEN NULL WHEN 'view' THEN NULL ELSE 'PARSE_FAILED' END AS error_code,
  CASE WHEN event_type = 'click' THEN true END AS has_relevant FROM r""")
def tool_runs(t):
    return tr.tool_runs(event_envelopes(t)).drop("content")


@query("tool_ok", with_sql(EVENT_ENVELOPE) + " SELECT event_id, event_type <> 'error' AS ok FROM r")
def tool_ok(t):
    return event_envelopes(t).select("event_id", tr.tool_ok(F.col("content")).alias("ok"))


@query("tool_gate", """
WITH active AS (SELECT event_type AS tool FROM events GROUP BY 1 HAVING event_type <> 'signup')
SELECT event_id AS call_id, event_type AS tool, event_type IN (SELECT tool FROM active) AS allowed,
  CASE WHEN event_type NOT IN (SELECT tool FROM active) THEN 'TOOL_DISABLED' END AS code FROM events""")
def tool_gate(t):
    calls = t["events"].select(F.col("event_id").alias("call_id"), F.col("event_type").alias("tool"))
    active = t["events"].filter("event_type <> 'signup'").select(F.col("event_type").alias("tool")).distinct()
    return tr.tool_gate(calls, active)


def _dots(s: str, n: int) -> str:
    return f"CASE WHEN length({s}) <= {n} THEN {s} ELSE substr({s}, 1, {n - 3}) || '...' END"


@query("shrink_results", f"""
WITH d AS (SELECT doc_id, {strip_sql('text')} AS s FROM documents), i AS (SELECT doc_id, s, unnest([0, 1, 2, 3, 4]) AS pos FROM d),
x AS (SELECT *, 'T' || CAST(pos AS VARCHAR) || ' ' || s AS title FROM i)
SELECT doc_id, 'found' AS kind, pos, {_dots('title', 200)} AS title, 'http://x/' || CAST(pos AS VARCHAR) AS url, {_dots('s', 800)} AS content, pos / 2.0::DOUBLE AS score,
  CASE WHEN pos % 2 = 0 THEN 'd' ELSE 't' END || CAST(pos AS VARCHAR) AS published_date, {_dots('s', 1200)} AS answer, NULL AS raw FROM x
UNION ALL SELECT doc_id, 'empty', NULL, NULL, NULL, NULL, NULL, NULL, {_dots('s', 1200)}, NULL FROM d
UNION ALL SELECT doc_id, 'text', NULL, NULL, NULL, NULL, NULL, NULL, NULL, {_dots('s', 3000)} FROM d""")
def shrink_results(t):
    """Search payloads built from every document: seven results, an answer without results, and a text that is no payload."""
    item = F.transform(
        F.sequence(F.lit(0), F.lit(6)),
        lambda i: F.struct(
            F.concat(F.lit("T"), i.cast("string"), F.lit(" "), F.col("text")).alias("title"),
            F.concat(F.lit("http://x/"), i.cast("string")).alias("url"), F.col("text").alias("content"), (i / 2).alias("score"),
            F.when(i % 2 == 0, F.concat(F.lit("d"), i.cast("string"))).alias("published_date"),
            F.concat(F.lit("t"), i.cast("string")).alias("published_time"),
        ),
    )
    none = F.filter(item, lambda _: F.lit(False))
    payloads = [(F.lit("found"), F.to_json(F.struct(item.alias("results"), F.col("text").alias("answer")))),
                (F.lit("empty"), F.to_json(F.struct(none.alias("results"), F.col("text").alias("answer")))), (F.lit("text"), F.col("text"))]
    kinds = F.explode(F.array(*[F.struct(kind.alias("kind"), json.alias("json")) for kind, json in payloads]))
    return tr.shrink_results(t["documents"].select("doc_id", kinds.alias("p")).select("doc_id", "p.*"), "json")


@query("export_modes", """
SELECT * FROM (SELECT 'append' AS how, CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role FROM conversations WHERE role = 'assistant'
UNION ALL SELECT 'append', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), role FROM conversations WHERE role = 'user'
UNION ALL SELECT 'stamped', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), role FROM conversations)""")
def export_modes(t):
    """Tables written by the export modes and read back: an overwrite, an append to it, a stamped copy."""
    from shelfmark.functions.session import work_dir
    from shelfmark.sources.sinks import export_table

    rows = t["conversations"].select("conv_id", "turn", "role")
    path = work_dir(t.spark, "export")
    export_table(rows, path, "overwrite")
    export_table(rows.filter("role = 'user'"), path, "overwrite")
    export_table(rows.filter("role = 'assistant'"), path, "append")
    copy = export_table(rows, path, "timestamp")

    def back(where, how):
        return t.spark.read.option("header", True).csv(where).select(F.lit(how).alias("how"), "conv_id", "turn", "role")

    return back(path, "append").unionByName(back(copy, "stamped"))
