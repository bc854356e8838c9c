"""Transcript cleaning, tool logs, thread stores."""

import json

from pyspark.sql import functions as F

from shelfmark.operators import transcripts as tr

SCHEMA = "conv_id long, seq long, role string, name string, text string, call_ids array<string>, reply_to string"


def msgs(spark, rows):
    """rows: (role, text[, name[, calls[, reply]]])"""
    full = []
    for i, r in enumerate(rows):
        role, text, name, calls, reply = (*r, *[None] * (5 - len(r)))
        full.append((1, i, role, name, text, calls or [], reply))
    return spark.createDataFrame(full, SCHEMA)


def texts(df):
    return [r.text for r in df.orderBy("seq").collect()]


def test_users_merge_and_joints_are_stripped(spark):
    df = msgs(spark, [("user", " a \n"), ("user", "  "), ("user", "\tb "), ("assistant", "c"), ("user", "d")])
    assert texts(tr.collapse_users(df)) == [" a\n\nb ", "c", "d"]


def test_tool_between_users_keeps_them_apart(spark):
    df = msgs(spark, [("user", "a"), ("assistant", "x", None, ["c1"]), ("tool", "r", "t", None, "c1"), ("user", "b"), ("user", "c")])
    assert texts(tr.collapse_users(df)) == ["a", "x", "r", "b\n\nc"]


def test_trim_keeps_longest_end_starting_on_a_user(spark):
    df = msgs(spark, [("user", "x" * 9), ("assistant", "y" * 9), ("user", "z" * 9), ("assistant", "w" * 9)])
    assert texts(tr.history_trim(df, 12)) == ["x" * 9, "y" * 9, "z" * 9, "w" * 9]
    assert texts(tr.history_trim(df, 11)) == ["z" * 9, "w" * 9]
    # nothing fits: the last user message and what follows
    assert texts(tr.history_trim(df, 1)) == ["z" * 9, "w" * 9]


def test_trim_without_user_keeps_the_last_message(spark):
    df = msgs(spark, [("assistant", "a" * 30), ("assistant", "b" * 30)])
    assert texts(tr.history_trim(df, 100)) == ["b" * 30]


def test_every_call_gets_a_reply_right_after_it(spark):
    df = msgs(
        spark,
        [
            ("user", "q"), ("assistant", "", None, ["c1", "c2", "c2"]), ("tool", "r1", "t", None, "c1"),
            ("assistant", "", None, ["c3"]), ("user", "later"), ("tool", "late", "t", None, "c3"),
        ],
    )
    rows = tr.dangling_repair(df).orderBy("slot", "part", "pos").collect()
    assert [(r.role, r.reply_to, r.text == tr.PLACEHOLDER) for r in rows] == [
        ("user", None, False), ("assistant", None, False), ("tool", "c1", False), ("tool", "c2", True),
        ("assistant", None, False), ("tool", "c3", True), ("user", None, False), ("tool", "c3", False),
    ]


def test_sentinels_do_not_start_a_turn(spark):
    ok = json.dumps({"meta": {"has_relevant_content": True}})
    bad = json.dumps({"meta": {"has_relevant_content": False}})
    know = tr.KNOWLEDGE_TOOL
    df = msgs(
        spark,
        [
            ("tool", bad, know), ("user", "q"), ("tool", ok, know), ("tool", bad, know), ("user", "watch", "system_monitor"),
            ("tool", "oops", know), ("tool", bad, know), ("tool", bad, "search"),
        ],
    )
    r = tr.turn_tool_count(df).first()
    assert (r.last_user, r.tool_count, r.capped) == (1, 4, True)
    s = tr.fail_streak(df).first()
    assert (s.streak, s.refuse) == (2, True)
    assert texts(tr.drop_sentinels(df)).count("watch") == 0


def test_no_user_means_no_turn(spark):
    df = msgs(spark, [("assistant", "a"), ("tool", "{}", tr.KNOWLEDGE_TOOL)])
    assert tr.turn_tool_count(df).first().tool_count == 0 and tr.fail_streak(df).first().streak == 0


def test_paging(spark):
    df = msgs(spark, [("user", str(i)) for i in range(5)])
    pages = {p: [(r.content, r.total, r.has_more) for r in tr.history_page(df, p, 2).orderBy("seq").collect()] for p in (1, 2, 3, 4)}
    assert pages == {1: [("0", 5, True), ("1", 5, True)], 2: [("2", 5, True), ("3", 5, True)], 3: [("4", 5, False)], 4: []}
    assert [r.type for r in tr.message_view(df).take(1)] == ["human"]


def test_envelopes(spark):
    rows = ['{"ok": true}', '{"ok": false, "error": {"code": "X"}}', '{"q": 1}', "[1]", "no", "", '{"ok": null}', '{"ok": 0}']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(rows)], "i int, content string")
    runs = [(r.ok, r.error_code) for r in tr.tool_runs(df).orderBy("i").collect()]
    assert runs == [
        (True, None), (False, "X"), (None, None), (False, "PARSE_FAILED"), (False, "PARSE_FAILED"), (None, None), (None, None), (False, None)
    ]
    flags = [r.f for r in df.select("i", tr.tool_ok(F.col("content")).alias("f")).orderBy("i").collect()]
    assert flags == [True, False, True, True, True, True, False, False]


def test_gate_blocks_inactive_tools_and_passes_unnamed(spark):
    calls = spark.createDataFrame([(1, "search"), (2, "sql_tool"), (3, None), (4, "")], "call_id int, tool string")
    active = spark.createDataFrame([("sql_tool",)], "tool string")
    got = {r.call_id: (r.allowed, r.code) for r in tr.tool_gate(calls, active).collect()}
    assert got == {1: (False, "TOOL_DISABLED"), 2: (True, None), 3: (True, None), 4: (True, None)}


def test_payload_stops_at_the_first_overflow(spark):
    items = spark.createDataFrame([(1, 0, "x" * 5), (1, 1, "y" * 6), (1, 2, "z")], "payload_id int, pos int, piece string")
    rows = tr.bounded_payload(items, 10).collect()
    assert [(r.pos, r.kept_results, r.total_results, r.truncated) for r in rows] == [(0, 1, 3, True)]


def test_cleanup_by_last_or_by_any_touch(spark):
    df = spark.createDataFrame([("a", 1), ("a", 9), ("b", 2)], "thread_id string, ts int")
    assert [r.thread_id for r in tr.cleanup_threads(df, F.lit(5)).collect()] == ["b"]
    assert sorted(r.thread_id for r in tr.cleanup_threads(df, F.lit(5), any_old=True).collect()) == ["a", "b"]


def test_search_payload(spark):
    raw = json.dumps({"results": [{"title": " t ", "content": "c" * 900, "published_time": "2024"}] * 7, "answer": "a"})
    rows = tr.shrink_results(spark.createDataFrame([(1, raw)], "id int, j string"), "j").collect()
    assert len(rows) == 5 and rows[0].title == "t" and len(rows[0].content) == 800 and rows[0].published_date == "2024"
    assert rows[0].raw is None and rows[0].answer == "a"


def test_search_payload_without_results_keeps_its_answer(spark):
    df = spark.createDataFrame([(1, '{"results": [], "answer": " none "}'), (2, '{"results": []}')], "id int, j string")
    rows = sorted(tr.shrink_results(df, "j").collect())
    assert [(r.id, r.pos, r.title, r.answer, r.raw) for r in rows] == [(1, None, None, "none", None), (2, None, None, "", None)]


def test_text_that_is_no_payload_is_kept_cut(spark):
    df = spark.createDataFrame([(1, "broken"), (2, '{"answer": "x"}'), (3, "y" * 4000), (4, None)], "id int, j string")
    rows = sorted(tr.shrink_results(df, "j").collect(), key=lambda r: r.id)
    assert [r.raw for r in rows] == ["broken", '{"answer": "x"}', "y" * 2997 + "...", ""]
    assert {(r.pos, r.answer) for r in rows} == {(None, None)}


def test_summaries_of_batches_stand_for_the_checkpoints(spark, tmp_path):
    rows = [(f"t{i % 700}", i) for i in range(3000)] + [("busy", i) for i in range(900)] + [("odd", i) for i in range(50)] + [(None, 1)]
    df = spark.createDataFrame(rows, "thread_id string, checkpoint_id int")
    for named in (5, 4096):
        path = str(tmp_path / f"summaries{named}")
        for batch in (0, 1, 1, 2):  # a repeated batch replaces its own summary
            tr.append_summary(df.filter(F.col("checkpoint_id") % 3 == batch), path, batch, named)
        got = tr.summarised_stats(spark.read.schema(tr.SUMMARY).parquet(path), 2).collect()
        exact = {r.thread_id: r.n for r in tr.thread_stats(df, 2).collect()}
        assert [r.thread_id for r in got] == ["busy", "odd"] and {r.total_checkpoints for r in got} == {len(rows)}
        assert all(r.n <= exact[r.thread_id] <= r.n_most for r in got)
        assert abs(got[0].total_threads - 702) <= 702 * 0.05
        if named > 702:
            assert all(r.n == r.n_most == exact[r.thread_id] for r in got)
