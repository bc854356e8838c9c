"""Chat transcripts: cleaning, trimming, repair, paging, export.

``messages(conv_id, seq, role, name, text, call_ids, reply_to)``: ``seq`` orders the
messages of a conversation and is unique in it, ``call_ids`` are the tool calls of an
assistant message, ``reply_to`` is the call a tool message answers. Orders within a
conversation are cut into slices, so one endless conversation does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.session import materialize
from shelfmark.functions.text import is_json, lstrip, rstrip, strip
from shelfmark.functions.windows import running, turn_slice

# Fixed values of the transcript protocol.
SENTINELS = ["system_monitor", "system_terminator"]
PLACEHOLDER = '{"ok": false, "error": "工具调用未完成，结果在历史处理中丢失"}'
KNOWLEDGE_TOOL = "query_internal_knowledge"
TOOL_CAP = 3
FAILURE_LIMIT = 2
KEPT_RUNS = 50
ROLE_NAMES = {"user": "human", "assistant": "ai", "tool": "tool", "system": "system"}


def is_sentinel() -> Column:
    return (F.col("role") == "user") & F.coalesce(F.col("name").isin(SENTINELS), F.lit(False))


def drop_sentinels(messages: DataFrame) -> DataFrame:
    return messages.filter(~is_sentinel())


def history_trim(messages: DataFrame, max_tokens: int, size: Column | None = None, per_token: int = 3) -> DataFrame:
    """Longest end of each conversation within ``max_tokens`` that starts on a user message.

    Tokens are the summed ``size`` (characters by default) floor-divided by ``per_token``.
    When nothing fits, the last user message and all after it stay; without any user
    message, the last message.
    """
    size = F.length("text") if size is None else size
    ends = running(
        messages, ["conv_id"], turn_slice(F.col("seq")), [F.col("seq").desc()], {"_suffix": size.cast("bigint")}, descending=True
    )
    user = F.col("role") == "user"
    fits = F.floor(F.col("_suffix") / per_token) <= max_tokens
    start = ends.groupBy("conv_id").agg(
        F.coalesce(F.min(F.when(user & fits, F.col("seq"))), F.max(F.when(user, F.col("seq"))), F.max("seq")).alias("_start")
    )
    return messages.join(start, "conv_id").filter(F.col("seq") >= F.col("_start")).drop("_start")


def collapse_users(messages: DataFrame) -> DataFrame:
    """Merge consecutive user messages into one, texts joined by a blank line.

    User messages are consecutive when the same number of other messages precedes them.
    """
    user = F.col("role") == "user"
    counted = running(
        messages, ["conv_id"], turn_slice(F.col("seq")), [F.col("seq")], {"_breaks": F.when(user, 0).otherwise(1)}
    )
    grouped = counted.groupBy("conv_id", "_breaks", user.alias("_user")).agg(
        F.min("seq").alias("seq"),
        F.min_by(F.struct("role", "name", "call_ids", "reply_to"), "seq").alias("head"),
        F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts"),
        F.count("*").alias("merged"),
    )
    texts = F.transform("parts", lambda p: p["text"])
    last = F.size(texts) - 1
    # White space goes at every joint; a blank text between two others disappears.
    joints = F.transform(
        texts, lambda x, i: F.when(i == 0, rstrip(x)).when(i == last, lstrip(x)).otherwise(strip(x))
    )
    kept = F.filter(joints, lambda x, i: (x != "") | (i == 0) | (i == last))
    text = F.when(F.col("merged") == 1, texts[0]).otherwise(F.array_join(kept, "\n\n"))
    name = F.when(F.col("merged") == 1, F.col("head.name"))
    return grouped.select(
        "conv_id", "seq", F.col("head.role").alias("role"), name.alias("name"), text.alias("text"),
        F.col("head.call_ids").alias("call_ids"), F.col("head.reply_to").alias("reply_to"), "merged",
    )


def dangling_repair(messages: DataFrame) -> DataFrame:
    """Give every tool call without a reply right after it a placeholder reply.

    Adds ``slot, part, pos``: the order of the repaired transcript (message, its replies,
    placeholders).
    """
    cut = turn_slice(F.col("seq"))
    slots = running(messages, ["conv_id"], cut, [F.col("seq")], {"slot": F.when(F.col("role") != "tool", 1).otherwise(0)})
    placed = slots.withColumns(
        {"part": F.when(F.col("role") == "tool", 1).otherwise(0), "pos": F.when(F.col("role") == "tool", F.col("seq")).otherwise(0)}
    )
    calls = placed.filter((F.col("role") == "assistant") & (F.size("call_ids") > 0)).select(
        "conv_id", "slot", "seq", F.posexplode(F.array_distinct("call_ids")).alias("pos", "reply_to")
    )
    answered = placed.filter(F.col("role") == "tool").select("conv_id", "slot", "reply_to")
    missing = calls.join(answered, ["conv_id", "slot", "reply_to"], "left_anti")
    made = missing.select(
        "conv_id", "seq", F.lit("tool").alias("role"), F.lit(None).cast("string").alias("name"),
        F.lit(PLACEHOLDER).alias("text"), F.array().cast("array<string>").alias("call_ids"), "reply_to", "slot",
        F.lit(2).alias("part"), F.col("pos").cast("bigint").alias("pos"),
    )
    cols = ["conv_id", "seq", "role", "name", "text", "call_ids", "reply_to", "slot", "part", "pos"]
    return placed.withColumn("pos", F.col("pos").cast("bigint")).select(*cols).unionByName(made.select(*cols))


def transcript_clean(messages: DataFrame, max_tokens: int | None) -> DataFrame:
    """Sentinels out, history trimmed, users merged, dangling calls answered.

    Each step reads its input more than once, so the two shrinking steps in between are
    written to the shared work folder instead of being computed again.
    """
    kept = drop_sentinels(messages)
    if max_tokens:
        kept = materialize(history_trim(kept, max_tokens), "trimmed")
    return dangling_repair(materialize(collapse_users(kept).drop("merged"), "merged"))


def last_user(messages: DataFrame) -> DataFrame:
    """``(conv_id, last_user)``: position of the last user message that is no sentinel."""
    real = (F.col("role") == "user") & ~is_sentinel()
    return messages.groupBy("conv_id").agg(F.max(F.when(real, F.col("seq"))).alias("last_user"))


def turn_tool_count(messages: DataFrame, tool: str = KNOWLEDGE_TOOL, cap: int = TOOL_CAP) -> DataFrame:
    """Replies of ``tool`` in the current turn, and whether they reached ``cap``."""
    hit = (F.col("role") == "tool") & (F.col("name") == tool) & (F.col("seq") > F.col("last_user"))
    out = messages.select("conv_id", "seq", "role", "name").join(last_user(messages), "conv_id").groupBy("conv_id").agg(
        F.max("last_user").alias("last_user"), F.count_if(F.coalesce(hit, F.lit(False))).alias("tool_count")
    )
    return out.withColumn("capped", F.col("tool_count") >= cap)


def relevance(content: Column) -> Column:
    """``meta.has_relevant_content`` of a tool envelope; NULL when it cannot be read."""
    return F.get_json_object(F.when(is_json(content), content), "$.meta.has_relevant_content").try_cast("boolean")


def fail_streak(messages: DataFrame, tool: str = KNOWLEDGE_TOOL, limit: int = FAILURE_LIMIT) -> DataFrame:
    """Failed look-ups at the end of the current turn, counted back to the last success."""
    looked = (
        messages.filter((F.col("role") == "tool") & (F.col("name") == tool))
        .select("conv_id", "seq", relevance(F.col("text")).alias("ok"))
        .join(last_user(messages), "conv_id")
        .filter((F.col("seq") > F.col("last_user")) & F.col("ok").isNotNull())
    )
    success = looked.groupBy("conv_id").agg(F.max(F.when(F.col("ok"), F.col("seq"))).alias("_good"))
    failed = looked.join(success, "conv_id").filter(~F.col("ok") & (F.col("seq") > F.coalesce("_good", F.lit(-1))))
    counts = failed.groupBy("conv_id").agg(F.count("*").alias("streak"))
    threads = messages.select("conv_id").distinct()
    out = threads.join(counts, "conv_id", "left").withColumn("streak", F.coalesce("streak", F.lit(0).cast("bigint")))
    return out.withColumn("refuse", F.col("streak") >= limit)


def last_n_runs(runs: DataFrame, key: str, order: str, n: int = KEPT_RUNS) -> DataFrame:
    """Newest ``n`` runs per thread; the limit also runs before the shuffle."""
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return runs.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")


def bounded_payload(items: DataFrame, max_chars: int) -> DataFrame:
    """Leading result items whose summed length stays within ``max_chars``.

    ``items(payload_id, pos, piece)``; adds ``kept_results``, ``total_results``, ``truncated``.
    """
    sized = running(
        items, ["payload_id"], turn_slice(F.col("pos")), [F.col("pos")], {"_used": F.length("piece").cast("bigint")}
    )
    fits = F.col("_used") <= max_chars
    flags = sized.groupBy("payload_id").agg(F.count_if(fits).alias("kept_results"), F.count("*").alias("total_results"))
    kept = sized.filter(fits).select(*[F.col(c).alias(f"_k_{c}") if c == "payload_id" else F.col(c) for c in items.columns])
    # a payload of which nothing fits keeps one row for its flags
    whole = flags.join(kept, F.col("payload_id") == F.col("_k_payload_id"), "left")
    return whole.select(
        *items.columns, "kept_results", "total_results", (F.col("kept_results") < F.col("total_results")).alias("truncated")
    )


def message_view(messages: DataFrame) -> DataFrame:
    """What a client may see: type, content and id."""
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    kind = F.coalesce(names[F.col("role")], F.col("role"), F.lit("unknown"))
    ident = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("seq").cast("string"))
    return messages.select("conv_id", "seq", kind.alias("type"), F.coalesce("text", F.lit("")).alias("content"), ident.alias("id"))


def history_page(messages: DataFrame, page: int, page_size: int) -> DataFrame:
    """One page of every conversation, with ``total`` and ``has_more``."""
    offset = (page - 1) * page_size
    seen = message_view(messages)
    numbered = running(seen, ["conv_id"], turn_slice(F.col("seq")), [F.col("seq")], {"_n": F.lit(1)})
    totals = seen.groupBy("conv_id").agg(F.count("*").alias("total"))
    on_page = numbered.filter((F.col("_n") > offset) & (F.col("_n") <= offset + page_size))
    return on_page.join(totals, "conv_id").select(
        "conv_id", "seq", "type", "content", "id", "total", (F.lit(offset + page_size) < F.col("total")).alias("has_more")
    )


def thread_markdown(messages: DataFrame) -> DataFrame:
    """Markdown sections ``(conv_id, part, section)``: part 0 is the head, then one per message.

    Sections stay rows, so a thread of any length can be written; sorted by part they are
    the document.
    """
    numbered = running(messages, ["conv_id"], turn_slice(F.col("seq")), [F.col("seq")], {"part": F.lit(1)})
    body = F.format_string("## 消息 %d - %s\n\n%s\n\n", F.col("part"), F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit("")))
    heads = messages.groupBy("conv_id").agg(F.count("*").alias("n"))
    head = F.format_string("# 对话记录：%s\n\n总消息数：%d\n\n---\n\n", F.col("conv_id").cast("string"), F.col("n"))
    return heads.select("conv_id", F.lit(0).cast("bigint").alias("part"), head.alias("section")).unionByName(
        numbered.select("conv_id", "part", body.alias("section"))
    )


# --- thread stores -----------------------------------------------------------------------


def thread_list(checkpoints: DataFrame, limit: int = 100) -> DataFrame:
    """Newest threads first with their number of checkpoints, first and last one."""
    return (
        checkpoints.groupBy("thread_id")
        .agg(
            F.count("*").alias("checkpoint_count"), F.max("checkpoint_id").alias("last_checkpoint_id"),
            F.min("checkpoint_id").alias("first_checkpoint_id"),
        )
        .orderBy(F.col("last_checkpoint_id").desc(), "thread_id")
        .limit(limit)
    )


def thread_stats(checkpoints: DataFrame, top: int = 5) -> DataFrame:
    """Most active threads beside the totals of the store; threads are counted once."""
    counts = checkpoints.groupBy("thread_id").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "thread_id").limit(top).select(
        "thread_id", "n",
        counts.agg(F.count("*")).scalar().alias("total_threads"),
        counts.agg(F.sum("n")).scalar().alias("total_checkpoints"),
    )


#: Size of a sketch (its error is about 1.04 / sqrt(2 ** SKETCH_BITS), 1.6 %) and threads that a summary names.
SKETCH_BITS, NAMED_THREADS = 12, 4096
SUMMARY = "sketch binary, n long, named array<struct<n: long, thread_id: string>>, unnamed long"


def thread_summary(checkpoints: DataFrame, named: int = NAMED_THREADS) -> DataFrame:
    """One row that stands for these checkpoints in :func:`summarised_stats`: ``sketch, n, named, unnamed``.

    ``sketch`` counts distinct threads; ``named`` holds the ``named`` busiest threads with their counts, and no other thread
    has more than ``unnamed``.
    """
    counts = checkpoints.groupBy(F.col("thread_id").cast("string").alias("thread_id")).agg(F.count("*").alias("n"))
    # one row more than is named: its count bounds all that follow
    busiest = counts.orderBy(F.col("n").desc(), "thread_id").limit(named + 1).agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", "thread_id")))).alias("top"))
    whole = checkpoints.agg(F.hll_sketch_agg(F.col("thread_id").cast("string"), F.lit(SKETCH_BITS)).alias("sketch"), F.count("*").alias("n"))
    return whole.crossJoin(busiest).select(
        "sketch", "n", F.slice("top", 1, named).alias("named"),
        F.coalesce(F.try_element_at("top", F.lit(named + 1))["n"], F.lit(0).cast("long")).alias("unnamed"),
    )


def append_summary(checkpoints: DataFrame, path: str, batch: int, named: int = NAMED_THREADS) -> None:
    """Store the summary of one batch; a repeated batch replaces its own."""
    thread_summary(checkpoints, named).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def summarised_stats(summaries: DataFrame, top: int = 5) -> DataFrame:
    """:func:`thread_stats` from stored summaries, without the checkpoints: ``thread_id, n, n_most, total_threads, total_checkpoints``.

    ``total_threads`` is within the sketch's error. A thread has at least ``n`` and at most ``n_most`` checkpoints; with no
    more threads than a summary names both are exact.
    """
    totals = summaries.agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("total_threads"), F.sum("n").alias("total_checkpoints"), F.sum("unnamed").alias("unnamed")
    )
    seen = summaries.select("unnamed", F.explode("named").alias("t")).groupBy("t.thread_id").agg(F.sum("t.n").alias("n"), F.sum("unnamed").alias("own"))
    best = seen.orderBy(F.col("n").desc(), "thread_id").limit(top)
    return best.crossJoin(totals).select("thread_id", "n", (F.col("n") + F.col("unnamed") - F.col("own")).alias("n_most"), "total_threads", "total_checkpoints")


def cleanup_threads(checkpoints: DataFrame, cutoff: Column, *, any_old: bool = False) -> DataFrame:
    """Threads to delete and their sizes: last touched before ``cutoff`` (or, with
    ``any_old``, holding any row older than it)."""
    age = F.min("ts") if any_old else F.max("ts")
    old = checkpoints.groupBy("thread_id").agg(age.alias("_ts"), F.count("*").alias("n")).filter(F.col("_ts") < cutoff)
    return old.select("thread_id", "n")


# --- tool envelopes ------------------------------------------------------------------------


def _is_object(content: Column) -> Column:
    return is_json(content) & F.regexp_like(content, F.lit(r"^\s*\{"))


def tool_runs(replies: DataFrame, content: str = "content") -> DataFrame:
    """Parsed envelopes: ``query, ok, error_code, has_relevant``; bad JSON is a failed run."""
    c = F.coalesce(F.nullif(F.col(content), F.lit("")), F.lit("{}"))
    good = _is_object(c)
    body = F.when(good, c)
    ok = F.get_json_object(body, "$.ok")
    return replies.withColumns(
        {
            "query": F.get_json_object(body, "$.query"),
            "ok": F.when(~good, F.lit(False)).when(ok.isNotNull(), ~ok.isin("false", "0", "", "[]", "{}")),
            "error_code": F.when(~good, "PARSE_FAILED").otherwise(F.get_json_object(body, "$.error.code")),
            "has_relevant": F.get_json_object(body, "$.meta.has_relevant_content").try_cast("boolean"),
        }
    )


def tool_ok(content: Column) -> Column:
    """The envelope's ``ok``; true when it is missing or the text is no JSON object."""
    body = F.when(_is_object(content), content)
    ok = F.get_json_object(body, "$.ok")
    named = F.array_contains(F.json_object_keys(body), "ok")
    value = F.when(ok.isNotNull(), ~ok.isin("false", "0", "", "[]", "{}")).when(named, F.lit(False))
    return F.coalesce(value, F.lit(True))


def tool_gate(calls: DataFrame, active: DataFrame) -> DataFrame:
    """Calls ``(call_id, tool)`` marked allowed or blocked; a call without a name passes."""
    names = active.select("tool").distinct()
    passed = calls.join(names, "tool", "left_semi").unionByName(calls.filter(F.col("tool").isNull() | (F.col("tool") == "")))
    blocked = calls.filter(F.col("tool") != "").join(names, "tool", "left_anti")
    none = F.lit(None).cast("string").alias("code")
    return passed.select("call_id", "tool", F.lit(True).alias("allowed"), none).unionByName(
        blocked.select("call_id", "tool", F.lit(False).alias("allowed"), F.lit("TOOL_DISABLED").alias("code"))
    )


SEARCH_JSON = (
    "struct<results:array<struct<title:string,url:string,content:string,score:double,"
    "published_date:string,published_time:string>>,answer:string>"
)


def shrink_results(payloads: DataFrame, json_col: str, max_items: int = 5, max_chars: int = 800) -> DataFrame:
    """Leading search results of each payload with their texts cut: one row per result.

    A payload whose list of results is empty keeps one row for its answer, with ``pos`` NULL. One without such a list
    keeps one row with its own text, cut, in ``raw``, which is NULL otherwise.
    """
    from shelfmark.functions.text import trim_three_dots

    rest = [c for c in payloads.columns if c != json_col]
    parsed = payloads.withColumn("_p", F.from_json(json_col, SEARCH_JSON))
    listed = F.col("_p.results").isNotNull()
    rows = parsed.select(
        *rest, F.when(listed, trim_three_dots(F.col("_p.answer"), 1200)).alias("answer"),
        F.when(~F.coalesce(listed, F.lit(False)), trim_three_dots(F.col(json_col), 3000)).alias("raw"),
        F.posexplode_outer(F.slice("_p.results", 1, max_items)).alias("pos", "r"),
    )
    return rows.select(
        *rest, "pos", F.when(F.col("pos").isNotNull(), trim_three_dots(F.col("r.title"), 200)).alias("title"),
        F.when(F.col("pos").isNotNull(), F.coalesce("r.url", F.lit(""))).alias("url"),
        F.when(F.col("pos").isNotNull(), trim_three_dots(F.col("r.content"), max_chars)).alias("content"), F.col("r.score").alias("score"),
        F.coalesce(F.nullif("r.published_date", F.lit("")), F.col("r.published_time")).alias("published_date"), "answer", "raw",
    )
