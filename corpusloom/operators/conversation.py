"""Conversation memory over a message table.

``messages(session_id, turn, role, content)``. Sessions may be of any length:
limits are top-n windows (pruned before the shuffle), lags run by spans of
turns, and the running summary needs the last few messages only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import lexicon as L
from corpusloom.functions.ranking import previous_in_group, top_per_group

MAX_HISTORY = 20
SUMMARIZE_OVER = 15


def last_n_messages(messages: DataFrame, n: int | None = MAX_HISTORY) -> DataFrame:
    """The most recent ``n`` messages per session; 0 or None keeps all."""
    if not n:
        return messages
    return top_per_group(messages, ["session_id"], [F.desc("turn")], n, "_recent").drop("_recent")


def history_text(messages: DataFrame, n: int | None = MAX_HISTORY) -> DataFrame:
    """session_id, history: one speaker-labelled line per message."""
    speaker = F.when(F.col("role") == "user", L.SPEAKER["user"]).otherwise(L.SPEAKER["other"])
    line = F.concat(speaker, F.lit(": "), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return last_n_messages(messages, n).groupBy("session_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("history")
    )


def last_user_queries(messages: DataFrame) -> DataFrame:
    """session_id, last_query, previous_query (NULL with a single user message)."""
    users = messages.filter(F.col("role") == "user").select("session_id", "turn", "content")
    recent = top_per_group(users, ["session_id"], [F.desc("turn")], 2)
    return recent.groupBy("session_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("content"))).alias("last_query"),
        F.max(F.when(F.col("rank") == 2, F.col("content"))).alias("previous_query"),
    )


def previous_user_query(messages: DataFrame) -> DataFrame:
    """User messages with the session's user message before each of them."""
    users = messages.filter(F.col("role") == "user")
    return previous_in_group(users, "session_id", "turn", "content", "previous_query")


def topics_in(contents: Column, topics: list[str]) -> Column:
    """The topics contained in any of the strings, in the topics' order."""
    return F.filter(
        F.array(*[F.lit(t) for t in topics]), lambda t: F.exists(contents, lambda c: F.contains(c, t))
    )


def summarize_sessions(
    messages: DataFrame,
    threshold: int = SUMMARIZE_OVER,
    max_history: int = MAX_HISTORY,
    topics: list[str] | None = None,
) -> DataFrame:
    """session_id, n_messages, n_summaries, summary, kept_from_turn, kept.

    Replaying every message is not needed. A summary is made whenever more than
    ``threshold`` messages are held and leaves the last ``max_history // 2``;
    counting that through gives the message at which the last one happened and
    the window it saw, both near the end of the session. Topics are listed in
    a fixed order.
    """
    topics = topics or L.SUMMARY_TOPICS
    keep = max(1, max_history // 2)
    every = max(1, threshold + 1 - keep)
    window = max(threshold, keep) + 1
    totals = messages.groupBy("session_id").agg(F.count("*").alias("n_messages"))
    tail = top_per_group(messages, ["session_id"], [F.desc("turn")], window + every, "_back")

    n = F.col("n_messages")
    fired = F.when(n > threshold, F.floor((n - (threshold + 1)) / every) + 1).otherwise(F.lit(0))
    last = F.when(F.col("n_summaries") > 0, threshold + 1 + (F.col("n_summaries") - 1) * every)
    position = n - F.col("_back") + 1
    seen = (position <= F.col("_last")) & (position > F.col("_last") - window)
    held = F.col("_last").isNull() | (position > F.col("_last") - keep)

    rows = tail.join(totals, "session_id").withColumn("n_summaries", fired.cast("bigint")).withColumn("_last", last)
    out = rows.groupBy("session_id").agg(
        F.first("n_messages").alias("n_messages"),
        F.first("n_summaries").alias("n_summaries"),
        F.first("_last").alias("_last"),
        F.count_if(seen).alias("_seen"),
        F.collect_list(F.when(seen & (F.col("role") == "user"), F.col("content"))).alias("_said"),
        F.min(F.when(held, F.col("turn"))).alias("kept_from_turn"),
    )
    found = topics_in(F.col("_said"), topics)
    summary = F.when(
        F.col("n_summaries") > 0,
        F.when(F.size(found) > 0, F.concat(F.lit("讨论主题: "), F.array_join(found, ", "))).otherwise(
            F.concat(F.lit("对话包含 "), F.col("_seen").cast("string"), F.lit(" 条消息"))
        ),
    )
    kept = F.when(F.col("_last").isNull(), n).otherwise(n - F.col("_last") + F.least(F.lit(keep), F.col("_last")))
    return out.select(
        "session_id", "n_messages", "n_summaries", summary.alias("summary"), "kept_from_turn",
        kept.cast("bigint").alias("kept"),
    )
