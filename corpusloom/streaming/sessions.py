"""Sessions as keyed state: messages, context variables with a time to live, and an end."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusloom.streaming.jobs import ROCKSDB, STATE_PROVIDER

SESSION_OUT = StructType([
    StructField("session_id", StringType()), StructField("event", StringType()), StructField("n_messages", LongType()),
    StructField("last_ms", LongType()), StructField("variables", StringType()), StructField("messages", StringType()),
])


class SessionState(StatefulProcessor):
    """Emits ``open`` with the live variables after every batch of a session, ``ended`` with its messages when its time is up.

    All times are the messages' own, so that a replay gives the same result: a
    variable lives ``ttl_ms`` from the message that set it, a session ends when
    the watermark, or a message of its own, is ``idle_ms`` past its last one.
    """

    def __init__(self, idle_ms: int, ttl_ms: int):
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "turn bigint, role string, content string")
        self.variables = handle.getMapState("variables", "name string", "value string, until bigint")
        self.facts = handle.getValueState("facts", "n bigint, last bigint")

    def _row(self, key: tuple, event: str, n: int, last: int, messages: str | None) -> pd.DataFrame:
        live = {}
        for (name,), (value, until) in list(self.variables.iterator()):
            if until > last:
                live[name] = value
            else:
                self.variables.removeKey((name,))
        row = [str(key[0]), event, n, last, json.dumps(live, ensure_ascii=False, sort_keys=True), messages]
        return pd.DataFrame([row], columns=SESSION_OUT.names)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.facts.get() if self.facts.exists() else (0, 0)
        arrived = pd.concat(list(rows)).sort_values(["ms", "turn"])
        for ms, turn, role, content, given in zip(*(arrived[c] for c in ("ms", "turn", "role", "content", "variables")), strict=True):
            if n and ms > last + self.idle_ms:
                yield self._end(key, n, last)
                n, last = 0, 0
            self.messages.appendValue((int(turn), role, content))
            n, last = n + 1, max(last, int(ms))
            for name, value in json.loads(given or "{}").items():
                self.variables.updateValue((name,), (value, int(ms) + self.ttl_ms))
        self.facts.update((n, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle_ms)
        yield self._row(key, "open", n, last, None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._end(key, *self.facts.get())

    def _end(self, key: tuple, n: int, last: int) -> pd.DataFrame:
        said = [list(m) for m in self.messages.get()]
        row = self._row(key, "ended", n, last, json.dumps(said, ensure_ascii=False))
        for state in (self.messages, self.variables, self.facts):
            state.clear()
        return row

    def close(self) -> None:
        pass


# the runner that initialises stateful processors does not see shipped packages
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def session_stream(messages: DataFrame, delay: str, idle_ms: int, ttl_ms: int) -> DataFrame:
    """session_id, event, n_messages, last_ts, variables, messages of ``messages(session_id, ts, turn, role, content, variables)``.

    ``variables`` is a map of the context variables that a message sets (may be
    null), and in the result the map of those that live at the last message.
    ``messages`` is null while a session is open and holds all its messages, in
    the order of arrival, when it has ended; its state is gone then, and a
    later message opens it anew. Rows later than the watermark are dropped.
    """
    spark = messages.sparkSession
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    timed = messages.withWatermark("ts", delay).select(
        F.col("session_id").cast("string").alias("session_id"), "ts", F.unix_millis("ts").alias("ms"), F.col("turn").cast("bigint").alias("turn"),
        "role", "content", F.to_json("variables").alias("variables"),
    )
    out = timed.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=SessionState(idle_ms, ttl_ms), outputStructType=SESSION_OUT, outputMode="Update", timeMode="EventTime"
    )
    listed = F.transform(F.from_json("messages", "array<array<string>>"), lambda m: F.struct(m[0].cast("bigint").alias("turn"), m[1].alias("role"), m[2].alias("content")))
    return out.select(
        "session_id", "event", "n_messages", F.timestamp_millis("last_ms").alias("last_ts"), F.from_json("variables", "map<string,string>").alias("variables"), listed.alias("messages")
    )
