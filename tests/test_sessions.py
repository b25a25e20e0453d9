"""Session state over restarts: variables expire, sessions end and open anew."""

import datetime as dt

from corpusloom.session import scratch_path
from corpusloom.sources import registry as G
from corpusloom.streaming.jobs import dedup_stream, dedup_stream_stored
from corpusloom.streaming.sessions import session_stream
from pyspark.sql import functions as F

MESSAGES = "session_id string, ts timestamp, turn long, role string, content string, variables map<string,string>"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def arrive(spark, path, rows, schema=MESSAGES):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_restart_expiry_and_end(spark):
    path, out, check = (scratch_path(spark, x) for x in ("s-in", "s-out", "s-check"))

    def run():
        stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(path)

        def save(batch, batch_id):
            batch.withColumn("b", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        states = session_stream(stream, "1 minute", 10 * 60_000, 5 * 60_000)
        states.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(out).collect()
        return {(r["session_id"], r["event"], r["n_messages"]): r for r in got}

    arrive(spark, path, [("a", at(0), 0, "user", "hello", {"drug": "x", "dose": "1"}), ("a", at(1), 1, "assistant", "hi", None), ("b", at(0), 0, "user", "b0", {"k": "v"})])
    got = run()
    assert got["a", "open", 2]["variables"] == {"drug": "x", "dose": "1"} and got["a", "open", 2]["messages"] is None
    # a second start goes on from the checkpoint: the dose is renewed, the drug expires
    arrive(spark, path, [("a", at(5), 2, "user", "more", {"dose": "2"})])
    got = run()
    assert got["a", "open", 3]["variables"] == {"dose": "2"} and got["a", "open", 3]["last_ts"] == at(5)
    # the watermark passes both sessions' ends; what comes later opens a session anew
    arrive(spark, path, [("c", at(60), 0, "user", "later", None)])
    arrive(spark, path, [("a", at(61), 3, "user", "again", None)])
    got = run()
    ended = got["a", "ended", 3]
    assert [(m["turn"], m["content"]) for m in ended["messages"]] == [(0, "hello"), (1, "hi"), (2, "more")] and ended["variables"] == {"dose": "2"}
    assert got["b", "ended", 1]["variables"] == {"k": "v"}
    assert got["a", "open", 1]["variables"] == {} and ("c", "open", 1) in got


def test_state_holds_one_delay_only(spark):
    """The same repeats weeks apart: found by both forms, with less state where the hashes are stored."""
    schema = "id long, text string, ts timestamp"
    path = scratch_path(spark, "d-in")
    for day in range(6):
        arrive(spark, path, [(100 * day + i, f"text {i if i < 20 else 100 * day + i}", at(1440 * 3 * day + i)) for i in range(40)], schema)
    arrive(spark, path, [(9999, "text 3", at(1440 * 17)), (9998, "last", at(1440 * 17))], schema)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out, hashes = scratch_path(spark, "d-out"), scratch_path(spark, "d-hashes")
    stored = dedup_stream_stored(stream(), "text", "ts", "1 day", hashes, out, scratch_path(spark, "d-check"))
    stored.awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == len({r["text"] for r in rows}) == 20 + 6 * 20 + 1
    assert {r["id"] for r in rows if r["text"] == "text 3"} == {3}
    long = dedup_stream(stream(), "text", "ts", "400 days").writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "d-long"))
    long = long.trigger(availableNow=True).start()
    long.awaitTermination()
    held = lambda q: q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    assert held(stored) <= 60 < held(long) == len(rows)


def test_a_batch_changes_the_registry_once(spark):
    path = scratch_path(spark, "registry")
    columns = "id string, filename string, path string, size_bytes long, status string, chunk_count long, error_message string, created_at timestamp, updated_at timestamp"
    G.commit_registry(spark.createDataFrame([("1", "f", "p", 1, "pending", 0, None, at(0), at(0)), ("2", "f", "p", 1, "pending", 0, None, at(0), at(0))], columns), path)
    change = lambda i, status: spark.createDataFrame([(i, status, 3, None)], "id string, status string, chunk_count long, error_message string")
    assert G.apply_batch(spark, path, change("1", "indexed"), F.lit(at(1)), "s", 0)
    assert not G.apply_batch(spark, path, change("1", "failed"), F.lit(at(2)), "s", 0)
    assert G.apply_batch(spark, path, change("2", "failed"), F.lit(at(3)), "s", 1) and G.apply_batch(spark, path, change("2", "indexed"), F.lit(at(4)), "other", 0)
    assert G.applied_batches(spark, path, G.latest_version(spark, path)) == {"s": 1, "other": 0} and G.latest_version(spark, path) == 4
    assert {(r["id"], r["status"], r["updated_at"]) for r in G.read_file_registry(spark, path).collect()} == {("1", "indexed", at(1)), ("2", "indexed", at(4))}
