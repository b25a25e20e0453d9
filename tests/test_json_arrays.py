import json
import random

import pytest

from corpusloom.session import scratch_path
from corpusloom.sources import json_arrays as J
from corpusloom.sources.readers import QA_SCHEMA, read_sessions_json


def text_of(rng):
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "a", "ß", "😀", "\n", "} {", '\\"}', " "]) for _ in range(rng.randint(0, 60)))


def write(spark, rows, indent=None):
    path = scratch_path(spark, "array")
    lines = json.dumps(rows, ensure_ascii=False, indent=indent)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/one.json"))
    out.write(lines.encode())
    out.close()
    return path


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("indent", [None, 2])
def test_borders_anywhere(spark, small_splits, indent):
    rng = random.Random(indent)
    rows = [{"id": i, "text": text_of(rng), "tags": [text_of(rng)] * rng.randint(0, 2), "in": {"a": [{"b": text_of(rng)}]}} for i in range(600)]
    rows[300]["text"] = "}{" * 20_000  # one element over many splits
    path = write(spark, rows, indent)
    schema = "id long, text string, tags array<string>, `in` struct<a: array<struct<b: string>>>"
    df = J.read_json_array(spark, path, schema)
    got = {r["id"]: r for r in df.collect()}
    assert len(got) == 600 == df.count()
    for want in rows:
        r = got[want["id"]]
        assert (r["text"], r["tags"], r["in"]["a"][0]["b"]) == (want["text"], want["tags"], want["in"]["a"][0]["b"])
    splits = spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions()
    assert splits > 20


def test_small_arrays(spark):
    assert J.read_json_array(spark, write(spark, []), QA_SCHEMA).count() == 0
    path = write(spark, [{"question": "q"}, 5, "s}", [{"question": "inner"}], None, {"question": "r", "context": None}, {}])
    assert sorted(str(r["question"]) for r in J.read_json_array(spark, path, QA_SCHEMA).collect()) == ["None", "q", "r"]


def test_a_session_comes_back_with_its_notes(spark):
    """One indented object per file, with and without the optional fields."""
    full = {"session_id": "a", "messages": [{"role": "user", "content": "q", "timestamp": "2024-01-01T00:00:01", "metadata": {"k": "v"}}, {"role": "assistant", "content": "r"}], "summary": "s", "context": {"x": "1"}}
    bare = {"session_id": "b", "messages": [{"role": "user", "content": "only"}]}
    got = {}
    for one in (full, bare):
        for r in read_sessions_json(spark, write(spark, one, 2)).collect():
            got[r["session_id"], r["turn"]] = (r["role"], r["content"], r["timestamp"], r["metadata"], r["summary"], r["context"])
    assert got == {
        ("a", 0): ("user", "q", "2024-01-01T00:00:01", {"k": "v"}, "s", {"x": "1"}), ("a", 1): ("assistant", "r", None, {}, "s", {"x": "1"}),
        ("b", 0): ("user", "only", None, {}, None, {}),
    }
