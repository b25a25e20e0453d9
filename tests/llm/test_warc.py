import gzip
import hashlib

from corpusloom.llm import warc as W

BIG = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 60


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(spark):
    rows = [(1, "http://a/1", BIG), (2, "http://a/2\r\nX: y", BIG), (3, None, BIG), (4, "http://a/4", "small"), (5, "http://a/5", "small"), (6, "u", None), (7, "u", ""), (3, None, BIG), (None, "n", "x"), (8, "v", "z" * 3000000)]
    got = W.archive_round_trip(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r["page_id"])
        raw = html.encode()
        again = html == BIG and r["page_id"] != 3
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if again else ("response", None))


def test_archives_are_warc_and_captures_nest(spark, tmp_path):
    path = str(tmp_path / "warc")
    W.write_warc(pages(spark, [(1, "http://a/1", BIG), (2, "http://a/2", BIG)]), path)
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "warc").glob("*.gz"))
    assert raw.count(b"WARC-Type: ") == 6 and raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    whole = W.assemble(W.read_records(spark, path, payloads=True)).orderBy("page").collect()
    assert [r["response"]["kind"] for r in whole] == ["revisit", "response"]
    assert whole[1]["response"]["payload"] == BIG.encode() and whole[0]["metadata"]["note"] == f"payload-bytes: {len(BIG.encode())}"
    assert [r["uri"] for r in whole] == ["http://a/1", "http://a/2"]


def test_missing_records_leave_nulls(spark, tmp_path):
    path = str(tmp_path / "warc")
    W.write_warc(pages(spark, [(1, "u", "a")]), path)
    records = W.read_records(spark, path)
    alone = W.assemble(records.filter("kind <> 'metadata'")).collect()
    assert alone[0]["metadata"] is None and alone[0]["response"]["kind"] == "response"


def test_no_pages(spark):
    assert W.archive_round_trip(pages(spark, [])).count() == 0
