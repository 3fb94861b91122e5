import base64
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from gneiss.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


ROWS = [(5, "http://a/", "<p>x</p>", "d"), (2, "http://b/ c\r\nX: 1", "<p>x</p>", "d"), (9, None, None, "d"), (4, "http://d/", "", "d"), (7, "u", "WARC/1.1\r\n\r\nüé\r\n\r\n", None), (None, "n", "<p>x</p>", "d"), (8, "u", "long " * 50_000, "d")]


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages(spark, ROWS), path)
    got = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(ROWS)
    for i, _, html, _ in ROWS:
        body = (html or "").encode()
        r = got[i]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == body
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {5: ("revisit", 2), 2: ("response", None), None: ("revisit", 2), 4: ("response", None), 9: ("revisit", 4), 7: ("response", None), 8: ("response", None)}


def test_predicates_are_pushed_and_payloads_skipped(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages(spark, ROWS), path)
    df = warc.read_archives(spark, path, ["page_id", "record_type", "payload"]).filter((F.col("record_type") == "response") & (F.col("page_id") >= 7))
    assert sorted(r["page_id"] for r in df.collect()) == [7, 8]
    text = "\r\n\r\n".join(warc.record_text(i, u, h, None) for i, u, h, _ in ROWS) + "\r\n\r\n"
    counted = [0]
    kept = list(warc.read_records(io.BytesIO(text.encode()), ["page_id", "payload"], [warc.EqualTo(("page_id",), 4)], counted))
    assert kept == [(4, b"")] and counted == [1]
    list(warc.read_records(io.BytesIO(text.encode()), ["page_id"], [], counted))
    assert counted == [1]


def test_damaged_and_empty(spark, tmp_path):
    text = warc.record_text(1, "u", "body", None).encode()
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(text[:-2]), ["payload"], []))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(b"junk\r\n" + text), ["page_id"], []))
    warc.write_archives(pages(spark, []), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0
    with pytest.raises(Exception):
        spark.read.format("warc").schema("nothing string").load(f"file://{tmp_path}/e").collect()
