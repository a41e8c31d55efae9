import hashlib
import re

import pytest

from fathom.llm import warc as op
from fathom.session import fresh_path
from helpers import clashing

BIG, OTHER = "é" * 600, "x" * 1000
PAGES = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "http://a/\r\nX: y", OTHER), (5, "u", "x" * 999),
    (6, "u", "x" * 999), (7, "u", None), (8, "u", ""), (9, "u", "\r\n\r\nWARC/1.1\r\n"), (3, "again", BIG), (None, "n", BIG), (None, "n", "q" * 2000),
]


def test_round_trip(spark):
    table = clashing(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    folder = fresh_path(spark, "archive")
    op.write(table, folder)
    got = sorted(((r.record, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op.records(spark, folder).collect()), key=str)
    want = []
    for key, _, html in PAGES:
        body = (html or "").encode()
        keys = [k for k, _, h in PAGES if (h or "") == (html or "") and k is not None]
        revisit = len(body) >= 1000 and keys and key != max(keys)
        want.append(("" if key is None else str(key), len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", str(max(keys)) if revisit else None))
    assert [g[1:] for g in got if g[0]] == [w[1:] for w in sorted(want, key=str) if w[0]]
    assert len(got) == len(PAGES)
    # Every payload is stored once.
    assert op.payloads(spark, folder).count() == len({h or "" for _, _, h in PAGES})
    for row in op.originals(spark, folder).collect():
        content = bytes(row.content)
        head, rest = content.split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n") and content.endswith(op.END)
        length = int(re.findall(rb"\r\nContent-Length: (\d+)", head)[0])
        assert len(rest) == length + len(op.END)


def test_changed_payload_is_noticed(spark):
    folder = fresh_path(spark, "archive")
    op.write(spark.createDataFrame(PAGES[:2], "page_id long, url string, html string"), folder)
    stored = spark.read.parquet(f"{folder}/payloads").collect()
    changed = [(r.digest, bytearray(b"changed")) for r in stored]
    spark.createDataFrame(changed, "digest string, payload binary").write.mode("append").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="changed payload"):
        op.records(spark, folder).collect()


def test_empty_table(spark):
    folder = fresh_path(spark, "archive")
    op.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert op.records(spark, folder).count() == 0
    assert op.originals(spark, folder).count() == 0
