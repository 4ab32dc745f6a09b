import base64
import hashlib
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reelsift.llm import warc

TRAP = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nabcde"
HTML = [
    "<p>é</p>", "<p>é</p>", None, "", TRAP, f"x\r\n\r\n{TRAP}\r\n\r\n{TRAP}\r\n\r\n", "\r\n\r\n", "\r\n\r\nWARC/1.",
    "line\nline\r\n" * 5000, f"before\r\n\r\n{TRAP}", " \x00﻿", f"\r\n\r\n{TRAP}\r\n\r\n" * 20,
]
SCHEMA = "page_id long, url string, html string"


def pages(spark, html=HTML, ids=None):
    ids = range(len(html)) if ids is None else ids
    return spark.createDataFrame([(i, f"http://x/{i}\r\nX: y", h) for i, h in zip(ids, html, strict=True)], SCHEMA)


def brute(rows):
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, h in rows:
        data = (h or "").encode()
        again = i is not None and first[h or ""] != i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_round_trip(spark, tmp_path, split):
    rows = list(enumerate(HTML * 3))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = warc.round_trip(pages(spark, HTML * 3).coalesce(2), str(tmp_path / "a"))
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_payloads_survive(spark, tmp_path):
    warc.write_archives(pages(spark).coalesce(1), str(tmp_path / "a"))
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    want = {h or "" for h in HTML}
    assert {bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"} == want
    assert all(r["uri"].startswith("http://x/") for r in got)


def test_files_are_warc(spark, tmp_path):
    """A reader that knows nothing but the format walks the file by its lengths."""
    warc.write_archives(pages(spark).coalesce(1), str(tmp_path / "a"))
    (file,) = Path(tmp_path / "a").glob("part-*")
    data, at, kinds = file.read_bytes(), 0, []
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        end = at + len(head) + 4 + length
        assert data[end : end + 4] == b"\r\n\r\n"
        kinds.append(re.search(rb"WARC-Type: (\w+)", head)[1])
        at = end + 4
    assert len(kinds) == len(HTML) and kinds.count(b"revisit") == 2


def test_broken_archives_keep_what_comes_before(spark, tmp_path):
    (tmp_path / "a").mkdir()
    good = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    (tmp_path / "a" / "cut").write_bytes((good * 3 + "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 9999\r\n\r\nno").encode()[:-1])
    (tmp_path / "a" / "none").write_bytes(b"no archive at all")
    (tmp_path / "a" / "empty").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert [bytes(r["payload"]) for r in got][:3].count(b"ok") == 3 and len(got) <= 4


def test_edges(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
    html, ids = ["a", "a", "b", "a", None, "a"], [5, 5, 5, 6, None, None]
    rows = list(zip(ids, html, strict=True))
    clash = pages(spark, html, ids).withColumns({"record": F.lit(1), "digest": F.lit(2), "payload": F.lit(3), "first": F.lit(4)})
    got = sorted((tuple(r)[:4] for r in warc.round_trip(clash).collect() if r["page_id"] is not None), key=repr)
    assert got == [r[:4] for r in brute(rows) if r[0] is not None]
