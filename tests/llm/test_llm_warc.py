import base64
import hashlib

import pytest

from remedia.llm.warc import Index, archive, build_index, parse, record, url_key, write_archives
from remedia.session import scratch_path

SCHEMA = "page_id long, url string, html string"


def brute(pages, least=0):
    most = {}
    for page_id, _, html in pages:
        if page_id is not None:
            most[html or ""] = max(page_id, most.get(html or "", page_id))
    out = []
    for page_id, _, html in pages:
        raw = (html or "").encode()
        first = most.get(html or "")
        same = page_id == first or len(raw) < least
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "response" if same else "revisit", None if same else first))
    return sorted(out, key=str)


PAGES = [(i, f"http://www.h{i % 7}.example.com/p/{i % 11}?q={i}", f"<p>{'x' * (i % 5)}\r\n\r\né</p>") for i in range(120)] + [
    (500, None, None), (501, "", ""), (502, "http://a b.com/\r\nx", "WARC/1.1\r\n"), (503, "HTTP://A.com", "z"),
    (503, "http://a.com", "z"), (503, "http://a.com", "z"), (None, "http://n.com", "n"), (None, None, "z"),
    (504, "http://a.com", "long " * 40_000)]


@pytest.mark.parametrize("least", [0, 8])
def test_round_trip(spark, least):
    frame = spark.createDataFrame(PAGES, SCHEMA).selectExpr("*", "1 AS offset", "'f' AS file", "2 AS first_id")
    assert sorted(map(tuple, archive(frame, least).collect()), key=str) == brute(PAGES, least)


def test_empty(spark):
    assert archive(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_and_binary_search(spark):
    pages = [(i, "http://one.org/" if i % 3 else f"http://s{i}.org/{i}", str(i)) for i in range(400)]
    root = scratch_path(spark, "warc-test")
    captures = write_archives(spark.createDataFrame(pages, SCHEMA).repartition(5), root)
    index = Index(root, build_index(captures, root, block_lines=7))
    for page_id, url, html in pages:
        places = index.places(url_key(url), page_id)
        assert len(places) == 1
        headers, block = index.record(places[0])
        assert headers["WARC-Record-ID"] == f"<urn:page:{page_id}>" and block.endswith(b"\r\n\r\n" + html.encode())
    assert index.places(url_key("http://none.org/"), 1) == []


def test_keys():
    assert url_key("https://WWW.Example.com:8080/A?b#c") == "com,example,www:8080)/a?b"
    assert url_key("http://example.com?x") == "com,example)/?x" and url_key(None) == ""


def test_parse_refuses_cut_records():
    with pytest.raises(ValueError, match="length"):
        parse(record(1, "u", b"payload", None, False)[:-3])
