import glob
import gzip
import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, key string, bytes int, payload int, kept string"
BIG, OTHER = "<p>é</p>\r\n\r\n" * 100, "WARC/1.1\r\nContent-Length: 9\r\n\r\n" * 40


def page_rows():
    r = [(1, "http://a", BIG), (2, "http://b", BIG), (9, "http://a\r\nX: y", BIG), (3, "u", OTHER), (4, None, OTHER), (5, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", ""), (10, "u", "\r\n\r\n"), (11, "u", "\n"),
         (None, "n", OTHER), (None, "n", "x" * 2000), (None, None, "x" * 2000), (12, "d", "y" * 1000), (12, "d", "y" * 1000), (12, "d", "y" * 1000), (12, "e", "y" * 1000), (11, "e", "y" * 1000), (13, "z", "z" * 999), (14, "z", "z" * 999),
         (15, "long", "ab\r\n" * 200_000), (16, "sp", " " * 1000 + "\t"), (17, "", "€" * 334), (18, "q", "€" * 334)]
    return r


def brute(rows, least=1000):
    """page, bytes, digest, type and refers_to, as counts."""
    out, groups = Counter(), {}
    for i, _, html in rows:
        b = (html or "").encode()
        groups.setdefault(b, []).append(i)
    for b, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        for k, i in enumerate(ids):
            again = len(b) >= least and k > 0
            out[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", ids[0] if again else None] += 1
    return out


def result(rows):
    return Counter((None if r["page_id"] is None else int(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], None if r["refers_to"] is None else int(r["refers_to"])) for r in rows.collect())


def plain_read(folder):
    """Archives read by the format's rules alone: (headers, block)."""
    for name in glob.glob(f"{folder}/*.gz"):
        with gzip.open(name) as f:
            data = f.read()
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            n = int(fields["Content-Length"])
            assert version == "WARC/1.1" and data[n : n + 4] == b"\r\n\r\n"
            yield fields, data[:n]
            data = data[n + 4 :]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "d", "k", 1, 2, "k") for r in page_rows()], SCHEMA).repartition(5)


def test_against_brute_force(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    records = warc.read_records(spark, path)
    assert result(warc.resolve_revisits(records)) == brute(page_rows())
    texts = Counter((r["page_id"], bytes(r["payload"])) for r in records.where("record_type = 'response'").collect())
    want = Counter((None if i is None else str(i), (t or "").encode()) for i, _, t in page_rows())
    assert texts <= want
    assert {b for _, b in texts} == {b for _, b in want}  # each payload is there


def test_archives_follow_the_format(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    records = list(plain_read(path))
    ids = {f["WARC-Record-ID"]: (f, b) for f, b in records}
    assert len(records) == len(page_rows()) == len(ids)
    for f, b in records:
        assert {"WARC-Type", "WARC-Date", "WARC-Record-ID", "Content-Type"} <= f.keys()
        head, _, payload = b.partition(b"\r\n\r\n")
        assert head.startswith(b"HTTP/1.1 200 OK\r\n")
        if f["WARC-Type"] == "revisit":
            to, block = ids[f["WARC-Refers-To"]]
            assert payload == b"" and to["WARC-Type"] == "response" and to["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
            assert to.get("WARC-Target-URI") == f.get("WARC-Refers-To-Target-URI")
        else:
            assert f["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()


@pytest.mark.parametrize("same_row", [True, False])
def test_hot_payload(spark, tmp_path, same_row):
    rows = [(5 if same_row else k, "u", BIG) for k in range(1500)] + [(k, "v", f"{k} " * 500) for k in range(2000, 2100)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    assert result(warc.resolve_revisits(warc.read_records(spark, path, payload=False))) == brute(rows)


def test_without_rows(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(pages.limit(0), path)
    assert warc.resolve_revisits(warc.read_records(spark, path)).collect() == []


@given(st.lists(st.tuples(st.sampled_from(["response", "revisit", "metadata"]), st.binary(max_size=40) | st.sampled_from([b"\r\n\r\n", b"\n", b"WARC/1.1\r\n"])), max_size=6), st.integers(0, 30))
@settings(max_examples=100, deadline=None)
def test_lines(records, cut):
    data = b"".join(b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (t.encode(), len(b), b) for t, b in records)
    lines = warc.Lines()
    got = [x for x in map(lines.feed, data[:-1].split(b"\n") if data else []) if x]
    assert [(f["warc-type"], b) for f, b in got] == records
    lines = warc.Lines()  # a cut file gives what is whole, and no more
    got = [x for x in map(lines.feed, data[: max(0, len(data) - 5 - cut)].removesuffix(b"\n").split(b"\n")) if x]
    assert [b for _, b in got] == [b for _, b in records][: len(got)]


def test_revisit_of_what_is_not_there(spark, tmp_path):
    (tmp_path / "a").mkdir()
    with gzip.open(tmp_path / "a" / "x.warc.gz", "wb") as f:
        f.write(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
        f.write(b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <a>\r\nWARC-Refers-To: <b>\r\nWARC-Payload-Digest: sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    rows = warc.read_records(spark, str(tmp_path / "a"))
    assert [(r["record_type"], r["declared_digest"]) for r in rows.collect()] == [("revisit", hashlib.sha1(b"").hexdigest())]
    assert [tuple(r) for r in warc.resolve_revisits(rows).collect()] == [(None, "revisit", None, None, None)]


def test_query(spark, data, duck):
    rows = warc.op13_warc_revisits(spark, data)
    want = duck.execute(warc.OP13_SQL).fetchall()
    assert rows.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(tuple(r) for r in rows.collect()) == sorted(want)
