import base64
import gzip
import hashlib
import io
import json
import zipfile

import pytest

from cairn.llm import warc
from cairn.llm.common import fresh_folder


def test_round_trip(spark):
    long = "<p>" + "é" * 60 + "</p>"
    rows = [(3, "http://a/1", long), (1, "http://b/ x\n", long), (2, None, long), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "n", long), (8, "big", "y" * 300_000), (1, "again", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as first", "3 as id", "4 as n").repartition(3)
    folder = fresh_folder(spark, "t")
    got = warc.read_packages(warc.write_packages(df, folder), folder, 2).collect()

    def plain(i, html):
        p = (html or "").encode()
        first = min((a for a, _, h in rows if (h or "") == (html or "") and a is not None), default=None)
        revisit = len(p) >= 100 and i != first and first is not None
        return str(i), len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", str(first if revisit else None)

    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(plain(i, h) for i, _, h in rows)
    assert {r.payload.decode() for r in got if r.record_type == "response"} == {long, "", "short", "y" * 300_000}
    empty = fresh_folder(spark, "t")
    assert warc.read_packages(warc.write_packages(df.limit(0), empty), empty, 1).count() == 0


@pytest.mark.parametrize("big", [False, True])
def test_directories_with_and_without_zip64(big, monkeypatch):
    if big:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = warc.package([("http://x", "d", warc.record_bytes(1, "http://x", b"abc", "d", None)), ("urn:x-page:2", "d", warc.record_bytes(2, None, b"abc", "d", 1))])
    found = warc.members(io.BytesIO(data), len(data))
    assert set(found) == {warc.DATA.format(0), warc.INDEX, "datapackage.json"}
    (head, block), (head2, _) = list(warc.records(io.BytesIO(data), len(data)))
    assert head["warc-type"] == "response" and block.endswith(b"\r\n\r\nabc") and head2["x-refers-to-page"] == "<urn:x-page:1>" and head2["warc-refers-to"] == head["warc-record-id"]
    if big:
        assert b"PK\x06\x06" in data


def test_broken_packages():
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"nothing"), 7)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.DATA.format(0), b"x" * 100)
    with pytest.raises(ValueError):
        warc.data_offset(out, warc.members(out, len(out.getvalue()))[warc.DATA.format(0)])
    with pytest.raises(ValueError):
        warc.index_entries(out, warc.members(out, len(out.getvalue())))


def _plain(kind, uri, block, **more):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *([f"WARC-Target-URI: {uri}"] if uri else []), *(f"{k.replace('_', '-')}: {v}" for k, v in more.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("index", ["cdx", "cdxj", "cdxj.gz", "deflated"])
def test_packages_of_other_writers(spark, index):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    sha1 = base64.b32encode(hashlib.sha1(b"one").digest()).decode()
    first = [_plain("warcinfo", None, b"software: x"), _plain("response", "http://a.test/", http + b"one", WARC_Payload_Digest=f"sha1:{sha1}")]
    second = [gzip.compress(_plain("request", "http://b.test/", b"GET /")), gzip.compress(_plain("response", "http://b.test/", http + b"two")), gzip.compress(_plain("revisit", "http://c.test/", http))]
    lines, json_lines = [" CDX N b a m s k r M S V g"], ['!meta {"format": "cdxj"}']
    for name, parts in (("x.warc", first), ("y.warc.gz", second)):
        at = 0
        for part in parts:
            lines.append(f"k 2020 u m 200 d - - {len(part)} {at} {name}")
            json_lines.append("k 2020 " + json.dumps({"offset": at, "length": len(part), "filename": name}))
            at += len(part)
    text = "\n".join(lines if index == "cdx" else json_lines).encode()
    folder = fresh_folder(spark, "t")
    import pathlib

    path = pathlib.Path(folder.removeprefix("file://").removeprefix("file:")) / "other.wacz"
    path.parent.mkdir(parents=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/y.warc.gz", b"".join(second))
        z.writestr("archive/x.warc", b"".join(first))
        z.writestr("indexes/index." + ("cdxj" if index == "deflated" else index), gzip.compress(text) if index.endswith("gz") else text, zipfile.ZIP_DEFLATED if index == "deflated" else None)
        z.writestr("pages/pages.jsonl", "{}")
    rows = warc.read_packages(spark.createDataFrame([(str(path),)], "path string"), folder, 1).collect()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert [(r.url, r.record_type, r.page_id, r.payload_bytes, r.payload_digest) for r in rows] == [("http://a.test/", "response", None, 3, digest(b"one")), ("http://b.test/", "response", None, 3, digest(b"two")), ("http://c.test/", "revisit", None, None, None)]


def test_several_archive_members_and_the_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 300)
    parts = [(f"http://h.test/{i}", "d", warc.record_bytes(i, f"http://h.test/{i}", b"p" * 10, "d", None)) for i in range(5)]
    data = warc.package(parts)
    found = warc.members(io.BytesIO(data), len(data))
    assert sum(n.startswith("archive/") for n in found) == 5
    assert [h["warc-target-uri"] for h, _ in warc.records(io.BytesIO(data), len(data))] == [p[0] for p in parts]
    assert warc.sort_key("http://A.b.test/x?y") == "test,b,a)/x?y" and warc.sort_key("urn:x") == "urn:x" and warc.sort_key("http://h") == "h)/"
    rows = spark.createDataFrame([(i, "u", "z" * 200 if i % 2 else f"{i}" * 150) for i in range(40)], "id long, url string, html string")
    few = sorted((r.id, r.refers_to or 0) for r in warc.with_first(rows).collect())
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert few == sorted((r.id, r.refers_to or 0) for r in warc.with_first(rows).collect()) and sum(f for _, f in few) == 19
