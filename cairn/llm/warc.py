"""Web archives in ZIP packages: WARC records are written to stored members and read back by ranges, without extraction."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, fresh_folder, table, text_or_empty, written

#: Payloads from this length on are stored once.
REVISIT_BYTES = 100
#: A package is closed when its records have so many bytes.
PACKAGE_BYTES = 32 << 20
#: Neighbouring records are read together up to so many bytes.
RANGE_BYTES = 4 << 20
#: An archive member of a package is closed when it has so many bytes.
MEMBER_BYTES = 8 << 20
#: Up to so many repeated payloads (some 100 bytes each) their digests are broadcast; beyond, rows are shuffled to them.
BROADCAST_ROWS = 100_000
DATE = "2020-01-01T00:00:00Z"
DATA, INDEX = "archive/data-{:03d}.warc.gz", "indexes/index.cdx.gz"


# ---- reading a ZIP package by ranges


def _extra64(extra: bytes, fields: list[int]) -> list[int]:
    """Central directory fields (size, compressed size, offset), those of all ones replaced by the ZIP64 extra field's."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            rest = extra[at + 4 : at + 4 + n]
            for k, v in enumerate(fields):
                if v == 0xFFFFFFFF:
                    (fields[k],), rest = struct.unpack_from("<Q", rest), rest[8:]
            break
        at += 4 + n
    return fields


def members(handle, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (method, offset of the entry's local header, stored bytes), from the central directory, ZIP64 or not."""
    tail_at = max(0, size - 65_557)
    tail = _range(handle, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or 0xFFFFFFFF in (length, at):
        locator = _range(handle, tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        (end64,) = struct.unpack_from("<Q", locator, 8)
        record = _range(handle, end64, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, at = struct.unpack_from("<QQQ", record, 32)
    directory, found, p = _range(handle, at, length), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is broken")
        method = struct.unpack_from("<H", directory, p + 10)[0]
        compressed, plain, n, e, c = struct.unpack_from("<IIHHH", directory, p + 20)
        (offset,) = struct.unpack_from("<I", directory, p + 42)
        plain, compressed, offset = _extra64(directory[p + 46 + n : p + 46 + n + e], [plain, compressed, offset])
        found[directory[p + 46 : p + 46 + n].decode("utf-8", "replace")] = (method, offset, compressed)
        p += 46 + n + e + c
    return found


def _range(handle, at: int, n: int) -> bytes:
    handle.seek(at)
    data = handle.read(n)
    if len(data) != n:
        raise ValueError("the package ends early")
    return data


def data_offset(handle, member: tuple[int, int, int]) -> int:
    """Where a stored member's bytes begin."""
    method, at, _ = member
    if method != zipfile.ZIP_STORED:
        raise ValueError("the member is compressed; records can't be read by range")
    head = _range(handle, at, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    n, e = struct.unpack_from("<HH", head, 26)
    return at + 30 + n + e


def content(handle, member: tuple[int, int, int]) -> bytes:
    """A whole member, for indexes only: stored or deflated."""
    method, at, size = member
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompress(_range(handle, data_offset(handle, (zipfile.ZIP_STORED, at, size)), size), -15)
    return _range(handle, data_offset(handle, member), size)


def located(lines) -> list[tuple[str, int, int]]:
    """(file name, offset, length) of each line of an index: CDXJ, whose lines end in a JSON object, or CDX, whose first line names its fields.

    Lines of CDXJ without an offset (headers) are passed over; without a legend, CDX has the usual eleven fields.
    """
    out, legend = [], "N b a m s k r M S V g".split()
    for line in lines:
        if line.lstrip().startswith("CDX "):
            legend = line.split()[1:]
        elif "{" in line:
            entry = json.loads(line[line.index("{") :])
            if "offset" in entry:
                out.append((entry["filename"], int(entry["offset"]), int(entry["length"])))
        elif line.strip():
            entry = dict(zip(legend, line.split()))
            out.append((entry["g"], int(entry["V"]), int(entry["S"])))
    return out


def index_entries(handle, found: dict) -> list[tuple[str, int, int]]:
    """(archive member, offset, length) of all records, each once, by member and offset, from all indexes of a package, gzipped or not."""
    entries = set()
    for name, member in found.items():
        if re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", name):
            data = content(handle, member)
            entries.update(located((gzip.decompress(data) if name.endswith(".gz") else data).decode().splitlines()))
    out = []
    for name, offset, length in entries:
        path = name if name in found else f"archive/{name.rpartition('/')[2]}"
        if path not in found:
            raise ValueError(f"the index names {name}, which the package lacks")
        out.append((path, offset, length))
    bare = {n for n, (_, _, size) in found.items() if n.startswith("archive/") and size} - {n for n, _, _ in out}
    if bare:
        raise ValueError(f"no index lists the records of {min(bare)}")
    return sorted(out)


def records(handle, size: int):
    """(headers, block) of each record of a package; neighbouring records of a member share a range read of bounded size."""
    found = members(handle, size)
    group: list[tuple[str, int, int]] = []
    for entry in [*index_entries(handle, found), None]:
        if group and (entry is None or entry[0] != group[0][0] or entry[1] + entry[2] - group[0][1] > RANGE_BYTES):
            name, first, _ = group[0]
            data = _range(handle, data_offset(handle, found[name]) + first, max(o + n for _, o, n in group) - first)
            for _, o, n in group:
                record = data[o - first : o - first + n]
                yield parse(zlib.decompress(record, 31) if record[:2] == b"\x1f\x8b" else record)
            group = []
        if entry is not None:
            group.append(entry)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


# ---- writing


def record_id(page_id, digest: str) -> str:
    """The name of a page's response, so that revisits can state it; pages without an id get a new one each."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'urn:x-page:{page_id}:{digest}')}>"


def target_uri(page_id, url) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:x-page:{'none' if page_id is None else page_id}"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member: a response with its payload, or a revisit that names the response and keeps length and digest."""
    name = f"urn:x-page:{'none' if page_id is None else page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target_uri(page_id, url)}", f"X-Page-ID: <{name}>", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: <urn:x-page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def sort_key(uri: str) -> str:
    """The index key of a URI: its host's labels from the last to the first, then the rest."""
    scheme, mark, rest = uri.partition("://")
    if not mark:
        return uri
    host, path = re.match(r"([^/?#]*)(.*)", rest, re.S).groups()
    return ",".join(reversed(host.lower().split("."))) + ")" + (path or "/")


def package(parts: list[tuple[str, str, bytes]]) -> bytes:
    """A ZIP with the records of (URI, digest, record) in stored archive members, and their gzipped CDXJ index and a list of its files beside them."""
    held, lines = [[]], []
    at = 0
    for uri, digest, data in parts:
        if at and at + len(data) > MEMBER_BYTES:
            held.append([])
            at = 0
        entry = {"url": uri, "mime": "text/html", "status": "200", "digest": f"sha256:{digest}", "length": str(len(data)), "offset": str(at), "filename": DATA.format(len(held) - 1).rpartition("/")[2]}
        lines.append(f"{sort_key(uri)} {re.sub('[^0-9]', '', DATE)} {json.dumps(entry)}")
        held[-1].append(data)
        at += len(data)
    files = {DATA.format(k): b"".join(m) for k, m in enumerate(held)}
    files[INDEX] = gzip.compress("\n".join(sorted(lines)).encode(), 1, mtime=0)
    resources = [{"name": n.rpartition("/")[2], "path": n, "hash": "sha256:" + hashlib.sha256(d).hexdigest(), "bytes": len(d)} for n, d in files.items()]
    files["datapackage.json"] = json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": resources}).encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for n, d in files.items():
            z.writestr(zipfile.ZipInfo(n), d)
    return out.getvalue()


def with_first(pages: DataFrame) -> DataFrame:
    """pages(id, url, html) with digest and refers_to: of equal payloads of REVISIT_BYTES or more, the least id (null for it itself).

    Only digests and ids meet in the sum. The table of digests that occur more than once is written and counted, then joined back:
    broadcast up to BROADCAST_ROWS, so that html stays where it is; else by a shuffle whose hot digests Spark splits.
    """
    keyed = pages.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    large = keyed.where(F.octet_length("html") >= REVISIT_BYTES)
    again = written(large.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select("digest", "first"), "repeats")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    other = F.coalesce(F.col("id") != F.col("first"), F.col("first").isNotNull()) & (F.octet_length("html") >= REVISIT_BYTES)
    return keyed.join(again, "digest", "left").select("id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One record per row in packages in folder; returns their paths. Files of attempts that Spark didn't count are not listed.

    Null html is empty. Of rows with the least id of a payload all are responses, should that id repeat; rows with a null id
    come after all others. No rows give no packages. Other columns are not read. A payload of any length is one record; packages end
    at records, and records are read back by range.
    """

    def run(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        part, parts, held = TaskContext.get().partitionId(), [], 0

        def flush():
            path = f"{base}/pages-{part:06d}-{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(path) as out:
                out.write(package(parts))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(parts)])], names=["path", "records"])

        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist()):
                record = record_bytes(row["id"], row["url"], row["html"].encode("utf-8", "surrogatepass"), row["digest"], row["refers_to"])
                parts.append((target_uri(row["id"], row["url"]), row["digest"], record))
                held += len(record)
                if held >= PACKAGE_BYTES:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()

    kept = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    return written(with_first(kept).mapInArrow(run, "path string, records long"), "packages")


def read_packages(files: DataFrame, folder: str, partitions: int) -> DataFrame:
    """A row per response or revisit: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for revisits).

    A response whose payload has not the length or SHA-256 it states raises an error. Packages of other writers may lack the
    page's number (null), the length and the digest (both of the payload; null for revisits), and may hold records of other
    types, which are passed over. Archive members must be stored and listed in an index; indexes may be compressed.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()])))

    def number(urn: str | None):
        text = (urn or "none").strip("<>").rpartition(":")[2]
        return None if text == "none" else int(text)

    def run(batches):
        fs, _ = file_system(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as handle:
                    out, held = [], 0
                    for head, block in records(handle, handle.size()):
                        if head["warc-type"] not in ("response", "revisit"):
                            continue
                        kind, _, digest = head.get("warc-payload-digest", "").partition(":")
                        digest = digest if kind == "sha256" else None
                        n = int(head["x-payload-length"]) if "x-payload-length" in head else None
                        payload = block.partition(b"\r\n\r\n")[2] if head["warc-type"] == "response" else None
                        if payload is not None:
                            size, own = len(payload), hashlib.sha256(payload).hexdigest()
                            if n not in (None, size) or digest not in (None, own):
                                raise ValueError(f"a record of {path} is broken")
                            n, digest = size, own
                        out.append((number(head.get("x-page-id")), n, digest, head["warc-type"], number(head.get("x-refers-to-page")), head.get("warc-target-uri"), payload))
                        held += len(payload or b"")
                        if held > 8 << 20 or len(out) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                            out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return files.select("path").repartition(partitions).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def op9_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "wacz")
    files = write_packages(table(spark, sf_dir, "pages"), folder)
    return read_packages(files, folder, max(1, files.count())).drop("url", "payload")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM p),
     f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest HAVING count(*) > 1)
SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN n >= 100 AND first IS NOT NULL AND d.page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first IS NOT NULL AND d.page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f USING (digest)
"""
