"""WARC records in ZIP-packaged archives: writing, and reading by range without extraction.

An archive is a ZIP file whose members are stored, not deflated: pairs of a
``.warc.gz`` segment (a warcinfo record, then each page's, every one a gzip
member of its own) and its index in CDXJ, a line for each page's record with
its key, time and place. The reader parses the end record, its
ZIP64 form where needed and the central directory, finds segments and indexes
by name, and reads runs of records by their ranges.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Equal payloads of at least so many bytes are stored once.
LEAST_REVISIT = 100
SEGMENT_BYTES = 16 << 20
#: Records that are read at once, and bytes of them.
RUN_RECORDS, RUN_BYTES = 512, 8 << 20

MADE = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
RUNS = pa.schema([("path", pa.string()), ("start", pa.int64()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


#: What pages that carry no time are dated.
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str, more: str = "") -> str:
    """A record's name; of a response it follows from page and payload, so revisits know it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{more}')}>"


def _lines(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE, more: str = "") -> bytes:
    """A WARC/1.1 record: a response with ``payload`` in an HTTP message, or a revisit of another page's without it."""
    kind = "response" if refers_to is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest, more)), ("WARC-Date", date)]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", _quoted(url)))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _lines(fields) + block + b"\r\n\r\n"


def _quoted(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)


def info(name: str, date: str = DATE) -> bytes:
    """The warcinfo record that a segment begins with."""
    block = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
    return _lines([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def url_key(url: str | None) -> str:
    """An index's key of a URL: the host's parts from the last to the first, then the path, in lower case."""
    m = re.match(r"(?i)[a-z][a-z0-9+.-]*://([^/?#:]*)(?::\d+)?([^#]*)", url or "")
    key = f"{','.join(reversed(m[1].split('.')))}){m[2] or '/'}" if m else url or "-"
    return _quoted(key.lower())


def parsed(data: bytes) -> tuple:
    """A record's fields as in RECORDS; a response's length and digest are those of the payload that it holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    f = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    page = int(f["x-page-id"]) if "x-page-id" in f else None
    block = rest[: int(f["content-length"])]
    url = f.get("warc-target-uri")
    url = url and re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)
    said = f["warc-payload-digest"].removeprefix("sha256:")
    if f["warc-type"] != "response":
        return page, url, f["warc-type"], int(f["x-payload-length"]), said, int(f["x-refers-to-page"]), None
    payload = block.partition(b"\r\n\r\n")[2]
    digest = hashlib.sha256(payload).hexdigest()
    if digest != said:
        raise ValueError(f"the payload of {f['warc-record-id']} doesn't match its digest")
    return page, url, "response", len(payload), digest, None, payload


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header_at: int


def members(f: pa.NativeFile) -> list[Member]:
    """The central directory of the ZIP file ``f``, also of ZIP64."""
    size = f.size()
    tail_at = max(0, size - (1 << 16) - 22)
    tail = f.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no ZIP directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = f.read_at(20, tail_at + at - 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        end64 = f.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if end64[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    data, at, out = f.read_at(length, start), 0, []
    for _ in range(count):
        if data[at : at + 4] != b"PK\1\2":
            raise ValueError("a broken ZIP directory")
        method = struct.unpack_from("<H", data, at + 10)[0]
        packed, whole, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode()
        x, end = at + 46 + n_name, at + 46 + n_name + n_extra
        while x + 4 <= end:
            tag, n = struct.unpack_from("<HH", data, x)
            if tag == 1:  # ZIP64: only what doesn't fit above, in this order
                y = x + 4
                if whole == 0xFFFFFFFF:
                    whole, y = struct.unpack_from("<Q", data, y)[0], y + 8
                if packed == 0xFFFFFFFF:
                    packed, y = struct.unpack_from("<Q", data, y)[0], y + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", data, y)[0]
            x += 4 + n
        out.append(Member(name, method, packed, header))
        at = end + n_note
    return out


def data_at(f: pa.NativeFile, m: Member) -> int:
    """Where a stored member's bytes begin."""
    if m.method:
        raise ValueError(f"{m.name} isn't stored but packed by method {m.method}")
    head = f.read_at(30, m.header_at)
    if head[:4] != b"PK\3\4":
        raise ValueError(f"no header of {m.name}")
    return m.header_at + 30 + sum(struct.unpack_from("<HH", head, 26))


class _Out(io.RawIOBase):
    """A stream for zipfile that can't be sought in, as those of object stores."""

    def __init__(self, stream: pa.NativeFile):
        self.stream, self.at = stream, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass


def _write(batches: common.Batches, root: str, segment_bytes: int, date: str) -> common.Batches:
    from pyspark import TaskContext

    store, top = pafs.FileSystem.from_uri(root)
    store.create_dir(top, recursive=True)
    archive, records, segment, index, segments, seen = None, 0, bytearray(), [], 0, set()
    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.zip"  # another attempt writes another file

    def squeezed(data: bytes) -> bytes:
        squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
        return squeeze.compress(data) + squeeze.flush()

    def close_segment() -> None:
        nonlocal segments
        archive.writestr(f"archive/segment-{segments:05d}.warc.gz", bytes(segment))
        lines = sorted(f"{key} {re.sub('[^0-9]', '', date)} {json.dumps(x)}\n" for key, x in index)
        archive.writestr(f"indexes/segment-{segments:05d}.cdxj", "".join(lines))
        segment.clear()
        index.clear()
        segments += 1

    for batch in batches:
        for page_id, url, html, digest, refers_to in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
            if archive is None:
                stream = store.open_output_stream(f"{top}/{name}")
                archive = zipfile.ZipFile(_Out(stream), "w", zipfile.ZIP_STORED)
            part = f"segment-{segments:05d}.warc.gz"
            if not segment:
                segment += squeezed(info(f"{name}/{part}", date))
            # of rows that have all in common only the first has the plain name
            more = "" if refers_to is None and page_id is not None and (page_id, digest) not in seen else f"{name}:{records}"
            seen.add((page_id, digest))
            data = squeezed(record(page_id, url, (html or "").encode(), digest, refers_to, date, more))
            at = {"url": url, "mime": "text/html", "status": "200", "digest": f"sha256:{digest}", "offset": str(len(segment)), "length": str(len(data)), "filename": part}
            index.append((url_key(url), at))
            segment += data
            records += 1
            if len(segment) >= segment_bytes:
                close_segment()
                seen.clear()
    if archive is not None:
        if index:
            close_segment()
        archive.close()
        size = archive.fp.at if archive.fp else store.get_file_info(f"{top}/{name}").size
        stream.close()
        yield common.batch_of(MADE, [[f"{root}/{name}"], [size], [records]])


def write_archives(pages: DataFrame, root: str, segment_bytes: int = SEGMENT_BYTES, salts: int = 16, date: str = DATE) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); returns a row for each archive: path, bytes, records.

    Of equal payloads of 100 bytes or more, that of the smallest page_id is a
    response, and those of larger ones revisit it; rows that share the smallest
    page_id, and null page_ids, are responses. A null html is an empty payload.
    Other columns are ignored; pages have no time, so all records have ``date``.
    An empty table gives no archive.
    """
    spark = pages.sparkSession
    html = F.coalesce(common.with_column(pages, "html", "string").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), common.with_column(pages, "url", "string").cast("string").alias("url"), html.alias("html"))
    digests = common.materialize(rows.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest")), root, "digests")
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # equal payloads may be a third of all rows: each digest is dealt to several tasks
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    again = digests.withColumn("salt", F.pmod("page_id", F.lit(salts)).cast("int")).join(firsts, ["digest", "salt"]).where("page_id > refers_to")
    again = common.materialize(again.select("page_id", "digest", "refers_to").distinct(), root, "revisits")
    full = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).join(again, ["page_id", "digest"], "left")
    made = full.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(lambda b: _write(b, f"{root}/archives", segment_bytes, date), "path string, bytes long, records long")
    return common.materialize(made, root, "made")


def _runs(batches: common.Batches) -> common.Batches:
    for batch in batches:
        for path in batch["path"].to_pylist():
            store, inner = pafs.FileSystem.from_uri(path)
            with store.open_input_file(inner) as f:
                rows = list(_runs_of(f, path))
            yield common.batch_of(RUNS, list(zip(*rows)) or [[]] * 4)


def _runs_of(f: pa.NativeFile, path: str) -> Iterator[tuple]:
    found = {m.name: m for m in members(f)}
    for name, m in found.items():
        if not name.endswith(".warc.gz"):
            continue
        start, index = data_at(f, m), found[name.replace("archive/", "indexes/").removesuffix(".warc.gz") + ".cdxj"]
        lines = f.read_at(index.size, data_at(f, index)).decode().splitlines()
        places = sorted((int(x["offset"]), int(x["length"])) for x in (json.loads(line.split(" ", 2)[2]) for line in lines))
        i = 0
        while i < len(places):
            j = i + 1
            while j < len(places) and j - i < RUN_RECORDS and places[j][0] + places[j][1] - places[i][0] <= RUN_BYTES:
                j += 1
            yield path, start + places[i][0], [o - places[i][0] for o, _ in places[i:j]], [n for _, n in places[i:j]]
            i = j


def _read(batches: common.Batches, payloads: bool) -> common.Batches:
    for batch in batches:
        for path, start, offsets, lengths in zip(*(batch[c].to_pylist() for c in RUNS.names)):
            store, inner = pafs.FileSystem.from_uri(path)
            with store.open_input_file(inner) as f:
                data = f.read_at(offsets[-1] + lengths[-1], start)
            rows = [parsed(zlib.decompress(data[o : o + n], 31)) for o, n in zip(offsets, lengths)]
            yield common.batch_of(RECORDS, [*zip(*(r[:-1] for r in rows)), [r[-1] if payloads else None for r in rows]])


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of ``archives`` (path); without ``payloads`` only what they are.

    Indexes are read first, and runs of records are dealt anew, so a large
    archive is read by many tasks.
    """
    runs = archives.select("path").mapInArrow(_runs, "path string, start long, offsets array<long>, lengths array<long>")
    # a run is a row of a few bytes here but up to RUN_BYTES to read, so the number of tasks follows the archives' size
    total = archives.agg(F.sum("bytes")).first()[0] if "bytes" in archives.columns else None
    tasks = [max(1, min(100_000, -(-total // (4 * RUN_BYTES))))] if total else []
    return runs.repartition(*tasks, "path", "start").mapInArrow(lambda b: _read(b, payloads), "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page's record; nulls, ties and repeats as in ``write_archives``."""
    made = write_archives(common.table(spark, sf_dir, "pages"), common.shared_dir(spark))
    return read_archives(made, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
