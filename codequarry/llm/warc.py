"""Legacy ARC archives converted to WARC, written as gzip members and read back.

An ARC file starts with a ``filedesc://`` record whose block names the version
and the fields of every later header line:

    1: URL IP-address Archive-date Content-type Archive-length
    2: URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

The length, always last, says how many bytes of block follow the line. The
converter reads records by these lengths, never by searching for the next
header, and synthesises what WARC asks for: a record id (a version 5 UUID of
source and digests, so a repeated attempt names it alike), the date in ISO
8601, the type, and payload and block digests. Each WARC file starts with a
warcinfo record in place of the archives' version blocks. Repeated rows give
records of the same id, being one record twice.

Records with equal payloads of at least ``least`` bytes: the one with the
greatest key stays a response, the others become revisits that keep the HTTP
header and refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.shared import shared_dir, stored

#: Fields of a header line by version of the format.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "code", "checksum", "location", "offset", "filename", "length"),
}
#: Bytes after which a task starts its next archive file.
FILE_BYTES = 64_000_000
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


# ---- ARC ----------------------------------------------------------------


def arc_of(url: Column, payload: Column, version: int, date: str = "20240101000000") -> Column:
    """One ARC file (binary) of a version block and one HTTP record with ``payload`` (binary)."""
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    block = f"{version} 0 codequarry\n{names}\n"
    rest = "" if version == 1 else " 200 - - 0 pages.arc"
    first = "" if version == 1 else " 200 - - 0 pages.arc"
    head = f"filedesc://pages.arc 0.0.0.0 {date} text/plain{first} {len(block)}\n{block}\n"
    http = F.concat(F.lit("HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\s\p{Cntrl}]", "%20")
    line = F.concat(F.when(clean == "", "urn:x-none").otherwise(clean), F.lit(f" 0.0.0.0 {date} text/html{rest} "), (F.octet_length(payload) + F.octet_length(http)).cast("string"), F.lit("\n"))
    return F.concat(F.encode(F.concat(F.lit(head), line, http), "utf-8"), payload, F.encode(F.lit("\n"), "utf-8"))


def arc_records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(fields, block) of each record after the version block; a line that doesn't fit the version raises ValueError."""
    view, at, fields = memoryview(data), 0, None
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("a header line without end")
        parts = data[at:end].rstrip(b"\r").decode("utf-8", "replace").split(" ")
        length = int(parts[-1])
        block = bytes(view[end + 1 : end + 1 + length])
        if len(block) != length:
            raise ValueError("a record is shorter than its header line says")
        at = end + 1 + length
        if fields is None:
            fields = FIELDS[int(block.split(b" ", 1)[0])]
        else:
            if len(parts) != len(fields):
                raise ValueError("a header line that does not fit the version")
            yield dict(zip(fields, parts)), block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its empty line, and payload; no header where the block is not HTTP."""
    if block.startswith(b"HTTP/"):
        end = block.find(b"\r\n\r\n")
        if end >= 0:
            return block[: end + 4], block[end + 4 :]
    return b"", block


# ---- WARC ---------------------------------------------------------------


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def _iso(date: str) -> str:
    d = (date + "00000101000000"[len(date) :])[:14] if len(date) < 14 else date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_member(key: str, fields: dict, block: bytes, refers: str | None) -> bytes:
    """One WARC record as a gzip member; ``key`` and ``refers`` go in as extension headers."""
    http, payload = split_http(block)
    digest = _digest(payload)
    kind = "resource" if not http else "response" if refers is None else "revisit"
    body = http if kind == "revisit" else block
    lines = [
        "WARC/1.0",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_id(key, digest, kind)}",
        f"WARC-Date: {_iso(fields['date'])}",
        f"WARC-Target-URI: {fields['url']}",
        f"WARC-IP-Address: {fields['ip']}",
        f"WARC-Payload-Digest: {digest}",
        f"WARC-Block-Digest: {_digest(body)}",
        f"Content-Type: {'application/http; msgtype=response' if http else fields['mime']}",
        f"Content-Length: {len(body)}",
        f"X-Source-Key: {key}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_id(refers, digest, 'response')}", f"X-Refers-To-Key: {refers}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def warcinfo(name: str) -> bytes:
    """The first record of a WARC file, as a gzip member."""
    body = b"software: codequarry\r\nformat: WARC File Format 1.0\r\ndescription: converted from ARC\r\n"
    lines = ["WARC/1.0", "WARC-Type: warcinfo", f"WARC-Record-ID: {_id(name, 'warcinfo')}", f"WARC-Date: {datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def warc_records(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of a file of gzip members, one member in memory at a time."""
    rest = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            rest = rest or stream.read(1 << 20)
            if not rest:
                if parts:
                    raise ValueError("a member is cut off")
                return
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data if unpack.eof else b""
        data = b"".join(parts)
        head, _, body = data.partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield headers, body[: int(headers["Content-Length"])]


def _filesystem(at: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", at))


def written(records: DataFrame, at: str) -> DataFrame:
    """(key, content: ARC bytes, refers) -> manifest (path, records, bytes) of the WARC files under ``at``.

    Every attempt of a task writes files of its own names, so the files of a lost
    or repeated attempt are never in the manifest.
    """

    def run(batches):
        store, root = _filesystem(at)
        store.create_dir(root, recursive=True)
        out, path, count, size, done = None, "", 0, 0, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, count, size))
                out = None

        for batch in batches:
            for key, content, refers in zip(*(batch.column(i) for i in range(3))):
                for fields, block in arc_records(content.as_py()):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        path, count, size = f"{root}/{name}", 0, 0
                        out = store.open_output_stream(path, compression=None)
                        out.write(warcinfo(name))
                    member = warc_member(key.as_py() or "", fields, block, refers.as_py())
                    out.write(member)
                    count, size = count + 1, size + len(member)
                    if size >= FILE_BYTES:
                        close()
        close()
        yield pa.RecordBatch.from_pydict({"path": [x[0] for x in done], "records": pa.array([x[1] for x in done], pa.int64()), "bytes": pa.array([x[2] for x in done], pa.int64())}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return records.select("key", "content", "refers").mapInArrow(run, "path string, records bigint, bytes bigint")


def read_back(spark: SparkSession, manifest: DataFrame, at: str) -> DataFrame:
    """Records of the archives in the manifest: key, record_type, payload_bytes, payload_digest (hex), refers, url, date."""

    def run(batches):
        store, _ = _filesystem(at)
        names = ("key", "record_type", "payload_bytes", "payload_digest", "refers", "url", "date")
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    for h, block in warc_records(stream):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        size = int(h["X-Payload-Length"])
                        if h["WARC-Type"] != "revisit":
                            payload = split_http(block)[1]
                            if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"{path}: a payload does not fit its digest")
                        rows.append((h["X-Source-Key"], h["WARC-Type"], size, digest, h.get("X-Refers-To-Key"), h["WARC-Target-URI"], h["WARC-Date"]))
                yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int64() if i == 2 else pa.string()) for i, n in enumerate(names)})

    files = manifest.select("path").repartition(max(1, manifest.count()))
    return files.mapInArrow(run, "key string, record_type string, payload_bytes bigint, payload_digest string, refers string, url string, date string")


def inventory(arcs: DataFrame) -> DataFrame:
    """(key, content) -> (key, fp, digest, bytes): what the archives hold, without payloads."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, content, fp in zip(*(batch.column(i) for i in range(3))):
                for _, block in arc_records(content.as_py()):
                    payload = split_http(block)[1]
                    rows.append((key.as_py(), fp.as_py(), hashlib.sha1(payload).digest(), len(payload)))
            yield pa.RecordBatch.from_pydict({"key": pa.array([r[0] for r in rows], pa.int64()), "fp": pa.array([r[1] for r in rows], pa.int64()), "digest": pa.array([r[2] for r in rows], pa.binary()), "bytes": pa.array([r[3] for r in rows], pa.int64())})

    return arcs.select(F.col("key").cast("bigint"), "content", F.xxhash64("content").alias("fp")).mapInArrow(run, "key bigint, fp bigint, digest binary, bytes bigint")


def convert(arcs: DataFrame, least: int = 1000) -> DataFrame:
    """ARC files (key bigint, content binary) converted, written as WARC and read back; one row per record.

    A key may be null (its record is never the response that others refer to,
    unless all of a payload's keys are null) and may repeat: records of the
    response's own key with the same payload are responses too. An empty table
    gives no archive and no row. A corrupt ARC file fails the job.
    """
    spark = arcs.sparkSession
    seen = inventory(arcs).where(F.col("bytes") >= least)
    groups = seen.select("digest", "key", "fp").distinct()
    groups = stored(groups)
    chief = stored(groups.groupBy("digest").agg(F.max("key").alias("chief"), F.count("*").alias("n")).where("n > 1 and chief is not null"))  # stored, so that the join may split a payload of many pages
    again = groups.join(chief, "digest").where("key is null or key <> chief").select(F.col("key").alias("k"), F.col("fp").alias("f"), F.col("chief").cast("string").alias("refers"))
    rows = arcs.select(F.col("key").cast("bigint").alias("n"), "content", F.xxhash64("content").alias("fp"))
    rows = rows.join(again, rows.n.eqNullSafe(again.k) & (rows.fp == again.f), "left").select(F.col("n").cast("string").alias("key"), "content", "refers")
    at = shared_dir(spark)
    manifest = stored(written(rows, at))
    out = read_back(spark, manifest, at)
    key = F.when(F.col("key") != "", F.col("key")).cast("bigint")
    return out.select(key.alias("key"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast("bigint").alias("refers_to"), "url", "date")


def pages_as_arc(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as one small ARC file a row, of version 1 or 2 by turns; null html is an empty payload."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    both = F.when(F.coalesce(F.pmod("page_id", F.lit(2)), F.lit(0)) == 0, arc_of(F.col("url"), payload, 1)).otherwise(arc_of(F.col("url"), payload, 2))
    return pages.select(F.col("page_id").alias("key"), both.alias("content"))


#: DuckDB SQL for op1_warc.
SQL = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
d as (select page_id, octet_length(b)::bigint payload_bytes, sha1(b) payload_digest from p),
c as (select *, max(page_id) over (partition by payload_digest) m from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id < m then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 1000 and page_id < m then m end refers_to from c
"""
