"""WARC archives: segmented and chunked records, written and read back whole.

Pages become response records whose block is an HTTP message with chunked transfer framing; a
block over the segment size goes on in continuation records.  Pages with the payload of an earlier one become
revisit records.  Reading groups continuations by the record that they go on from,
orders them by number, verifies the total length and decodes the framing.

Archives are written by Spark's text sink (one record a line, the line end being that of a
record) and read as whole files, so any file system that Spark knows holds them, and
the commit protocol copes with tasks that are run again.  An archive has at most ``RECORDS`` records of at most a segment
and its headers, so that a reader holds one archive in memory.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scope, scratch_path, stored

SEGMENT = 32 << 10
CHUNK = 8 << 10
RECORDS = 8192
#: Bytes of payloads in a batch that a reader gives back.
PACK = 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
_END = b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for i in range(0, len(payload), size) if (p := payload[i : i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a framed body; None if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            n = int(body[at:line].split(b";")[0], 16)  # a chunk may have extensions
        except ValueError:
            return None
        at = line + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def _record(kind: str, name: str, block: bytes, **headers: str | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def page_records(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, serial: str, segment: int = SEGMENT) -> list[bytes]:
    """The records of a page, without the line ends after each."""
    payload = (html or "").encode()
    name = f"{URN}{'' if page_id is None else page_id}:{serial}"
    uri = None if url is None else "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    common = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{payload_digest(payload)}"}
    if refers_to is not None:
        return [_record("revisit", name, b"", **common, WARC_Profile=PROFILE, WARC_Refers_To=f"<{URN}{refers_to}>")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    common["Content_Type"] = "application/http;msgtype=response"
    if len(block) <= segment:
        return [_record("response", name, block, **common)]
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [_record("response", name, pieces[0], **common, WARC_Segment_Number="1")]
    for i, piece in enumerate(pieces[1:], 2):
        total = str(len(block)) if i == len(pieces) else None
        out.append(_record("continuation", f"{name}:{i}", piece, WARC_Segment_Number=str(i), WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Total_Length=total))
    return out


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def _records(page_id: pa.Array, url: pa.Array, html: pa.Array, refers_to: pa.Array, serial: pa.Array) -> pa.Array:
    rows = zip(page_id, url, html, refers_to, serial, strict=True)
    return pa.array([page_records(*(x.as_py() for x in r)) for r in rows], pa.list_(pa.binary()))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``page_id, url, html`` as gzipped WARC files.

    Of pages with equal payloads the one with the smallest id is the response.  A null html is an
    empty payload.  Pages without an id, if no equal page has one, and rows that repeat the
    smallest id are all responses.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    light = rows.select("page_id", "digest")
    first = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    revisits = (
        light.join(first, "digest").where("first is not null and not (page_id <=> first)")
        .select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), F.col("first").alias("refers_to")).distinct()
    )
    marked = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["_p"]) & (rows["digest"] == revisits["_d"]), "left")
    # rows that repeat a page have one name
    serial = F.substring("digest", 1, 16)
    records = marked.select(F.explode(_records("page_id", "url", "html", "refers_to", serial)).alias("record"))
    lines = records.select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


_PARSED = pa.schema(
    [("name", pa.string()), ("kind", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("bytes", pa.int64()), ("sha1", pa.string()), ("intact", pa.bool_())]
)
_PARSED_SQL = "name string, kind string, refers_to string, digest string, origin string, number int, total long, block binary, bytes long, sha1 string, intact boolean"


def parse_archive(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of one archive, as rows of the parsed schema; raises ValueError where it is damaged."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"{head.get('warc-record-id')} is cut off")
        bare = lambda k: head[k].strip("<>") if k in head else None
        yield {
            "name": bare("warc-record-id"), "kind": head["warc-type"], "refers_to": bare("warc-refers-to"), "digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "whole": "warc-segment-number" not in head, "origin": bare("warc-segment-origin-id"), "number": int(head.get("warc-segment-number", 1)), "total": int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None, "block": block,
        }


def _parse(with_payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Without ``with_payload`` responses in one segment are decoded here, and give ``bytes, sha1, intact`` for their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                raw = io.BytesIO(content.as_buffer())
                rows, held = [], 0
                for r in parse_archive(gzip.GzipFile(fileobj=raw) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw):
                    if r["whole"] and r["kind"] == "response" and not with_payload:
                        (done,) = assembled(Counter({(r["name"], r["kind"], r["refers_to"], r["digest"], r["block"]): 1}), {}, None, False)
                        r |= {"block": b"", "bytes": done["bytes"], "sha1": done["sha1"], "intact": done["intact"]}
                    rows.append(r)
                    held += len(r["block"]) + 500
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _PARSED)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, _PARSED)

    return run


def decode_block(block: bytes) -> bytes | None:
    """The payload of an HTTP message, out of its framing if it is chunked."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_READ = pa.schema(
    [("name", pa.string()), ("kind", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload", pa.binary()), ("bytes", pa.int64()), ("sha1", pa.string()), ("intact", pa.bool_())]
)
_READ_SQL = "name string, kind string, refers_to string, digest string, payload binary, bytes long, sha1 string, intact boolean"


def assembled(firsts: Counter, parts: dict[int, bytes], total: int | None, with_payload: bool) -> Iterator[dict]:
    """A row for each of ``firsts``, which are counted records ``name, kind, refers_to, digest, block`` of one name; ``parts`` go on from them."""
    for (name, kind, refers_to, digest, block), times in firsts.items():
        row = {"name": name, "kind": kind, "refers_to": refers_to, "digest": digest, "payload": None, "bytes": None, "sha1": None, "intact": None}
        if kind == "response":
            data = block + b"".join(parts[n] for n in sorted(parts))
            gap = sorted(parts) != list(range(2, len(parts) + 2))
            payload = None if gap or (total is not None and total != len(data)) else decode_block(data)
            row["intact"] = False
            if payload is not None:
                sha1 = payload_digest(payload)
                row |= {"payload": payload if with_payload else None, "bytes": len(payload), "sha1": sha1, "intact": sha1 == digest}
        for _ in range(times):
            yield row


def _assemble(with_payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads records sorted by ``key`` and holds those of one key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, firsts, parts, total = None, Counter(), {}, None
        for b in batches:
            for r in b.to_pylist():
                if r["intact"] is not None:  # decoded when it was parsed
                    yield {k: r[k] for k in ("name", "kind", "refers_to", "digest", "bytes", "sha1", "intact")} | {"payload": None}
                    continue
                if r["key"] != key:
                    yield from assembled(firsts, parts, total, with_payload)
                    key, firsts, parts, total = r["key"], Counter(), {}, None
                if r["kind"] == "continuation":
                    parts[r["number"]] = r["block"]
                    total = r["total"] if r["total"] is not None else total
                else:
                    firsts[r["name"], r["kind"], r["refers_to"], r["digest"], r["block"]] += 1
        yield from assembled(firsts, parts, total, with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for r in rows(batches):
            held.append(r)
            size += len(r["payload"] or b"") + 500
            if size > PACK:
                yield pa.RecordBatch.from_pylist(held, _READ)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, _READ)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """``name, kind, refers_to, digest, payload, bytes, sha1, intact`` of each response and revisit.

    Files are read once; records meet by the name that they have or go on from, in order of their segment numbers.
    Payload, bytes and sha1 are null for revisits and for records whose segments, length or
    framing are broken; ``intact`` tells whether ``sha1`` is the declared digest.  A
    record that only has a first segment, and no total length, is read as it is.  Without ``with_payload`` payloads
    are decoded, but not given back, and responses without a segment number, which the format demands of a first segment, are decoded where
    they are read, so that their blocks are not shuffled.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    records = files.mapInArrow(_parse(with_payload), _PARSED_SQL).where("kind in ('response', 'revisit', 'continuation')")
    keyed = records.withColumn("key", F.when(F.col("kind") == "continuation", F.col("origin")).otherwise(F.col("name"))).drop("origin")
    return keyed.repartition("key").sortWithinPartitions("key", "number").mapInArrow(_assemble(with_payload), _READ_SQL)


def op3_warc(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each page, from archives that are written and read back.

    A revisit has the size and digest of the response that it refers to.  A null html is an empty payload; of repeated rows each
    is a record; pages of any length go in segments; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    page = lambda c: F.substring_index(F.substring(c, len(URN) + 1, 1 << 30), ":", 1).cast("string")
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    with scope(spark) as keep:
        path = scratch_path(spark, "warc")
        write_archives(pages, path)
        read = read_archives(spark, path, with_payload=False)
        rows = keep(stored(read.select(number(F.col("name")).alias("page_id"), "kind", number(F.col("refers_to")).alias("refers_to"), "digest", "bytes", "sha1"), "warc-read"))
    responses = rows.where("kind = 'response'")
    known = responses.where("page_id is not null").groupBy("page_id", "sha1").agg(F.max("bytes").alias("_b")).select(F.col("page_id").alias("_p"), F.col("sha1").alias("_s"), "_b")
    revisits = rows.where("kind = 'revisit'").join(known, (F.col("refers_to") == F.col("_p")) & (F.col("digest") == F.col("_s")), "left")
    out = responses.unionByName(revisits.select("page_id", "kind", "refers_to", "digest", F.col("_b").alias("bytes"), F.col("_s").alias("sha1")))
    return out.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, sha1(html) AS hex FROM p), f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
g AS (SELECT page_id, html, list_transform(range(8), lambda i: CAST('0x' || hex[i * 5 + 1 : i * 5 + 5] AS BIGINT)) AS v FROM d)
SELECT page_id, strlen(g.html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[j // 4 + 1] >> CAST(15 - j % 4 * 5 AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM g JOIN f ON g.html = f.html
"""
