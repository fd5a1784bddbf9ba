"""WARC archives of pages: segmented, chunked, read back and reassembled.

Each page becomes one record. Among pages of equal payload the one with the
largest id is the response and the others are revisits, unless the payload is
smaller than a limit. A response's block (an HTTP head and the payload in chunked
framing) over the segment size is cut: the first segment is the response record,
the others are continuation records, which may lie in other archives.

The reader groups segments by the origin's record id, orders them by segment
number, checks numbers and total length, and decodes the framing. Null payloads
are empty. A null id is smaller than any; a repeated row is written as often as
it occurs, and of repeated rows with the largest id each is a response. An empty
table gives no archive and no rows. A very long payload is many segments, and one row
once it is put together. Other columns are ignored. What can't be read as a record
becomes a row of type `damaged` that says why, and reading goes on at the next record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, cut
from .common import batch_of

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
PART_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE = pa.schema([("archive", pa.string()), ("content", pa.binary())])
RECORD = pa.schema([("origin", pa.string()), ("record_type", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("problem", pa.string()), ("block", pa.binary())])
RECORD_DDL = "origin string, record_type string, segment int, total long, refers_to string, digest string, payload_bytes long, problem string, block binary"
_PAGE = re.compile(r"<urn:gleanwork:page:(-?\d+|null)(?:#[^>]*)?>")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    for at in range(0, len(payload), size):
        chunk = payload[at : at + size]
        out += [b"%x\r\n" % len(chunk), chunk, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def decode_chunked(body: bytes) -> bytes:
    """The payload; ValueError where the framing is broken. Extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line is cut off")
        digits = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", digits):
            raise ValueError("no chunk size where one should stand")
        size = int(digits, 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: str | None, copy: str, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of a page, the response or revisit first; refers_to: the response's id for a revisit."""
    name = "null" if page_id is None else page_id
    own = f"<urn:gleanwork:page:{name}#{copy}>"
    digest = f"sha1:{sha1_base32(payload)}"
    common = [("WARC-Date", DATE)] + ([("WARC-Target-URI", quote(url, safe="/:?#[]@!$&'()*+,;=%-._~"))] if url else [])
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:gleanwork:page:{refers_to}>"), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + encode_chunked(payload)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        return [record(head, block)]
    out = [record([*head, ("WARC-Segment-Number", "1")], block[:segment_bytes])]
    for number, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if at + segment_bytes >= len(block) else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}/{number}>"), *common, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(number)), *last], block[at : at + segment_bytes]))
    return out


def parse_archive(content: bytes):
    """(headers in lower case, block, problem) of each record; gzip members or plain records.

    problem: null, or why bytes are no record; one row for each stretch of such bytes,
    with its place in the archive as the header `at`.
    """
    at, broken = 0, False
    while 0 <= at < len(content):
        packed = content[at : at + 2] == b"\x1f\x8b"
        try:
            data, after = _member(content, at) if packed else (content, at)
            inner = 0 if packed else at
            while inner < len(data) and (packed or inner == at):
                headers, block, inner = _plain(data, inner)
                broken = False
                yield headers, block, None
            at = after if packed else inner
        except (ValueError, zlib.error) as e:
            if not broken:
                yield {"at": str(at)}, b"", str(e)
            broken = True
            starts = [x for x in (content.find(b"\x1f\x8b\x08", at + 1), content.find(b"WARC/1.", at + 1)) if x > 0]
            at = min(starts, default=-1)


def _member(content: bytes, at: int) -> tuple[bytes, int]:
    """One gzip member and where it ends, fed in pieces so that what follows isn't copied each time."""
    unpacker, out, step = zlib.decompressobj(31), [], 1 << 13
    while not unpacker.eof:
        if at >= len(content):
            raise ValueError("archive is cut off")
        piece = content[at : at + step]
        out.append(unpacker.decompress(piece))
        at += len(piece) - len(unpacker.unused_data)
    return b"".join(out), at


def _plain(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    end = data.find(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record where one should begin")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not re.fullmatch(r"\d{1,18}", headers.get("content-length", "")):
        raise ValueError("no Content-Length that is a number")
    size = int(headers["content-length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size:
        raise ValueError("record is cut off")
    return headers, block, end + 4 + size + 4


def decode_block(block: bytes) -> bytes | int:
    """The payload of an HTTP message; of one without body its Content-Length."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if b"chunked" in fields.get(b"transfer-encoding", b""):
        return decode_chunked(body)
    if not body and fields.get(b"content-length", b"0") != b"0":
        return int(fields[b"content-length"])
    return body


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = 0, segment_bytes: int = SEGMENT_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """(archive, content): parts of archives, a table in the shared folder, of `scratch` if one is given."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("sha"))
    groups = cut(rows.groupBy("sha").agg(F.max("id").alias("response_id")))  # cut, so that Spark can split the join of a hot payload
    own = F.col("id").eqNullSafe(F.col("response_id")) | (F.octet_length("payload") < min_payload)
    dealt = rows.join(groups, "sha").select("id", "url", "payload", F.when(~own, F.col("response_id").cast("string")).alias("refers_to"))

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        held: dict[str, list[bytes]] = {"main": [], "more": []}
        size, part = dict.fromkeys(held, 0), 0
        for batch in batches:
            for page_id, url, text, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, data in enumerate(page_records(page_id, url, text.encode(), refers_to, f"{task}.{n}", segment_bytes)):
                    where = "more" if k else "main"  # continuations lie in archives of their own
                    held[where].append(data)
                    size[where] += len(data)
                    if size[where] >= PART_BYTES:
                        yield batch_of(ARCHIVE, archive=[f"{where}-{task:06d}-{part:05d}.warc.gz"], content=[b"".join(held[where])])
                        held[where], size[where], part = [], 0, part + 1
                n += 1
        for where, data in held.items():
            if data:
                yield batch_of(ARCHIVE, archive=[f"{where}-{task:06d}-{part:05d}.warc.gz"], content=[b"".join(data)])

    scratch = scratch or Scratch(pages.sparkSession, "warc")
    return scratch.write(dealt.mapInArrow(run, "archive string, content binary"), "archives")


def _row(headers: dict[str, str], block: bytes, problem: str | None, archive: str) -> tuple | None:
    """A row of RECORD; None for types that carry no page."""
    kind, own = headers.get("warc-type"), headers.get("warc-segment-origin-id") or headers.get("warc-record-id")
    if not problem:
        if kind not in ("response", "revisit", "continuation"):
            return None
        numbers = [headers.get(k) for k in ("warc-segment-number", "warc-segment-total-length")]
        if not own:
            problem = "no record id"
        elif any(x is not None and not re.fullmatch(r"\d{1,9}" if i == 0 else r"\d{1,18}", x) for i, x in enumerate(numbers)):
            problem = "a segment header is no number"
    if problem:
        return own or f"{archive}@{headers.get('at', '')}", "damaged", 0, None, None, None, None, problem, b""
    number, total = (int(x) if x is not None else None for x in numbers)
    return own, kind, number or 0, total, headers.get("warc-refers-to"), headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None, block


def read_archives(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem, payload, record_id, refers_to_id of each page.

    problem: why a record's segments, length, framing or digest don't hold, else null.
    payload: null for a revisit. page_id and refers_to are null for records that
    write_archives() hasn't named; record_id and refers_to_id are as written. A record
    that is read twice, as in two copies of an archive, counts once.
    """

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                content = content.as_py() or b""
                archive = f"damaged:{hashlib.sha1(content).hexdigest()}"
                out, size = [], 0
                for headers, block, problem in parse_archive(content):
                    if row := _row(headers, block, problem, archive):
                        out.append(row)
                        size += len(block)
                    if size >= PART_BYTES:
                        yield batch_of(RECORD, **dict(zip(RECORD.names, zip(*out, strict=True), strict=True)))
                        out, size = [], 0
                if out:
                    yield batch_of(RECORD, **dict(zip(RECORD.names, zip(*out, strict=True), strict=True)))

    result = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("problem", pa.string()), ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_id", pa.string())])

    def rebuild(batches):
        for batch in batches:
            rows = [(*reassemble(origin, segments), origin, next((s["refers_to"] for s in segments if s["refers_to"]), None)) for origin, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            cols = zip(*rows, strict=True) if rows else [()] * len(result)
            yield batch_of(result, **dict(zip(result.names, map(list, cols), strict=True)))

    records = archives.select(content_col).mapInArrow(parse, RECORD_DDL)
    parts = F.collect_set(F.struct("segment", "record_type", "total", "refers_to", "digest", "problem", "block"))
    return records.groupBy("origin").agg(parts.alias("segments")).mapInArrow(rebuild, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string, payload binary, record_id string, refers_to_id string")


def reassemble(origin: str, segments: list[dict]) -> tuple:
    """(page_id, payload_bytes, digest, type, refers_to, problem, payload) of one record's segments."""
    segments = sorted(segments, key=lambda s: s["segment"])
    first, problem = segments[0], next((s["problem"] for s in segments if s.get("problem")), None)
    block = b"".join(s["block"] for s in segments)
    if problem:
        pass
    elif first["record_type"] == "continuation":
        problem = "the first segment is missing"
    elif (first["segment"] or len(segments) > 1) and [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
        problem = "segment numbers have gaps or repeat"
    elif first["segment"] and segments[-1]["total"] != len(block):
        problem = "total length differs"
    number = lambda x: None if not x or not (m := _PAGE.match(x)) or m[1] == "null" else int(m[1])
    size, payload, digest = None, None, first["digest"]
    if not problem:
        try:
            payload = decode_block(block)
        except ValueError as e:
            problem = str(e)
    if first["record_type"] == "revisit" and problem is None:
        size, payload = payload if isinstance(payload, int) else len(payload), None
    elif problem is None and isinstance(payload, int):
        problem, payload = "the body is missing", None
    elif problem is None:
        size, digest = len(payload), sha1_base32(payload)
        if first["digest"] and first["digest"] != digest:
            problem = "payload digest differs"
    return number(origin), size, digest, first["record_type"], number(first["refers_to"]), problem, payload


def save_archives(archives: DataFrame, folder: str) -> None:
    """The archives as .warc.gz files in a folder that all executors mount."""

    def save(rows):
        Path(folder).mkdir(parents=True, exist_ok=True)
        for row in rows:
            part = Path(folder, f".{row['archive']}.{TaskContext.get().taskAttemptId()}")
            part.write_bytes(row["content"])
            part.replace(Path(folder, row["archive"]))

    archives.foreachPartition(save)


def load_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of .warc or .warc.gz files, for read_archives()."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")
