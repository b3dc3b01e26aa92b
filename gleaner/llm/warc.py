"""WARC archives: writing pages as segmented, chunked records, and reassembling segments when reading.

Writing. A page becomes a response record whose block is an HTTP/1.1 head and its payload in chunked transfer framing. A
block longer than SEGMENT bytes is cut: the first part stays in the response record with WARC-Segment-Number 1, the others
follow as continuation records with WARC-Segment-Origin-ID, the last with WARC-Segment-Total-Length. Of pages with equal
payloads of at least REVISIT_BYTES, the one of the largest page_id is the response; the others are revisit records,
which have the HTTP head alone. Archives are plain concatenated records, written through Spark's text sink to the shared
folder and compressed whole by it, so any file system will do.

Reading. Files (plain, or compressed in one member or one for each record) are split into records by Content-Length.
Continuation records are grouped by the origin's identifier and put in order of their segment numbers; the sum of their
lengths must be the total that the last one states, and no number may be missing. The block's chunked framing is then decoded
and the payload's digest compared with the record's. Whatever of a page's record fails is reported in the column fault, never
dropped: a record that can't be told from its neighbours, or a file that breaks off, as a row of its own that names file and byte.

Segments move between tasks compressed, and each record's own segments only: no group is larger than one record.

Defined results: a null html is an empty payload; repeated rows get a record each, and those equal in page_id to the
response are responses too; a null page_id is smaller than any, and a revisit never refers to it unless all copies lack
one; an empty table gives no rows; other columns are not read, url may be missing or null.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import shared_dir, sliced

VERSION = "WARC/1.1"
SEGMENT = 2048
PIECE = 1000
REVISIT_BYTES = 0
FILE_RECORDS = 4000
#: Kinds of records that pages come from; others, and files of other kinds, are passed over.
KINDS = ("response", "revisit", "continuation")
_END = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, piece: int = PIECE) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [payload[i : i + piece] for i in range(0, len(payload), piece)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; chunk extensions and trailers are passed over."""
    at, out = 0, []
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is longer or shorter than it says")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return f"{VERSION}\r\n{head}\r\n".encode() + block + _END


def records(page_id, url: str | None, payload: bytes, response_id, is_response: bool, segment: int = SEGMENT) -> list[bytes]:
    """The record of a page and its continuations."""
    own = uuid.uuid4().urn
    target = (url or "").replace("\r", " ").replace("\n", " ") or f"urn:page:{page_id}"
    named = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if page_id is not None:
        named.append(("WARC-Page-ID", page_id))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if not is_response:
        if response_id is not None:
            named.append(("WARC-Refers-To-Page-ID", response_id))
        named += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{own}>"), *named], head + b"Content-Length: %d\r\n\r\n" % len(payload))]
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{own}>"), *named]
    if len(parts) == 1:
        return [record(first, block)]
    out = [record([*first, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target)]
        more += [("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", f"<{own}>")]
        out.append(record([*more, ("WARC-Segment-Total-Length", len(block))] if n == len(parts) else more, part))
    return out


def record_at(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record that begins at a byte, and where it ends; ValueError if there is none or it is broken."""
    end = data.find(_END, at)
    if not data.startswith(b"WARC/", at) or end < 0:
        raise ValueError(f"no record at byte {at}")
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    if not headers.get("content-length", "").isdecimal():
        raise ValueError(f"the record at byte {at} has no length")
    begin, size = end + 4, int(headers["content-length"])
    if data[begin + size : begin + size + 4] != _END:
        raise ValueError(f"the record at byte {at} is longer or shorter than it says")
    return headers, data[begin : begin + size], begin + size + 4


def parsed(data: bytes):
    """(headers, block) of each record of a sound archive."""
    at = 0
    while at < len(data):
        headers, block, at = record_at(data, at)
        yield headers, block


def salvaged(data: bytes):
    """(byte, headers, block, fault) of each record of any archive; after a fault it goes on at the next line that begins a record."""
    at = 0
    while at < len(data):
        try:
            headers, block, after = record_at(data, at)
            yield at, headers, block, None
        except ValueError as e:
            yield at, {}, b"", str(e)
            after = data.find(b"\nWARC/", at) + 1 or len(data)
        at = after


def unpacked(data: bytes) -> tuple[bytes, str | None]:
    """A file's bytes, whether it is compressed (in one member, or one for each record) or not, and what was wrong with it."""
    if data[:2] != b"\x1f\x8b":
        return data, None
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error as e:
            return b"".join(out), f"compressed data: {e}"
        if not member.eof:
            return b"".join(out), "compressed data: cut off"
        data = member.unused_data
    return b"".join(out), None


def number(text: str | None) -> int | None:
    return int(text) if text is not None and text.removeprefix("-").isdecimal() and len(text) < 19 else None


def write(pages: DataFrame, path: str | None = None) -> str:
    """Writes all pages as archives and returns their folder."""
    path = path or shared_dir(pages.sparkSession)
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("payload"), F.sha1(html).alias("sha1"))
    # the payload's key alone is grouped; the pages meet the outcome, whose skew Spark can split
    first = rows.groupBy("sha1").agg(F.max("page_id").alias("response_id"))

    def squeeze(batches):
        for batch in sliced(batches):
            small = [zlib.compress(p.as_py(), 1) for p in batch.column(2)]
            yield batch.set_column(2, "payload", pa.array(small, pa.binary()))

    packed = rows.mapInArrow(squeeze, rows.schema)

    def lay(batches):
        for batch in sliced(batches):
            out = []
            for i, u, z, r in zip(*(batch.column(n).to_pylist() for n in range(4)), strict=True):
                payload = zlib.decompress(z)
                is_response = len(payload) < REVISIT_BYTES or i == r
                out += records(i, u, payload, r, is_response)
            # the sink ends each row with the line break that ends the record
            yield pa.RecordBatch.from_arrays([pa.array([x[:-2] for x in out], pa.binary())], ["value"])

    told = packed.join(first, "sha1").select("page_id", "url", "payload", "response_id").mapInArrow(lay, "value binary")
    sink = told.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip")
    sink.option("maxRecordsPerFile", FILE_RECORDS).text(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, target_uri, record_type, refers_to, payload_bytes, payload_digest and fault of each page, or fault, in the archives."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,txt.gz,warc,warc.gz}").load(path).select("content", "path")

    def take(batches):
        for batch in batches:
            for content, name in zip(*batch.columns[:2], strict=True):
                file, rows = name.as_py().rsplit("/", 1)[-1], []
                data, torn = unpacked(content.as_py())
                broken = lambda at, fault: {"origin": f"{name}#{at}", "fault": f"{file}: {fault}", "block": b""}  # noqa: E731, B023
                for at, h, block, fault in salvaged(data):
                    kind = h.get("warc-type")
                    own = h.get("warc-segment-origin-id") if kind == "continuation" else h.get("warc-record-id")
                    segment = number(h.get("warc-segment-number", "0"))
                    if fault or kind in KINDS and (own is None or segment is None):
                        rows.append(broken(at, fault or f"the record at byte {at} lacks its identifier or number"))
                    elif kind in KINDS:
                        rows.append({
                            "origin": own, "segment": segment, "total": number(h.get("warc-segment-total-length")), "type": kind, "target_uri": h.get("warc-target-uri"),
                            "page_id": number(h.get("warc-page-id")), "refers_to": number(h.get("warc-refers-to-page-id")), "stated": h.get("warc-payload-digest", "").removeprefix("sha1:"), "block": zlib.compress(block, 1),
                        })
                if torn:
                    rows.append(broken(len(data), torn))
                for i in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 2000], schema=parts)

    parts = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("stated", pa.string()), ("block", pa.binary()), ("fault", pa.string())])
    spec = "origin string, segment int, total long, type string, target_uri string, page_id long, refers_to long, stated string, block binary, fault string"
    segments = files.mapInArrow(take, spec)
    whole = segments.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"), F.max("fault").alias("fault"),
        *[F.max(F.when(F.col("type") != "continuation", F.col(c))).alias(c) for c in ("type", "target_uri", "page_id", "refers_to", "stated")],
    )
    out = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, fault string"

    def join(frames):
        for pdf in frames:
            rows = [(None, None, f) if f is not None else reassembled(*r) for f, *r in zip(pdf["fault"], pdf["parts"], pdf["total"], pdf["type"], pdf["stated"], strict=True)]
            got = pd.DataFrame(rows, columns=["payload_bytes", "payload_digest", "fault"], index=pdf.index)
            got = got.astype({"payload_bytes": "Int64"})
            ids = pdf[["page_id", "refers_to"]].astype("Int64")
            yield pd.DataFrame({"page_id": ids["page_id"], "target_uri": pdf["target_uri"], "record_type": pdf["type"], "refers_to": ids["refers_to"]}).join(got)

    return whole.mapInPandas(join, out)


def reassembled(parts, total, kind: str | None, stated: str | None) -> tuple[int | None, str | None, str | None]:
    """(bytes, digest, fault) of the payload of a record from its segments, which are in order of their numbers."""
    numbers = [p["segment"] for p in parts]
    block = b"".join(zlib.decompress(p["block"]) for p in parts)
    if kind is None:
        return None, None, "the record that began it is missing"
    if numbers not in ([0], list(range(1, len(parts) + 1))):
        return None, None, f"segments {numbers}"
    if numbers != [0] and (total is None or pd.isna(total) or int(total) != len(block)):
        return None, None, f"{len(block)} bytes, {total} stated"
    head, _, body = block.partition(_END)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    if kind == "revisit":
        return number(fields.get("content-length")), stated, None
    try:
        payload = dechunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body
    except ValueError as e:
        return None, None, f"chunks: {e}"
    own = digest(payload)
    return len(payload), own, None if not stated or own == stated else f"digest {own}, {stated} stated"


def report(pages: DataFrame) -> DataFrame:
    """The digest of the query, from archives written and read back."""
    got = read(pages.sparkSession, write(pages))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "fault")
