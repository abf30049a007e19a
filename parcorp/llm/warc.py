"""WARC archives: a writer with revisit records and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcorp.llm.common import written

# Fixed values of the format
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

MIN_REVISIT = 1000  # shorter payloads are always stored
MAX_RECORD = 1 << 30  # a record or member that claims more fails the checks
DATE = "1970-01-01T00:00:00Z"
URN = "urn:x-page:"
FLUSH = 8 << 20  # bytes of payload per batch that a task hands on

READ_SCHEMA = (
    "path string, offset bigint, length bigint, status string, reason string, type string, "
    "record_id string, uri string, refers_to string, payload_digest string, "
    "payload_length bigint, payload binary"
)


# ---- writing ------------------------------------------------------------------------------
def planned(pages: DataFrame, row_id: str = "page_id", uri: str = "url", payload: str = "html",
            min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(id, uri, payload, digest, n, keep) for every row: what its record will hold.

    Of the rows with equal payloads of at least `min_revisit` bytes the one with the
    largest id is stored (keep = id), the others refer to it; shorter ones are all stored.
    Null payloads count as empty. A null id never is the largest unless all are null.
    Winners are combined before the shuffle, and the pages of a payload held by a third of
    all rows are dealt over many tasks by the skew join.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(row_id).alias("id"), F.col(uri).alias("uri"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("bigint"))
    several = rows.where(F.col("n") >= min_revisit).groupBy("digest").agg(
        F.max("id").alias("k"), F.count("*").alias("c")).where("c > 1")
    several = written(several.select(F.col("digest").alias("d"), "k"), "warc-winners")
    joined = rows.join(several, F.col("digest") == F.col("d"), "left")
    return joined.select("id", "uri", "payload", "digest", "n",
                         F.when(F.col("d").isNotNull(), F.col("k")).otherwise(F.col("id")).alias("keep"))


def _clean(value) -> str:
    """A header value: anything that could end the line is percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record(page_id, uri, payload: bytes, digest: str, n: int, keep, date: str = DATE) -> bytes:
    """One record: a response with its payload, or a revisit of record `keep`."""
    here = "null" if page_id is None else page_id
    head = [
        f"WARC-Record-ID: <{URN}{here}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(uri) if uri else f'{URN}{here}'}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {n}", "Content-Type: application/http; msgtype=response",
    ]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if page_id == keep:
        head.insert(0, "WARC-Type: response")
        block = f"{http}Content-Length: {n}\r\n\r\n".encode() + payload
    else:
        head.insert(0, "WARC-Type: revisit")
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{URN}{keep}>"]
        block = f"{http}\r\n".encode()
    lines = "\r\n".join([*head, f"Content-Length: {len(block)}"])
    return VERSION + b"\r\n" + lines.encode() + END + block + END


def write(records: DataFrame, path: str, compress: bool = True, date: str = DATE) -> None:
    """Write the rows of `planned` as archives below `path`, one per task.

    Spark's text sink carries the bytes, so that any file system and a rerun after a lost
    executor work as for every table. It ends each row with a separator: compressed, each
    record is a gzip member of its own and the separator an empty member; otherwise it is
    the end mark of a record.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for r in range(batch.num_rows):
                row = [batch.column(i)[r].as_py() for i in range(batch.num_columns)]
                data = record(*row, date)
                out.append(gzip.compress(data, 6, mtime=0) if compress else data[: -len(END)])
                size += len(out[-1])
                if size >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["data"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["data"])

    blocks = records.select("id", "uri", "payload", "digest", "n", "keep").mapInArrow(build, "data binary")
    ending = gzip.compress(b"", mtime=0) if compress else END
    (blocks.select(F.col("data").cast("string").alias("value")).write
     .option("lineSep", ending.decode("latin-1")).option("encoding", "ISO-8859-1").text(path))


# ---- reading ------------------------------------------------------------------------------
def _digest_ok(value: str, data: bytes) -> bool:
    name, _, want = value.partition(":")
    if name.lower() not in ("sha1", "sha256", "md5"):
        return True  # cannot be checked
    have = hashlib.new(name.lower(), data)
    return want.lower() in (have.hexdigest(), base64.b32encode(have.digest()).decode().lower().rstrip("="),
                            base64.b32encode(have.digest()).decode().lower())


def _find_end(data, at: int) -> int:
    """Where the next blank line stands, or -1: in growing pieces, wherever it is."""
    size = 1 << 14
    while at < len(data):
        found = bytes(data[at:at + size + len(END) - 1]).find(END)
        if found >= 0:
            return at + found
        at, size = at + size, size * 2
    return -1


def parse(data, at: int) -> tuple[dict, int] | str:
    """The record that starts at `at` and where it ends, or which check failed."""
    if bytes(data[at:at + 7]) != b"WARC/1.":
        return "no version line"
    head_end = _find_end(data, at)
    if head_end < 0:
        return "header does not end"
    lines = bytes(data[at:head_end]).decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            return "header line without a name"
        fields[key.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,15}", size) or "warc-type" not in fields:
        return "no length or type"
    start = head_end + len(END)
    stop = start + int(size)
    if int(size) > MAX_RECORD or stop + len(END) > len(data):
        return "record is cut off"
    if bytes(data[stop:stop + len(END)]) != END:
        return "no end mark"
    block = data[start:stop]
    if "warc-block-digest" in fields and not _digest_ok(fields["warc-block-digest"], block):
        return "block digest differs"
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        cut = _find_end(block, 0)
        if cut < 0:
            return "HTTP header does not end"
        payload = block[cut + len(END):]
    kind = fields["warc-type"].lower()
    if kind != "revisit" and "warc-payload-digest" in fields and not _digest_ok(
            fields["warc-payload-digest"], payload):
        return "payload digest differs"
    return {"fields": fields, "type": kind, "payload": payload}, stop + len(END)


def inflate(data, at: int) -> tuple[bytes, int] | str:
    """The gzip member that starts at `at` and where it ends, or which check failed."""
    step = zlib.decompressobj(31)
    parts, size, pos = [], 0, at
    try:
        while not step.eof:
            if pos >= len(data):
                return "member is cut off"
            chunk = data[pos:pos + (1 << 20)]
            parts.append(step.decompress(chunk, MAX_RECORD - size + 1))
            size += len(parts[-1])
            if size > MAX_RECORD or step.unconsumed_tail:
                return "member is too long"
            pos += len(chunk)
    except zlib.error as e:
        return f"member is damaged: {str(e)[:80]}"
    return b"".join(parts), pos - len(step.unused_data)


def salvage(data) -> Iterator[tuple[int, int, dict | str]]:
    """(offset, length, record or reason) in file order; a reason marks a quarantined gap.

    After a failed check the search goes on, byte by byte, for the next gzip member or
    version line from which a whole record passes all checks; everything in between is one
    gap. Members may hold several records; a gap inside a sound member is reported with the
    member's place. Empty members are skipped.
    """
    whole = data if isinstance(data, bytes) else memoryview(data)
    finder = re.compile(rb"\x1f\x8b\x08|WARC/1\.")

    def unit(at: int):
        """What starts here: (items, end) or a reason."""
        if bytes(whole[at:at + 3]) == b"\x1f\x8b\x08":
            got = inflate(whole, at)
            if isinstance(got, str):
                return got
            text, end = got
            if not text:
                return [], end
            inner = [x for _, _, x in salvage(memoryview(text))]
            return (inner, end) if any(isinstance(x, dict) for x in inner) else "no record in member"
        got = parse(whole, at)
        return got if isinstance(got, str) else ([got[0]], got[1])

    at, gap, reason = 0, None, ""
    while at < len(whole):
        got = unit(at)
        if isinstance(got, str):
            if gap is None:
                gap, reason = at, got
            found = finder.search(whole, at + 1)
            at = found.start() if found else len(whole)
            continue
        if gap is not None:
            yield gap, at - gap, reason
            gap = None
        items, end = got
        for item in items:
            yield at, end - at, item
        at = end
    if gap is not None:
        yield gap, len(whole) - gap, reason


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records (status 'record') and quarantined byte ranges (status 'gap', with a reason)
    of all archives below `path`, compressed or not, in READ_SCHEMA.

    `payload_length` and, where a payload is stored, `payload_digest` are taken from the
    payload itself; of revisits they are the header's. Without `payload` the payloads are
    checked but not returned. A file is read as a whole by one task, so archives should
    stay well below Spark's 2 GB limit of a binary value; the writer's do.
    """
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 7, pa.int64(), pa.binary()]

    def packed(rows: list) -> pa.RecordBatch:
        cols = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    def one(name: str, offset: int, length: int, item) -> tuple:
        if isinstance(item, str):
            return (name, offset, length, "gap", item, *[None] * 7)
        f = item["fields"]
        if item["type"] == "revisit":
            digest, _, n = f.get("warc-payload-digest", "").partition(":")[2], 0, f.get("x-payload-length")
            n, body = (int(n) if n and n.isdigit() else None), None
            digest = base64.b32decode(digest).hex() if len(digest) == 32 else digest.lower() or None
        else:
            digest, n, body = hashlib.sha1(item["payload"]).hexdigest(), len(item["payload"]), item["payload"]
        return (name, offset, length, "record", None, item["type"], f.get("warc-record-id"),
                f.get("warc-target-uri"), f.get("warc-refers-to"), digest, n,
                bytes(body) if payload and body is not None else None)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                for offset, length, item in salvage(batch.column(1)[i].as_buffer()):
                    rows.append(one(name, offset, length, item))
                    size += 500 + len(rows[-1][-1] or b"")
                    if size >= FLUSH:
                        yield packed(rows)
                        rows, size = [], 0
            yield packed(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path)
    return files.select("path", "content").mapInArrow(scan, READ_SCHEMA)


def page_of(column: str):
    """The id in a record reference of this writer; null where there is none."""
    return F.regexp_extract(F.col(column), f"<{URN}(-?[0-9]+)>", 1).try_cast("bigint")
