"""WARC archives of pages: a writer with revisit records, and a reader that salvages damaged files.

Archives are files of gzip members, one for each record. The reader checks every record: the member inflates and its
check sums hold, a version line starts it, headers parse, the block has the length stated and the digest stated. When
a check fails it searches for the next place where a valid record starts (a gzip member, or a version line in plain
files), logs the bytes between as a quarantined gap, and goes on, so damage costs the records it touches only.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm._shared import freed, new_file, shared_dir, stage

VERSION = b"WARC/1.1"
MEMBER = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive after which the next is begun.
ARCHIVE_BYTES = 32 << 20
#: The least payload that a revisit record may stand for.
LEAST_REVISIT = 0
DATE = "2020-01-01T00:00:00Z"
#: Bytes within which a record's headers end, and that a member must inflate to before its first bytes are judged.
HEAD_BYTES, JUDGED = 1 << 20, 5


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class DamagedArchive(ValueError):
    """Bytes of an archive that just was written hold no valid record."""


def record_id(page: int | None, digest: str) -> str:
    """The same whenever a task runs again; a page without a key has none that others could name."""
    return f"<urn:uuid:{uuid.uuid4() if page is None else uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def record(kind: str, url: str, payload: bytes, digest: str, extra: list[tuple[str, str]], date: str = DATE, page: int | None = None) -> bytes:
    """One record. A revisit's block is the HTTP head alone; its digest is that of the payload left out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        ("WARC-Type", kind),
        ("WARC-Target-URI", url),
        ("WARC-Date", date),
        ("WARC-Record-ID", record_id(page, digest)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        *extra,
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {_line(v)}\r\n" for k, v in head).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def _line(value: str) -> str:
    """A header value on one line; what could break the line is percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; ValueError tells which check failed."""
    if not data.startswith(b"WARC/", at):
        raise ValueError("no version line")
    head = data.find(b"\r\n\r\n", at, at + HEAD_BYTES)
    if head < 0:
        raise ValueError("headers do not end")
    lines = data[at:head].decode("utf-8", "replace").split("\r\n")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header without a colon")
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise ValueError("no length")
    start, end = head + 4, head + 4 + int(size)
    if end > len(data) or data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("block does not end where it should")
    block = data[start:end]
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != digest_of(block):
        raise ValueError("block digest differs")
    return headers, block, end + 4


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def salvage(data: bytes):
    """Yields ("record", start, end, headers, block) and ("gap", start, end, reason, b"") over the whole file."""
    at, n, bad, reason = 0, len(data), None, ""
    view = memoryview(data)
    while at < n:
        try:
            if data.startswith(MEMBER, at):
                z, parts, fed = zlib.decompressobj(31), [], at
                while not z.eof:
                    if fed >= n:
                        raise ValueError("member does not end")
                    parts.append(z.decompress(view[fed : fed + (1 << 16)]))
                    fed = min(n, fed + (1 << 16))
                    if len(parts) == 1 and len(parts[0]) >= JUDGED and not parts[0].startswith(b"WARC/"):
                        raise ValueError("no version line")  # a false start is not inflated to its end
                end, whole = fed - len(z.unused_data), b"".join(parts)
                found, inner = [], 0
                while inner < len(whole):
                    headers, block, inner = parse_record(whole, inner)
                    found.append((headers, block))
                if not found:
                    raise ValueError("empty member")
            else:
                headers, block, end = parse_record(data, at)
                found = [(headers, block)]
        except (ValueError, zlib.error) as e:
            if bad is None:
                bad, reason = at, str(e)
            places = [p for p in (data.find(MEMBER, at + 1), data.find(b"WARC/", at + 1)) if p >= 0]
            at = min(places, default=n)
            continue
        if bad is not None:
            yield "gap", bad, at, reason, b""
            bad = None
        for headers, block in found:
            yield "record", at, end, headers, block
        at = end
    if bad is not None:
        yield "gap", bad, n, reason, b""


WRITTEN = "path string, records long, bytes long"


def archives(folder: str):
    """(page_id, url, html, digest, refers_to, its url) -> archive files, a row for each."""

    def run(batches):
        task = TaskContext.get()
        name, k, parts, size = f"pages-{(task.partitionId() if task else 0):06d}", 0, [], 0

        def flush():
            path = new_file(folder, f"{name}-{k:04d}", ".warc.gz", b"".join(parts))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(parts)], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for page, url, html, digest, first, first_url in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                payload, extra = (html or "").encode(), [] if page is None else [("X-Page-ID", str(page))]
                if first is not None:
                    extra += [("X-Refers-To-Page-ID", str(first)), ("X-Payload-Length", str(len(payload))), ("WARC-Profile", PROFILE)]
                    extra += [("WARC-Refers-To", record_id(first, digest)), ("WARC-Refers-To-Target-URI", first_url or ""), ("WARC-Refers-To-Date", DATE)]
                data = member(record("response" if first is None else "revisit", url or "", payload, digest, extra, page=page))
                parts.append(data)
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    k, parts, size = k + 1, [], 0
        if parts:
            yield flush()

    return run


READ = "kind string, path string, at long, until long, reason string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(batches):
    """(path, content) -> READ: a row for each record (its payload checked against its digest) and for each gap."""
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    number = lambda x: int(x) if x is not None and x.lstrip("-").isdigit() else None
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            for kind, at, until, head, block in salvage(data):
                if kind == "gap":
                    rows.append((kind, path, at, until, head, None, None, None, None, None, None))
                    continue
                stated = head.get("warc-payload-digest", "").removeprefix("sha1:")
                record_type, url, page = head.get("warc-type"), head.get("warc-target-uri"), number(head.get("x-page-id"))
                if record_type == "revisit":  # its payload is elsewhere
                    rows.append((kind, path, at, until, None, page, url, number(head.get("x-payload-length")), stated, record_type, number(head.get("x-refers-to-page-id"))))
                    continue
                payload = payload_of(head, block)
                real = digest_of(payload)
                if stated and stated != real:
                    rows.append(("gap", path, at, until, "payload digest differs", page, url, None, None, None, None))
                else:
                    rows.append((kind, path, at, until, None, page, url, len(payload), real, record_type, None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def write_warc(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Archive files under ``folder``; returns WRITTEN. Equal payloads are stored once, by their least key."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    payload = F.coalesce("html", F.lit(""))
    # a base32 digest is 160 bits in 5-bit letters: made from the hexadecimal one, so grouping stays in the JVM
    rows = rows.withColumn("sha", F.sha1(payload.cast("binary")))
    first = rows.filter("page_id is not null").groupBy("sha").agg(F.min("page_id").alias("first"), F.min_by("url", F.struct("page_id", "url")).alias("first_url"), F.count("*").alias("copies")).filter("copies > 1").select("sha", "first", "first_url")
    joined = rows.join(first, "sha", "left")
    revisit = (F.col("first") != F.col("page_id")) & (F.octet_length(payload) >= least)
    digest = _base32(F.col("sha"))
    return joined.select("page_id", "url", "html", digest.alias("digest"), F.when(revisit, F.col("first")).alias("refers_to"), "first_url").mapInArrow(freed(archives(folder)), WRITTEN)


def _base32(sha: Column) -> Column:
    """Hexadecimal SHA-1 -> its base32 letters: five hexadecimal digits make four."""
    letters, out = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), []
    for i in range(0, 40, 5):
        n = F.conv(F.substring(sha, i + 1, 5), 16, 10).cast("int")
        out += [letters.substr(F.shiftright(n, bits).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for bits in (15, 10, 5, 0)]
    return F.concat(*out)


def read_warc(spark, written: DataFrame, folder: str) -> DataFrame:
    """READ of the archives that ``written`` names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    named = written.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.join(named, "name").select("name", "content").mapInArrow(freed(read_archives), READ)


def warc_round_trip(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, a null url an empty one; a row with a null key is stored as a response of its
    own and never referred to. Rows that repeat a key: those with the least key's payload are responses, as none
    has a smaller key to refer to. An empty table gives no rows and no file. Other columns are ignored. Bytes that
    had to be quarantined while reading are an error (DamagedArchive), which names the first; ``read_warc`` lists all.
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    written = stage(write_warc(pages, f"{path}/archives", key=key, url=url, html=html, least=least), f"{path}/written")
    if written.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    read = stage(read_warc(spark, written, f"{path}/archives"), f"{path}/read")
    if gap := read.filter("kind = 'gap'").orderBy("path", "at").first():
        raise DamagedArchive(f"{gap['path']} from {gap['at']} to {gap['until']}: {gap['reason']}")
    return read.filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
