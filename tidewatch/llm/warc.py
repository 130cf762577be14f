"""WARC archives with revisit records and a two-level capture index.

Archives hold one gzip member per record. The index sorts captures by a key that starts with
the reversed host, in compressed blocks of BLOCK_LINES lines. A shard of the index ends with the
sparse directory of its blocks (first key, place), and the list of shards has their key
ranges. A look-up goes from shard to block to record by binary search, then reads ranges.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import map_texts, stored
from .storage import create, new_file, open_random

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
FILE_BYTES, RANGE_BYTES, BLOCK_LINES = 1 << 30, 4 << 20, 1_000
CAPTURES = pa.schema([
    ("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ("digest", pa.string()), ("record_type", pa.string()),
])
CAPTURES_DDL = "key string, page_id long, file string, offset long, length long, digest string, record_type string"
RECORDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])
RECORDS_DDL = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
               "payload_bytes long, payload binary")


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: com,example,www)/a?b. Scheme, port, user and
    fragment don't count; what is no URL is its own key."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname or ""
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{query}"


def header_text(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return value if value.isprintable() else "".join(c if c.isprintable() else quote(c) for c in value)


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP header of the response it stands for, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_text(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}"]
    return "\r\n".join(lines).encode() + CRLF + CRLF + block + CRLF + CRLF


def parse(raw: bytes) -> tuple:
    """RECORDS of one record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    revisit = kind == "revisit"
    return (page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind,
            page_of(fields.get("WARC-Refers-To")), digest, None if revisit else len(payload), None if revisit else payload)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class ArchiveWriter:
    """Appends records as gzip members; starts another file at file_bytes."""

    def __init__(self, folder: str, file_bytes: int):
        self.folder, self.file_bytes, self.out, self.name = folder, file_bytes, None, ""

    def add(self, raw: bytes) -> tuple[str, int, int]:
        if self.out is None or self.out.tell() >= self.file_bytes:
            self.close()
            self.name = new_file(self.folder, "pages") + ".warc.gz"
            self.out = create(self.name)
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(raw) + packer.flush()
        at = self.out.tell()
        self.out.write(member)
        return self.name, at, len(member)

    def close(self) -> None:
        if self.out:
            self.out.close()


def with_revisits(pages: DataFrame, least_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload, sha1, refers_to and revisit. Equal payloads meet by digest and length."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.encode(F.col(html_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumns({"sha1": F.sha1("payload"), "n": F.length("payload")})
    first = rows.groupBy("sha1", "n").agg(F.min("page_id").alias("first"))
    revisit = (F.col("n") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    # equal pages share a digest: Spark splits the join's partition of a digest that many have
    return rows.join(first, ["sha1", "n"]).select(
        "page_id", "url", "payload", "sha1", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit")
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES,
                   id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per page; returns the stored captures: key, page_id, file, offset, length,
    digest, record_type.

    The payload is the html in UTF-8, empty for null. Of pages with equal payloads of at least
    least_bytes, those with the smallest page_id are responses (a repeated row is a response again),
    the others revisits of it. Rows without page_id are responses unless a page with an id has
    the payload. A null url is left out of the record. No rows write no files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, file_bytes)
        for b in batches:
            out = []
            for page_id, url, payload, sha1, first, revisit in zip(*(c.to_pylist() for c in b.columns)):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                place = writer.add(record(page_id, url, payload, digest, first, revisit))
                out.append((url_key(url), page_id, *place, digest, "revisit" if revisit else "response"))
            yield rows_of(CAPTURES, out)
        writer.close()

    return stored(map_texts(with_revisits(pages, least_bytes, id_col, url_col, html_col), run, CAPTURES_DDL), "captures")


def write_index(captures: DataFrame, folder: str, shards: int | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sorts captures into index shards; returns the stored list of shards: file, first_key,
    last_key, blocks, lines, size. The number of shards is given, not the number of captures."""
    spark = captures.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "page_id", "file", "offset"]
    dealt = captures.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    schema = pa.schema([("file", pa.string()), ("first_key", pa.string()), ("last_key", pa.string()),
                        ("blocks", pa.int64()), ("lines", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, directory, lines, last, total = "", None, [], [], "", 0

        def flush() -> None:
            body = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode())
            directory.append((lines[0][0], out.tell(), len(body)))
            out.write(body)
            lines.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name = new_file(folder, "index")
                    out = create(name)
                lines.append(row)
                last, total = row[0], total + 1
                if len(lines) >= block_lines:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        tail = zlib.compress(json.dumps(directory, ensure_ascii=False).encode())
        size = out.tell() + len(tail) + 8
        out.write(tail + len(tail).to_bytes(8, "little"))
        out.close()
        yield rows_of(schema, [(name, directory[0][0], last, len(directory), total, size)])

    return stored(dealt.mapInArrow(run, "file string, first_key string, last_key string, blocks long, lines long, size long"), "index-shards")


class Shard:
    """One shard of the index: its block directory in memory, blocks read as asked for."""

    def __init__(self, name: str, size: int):
        self.f = open_random(name)
        n = int.from_bytes(self.f.read_at(8, size - 8), "little")
        self.directory = [tuple(x) for x in json.loads(zlib.decompress(self.f.read_at(n, size - 8 - n)))]
        self.firsts = [x[0] for x in self.directory]

    def block(self, k: int) -> list[list]:
        _, at, n = self.directory[k]
        return [json.loads(line) for line in zlib.decompress(self.f.read_at(n, at)).decode().split("\n")]

    def find(self, key: str) -> Iterator[list]:
        """All captures of a key: from the last block that starts before it, as long as it goes on."""
        k = max(bisect_left(self.firsts, key) - 1, 0)
        while k < len(self.firsts) and self.firsts[k] <= key:
            lines = self.block(k)
            keys = [x[0] for x in lines]
            yield from lines[bisect_left(keys, key):bisect_right(keys, key)]
            k += 1


def all_captures(shards: DataFrame) -> DataFrame:
    """Every capture of the index, block by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, size in zip(*(c.to_pylist() for c in b.columns)):
                shard = Shard(name, size)
                for k in range(len(shard.directory)):
                    yield rows_of(CAPTURES, shard.block(k))

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.select("file", "size").repartition(n, "file").mapInArrow(run, CAPTURES_DDL)


def look_up(shards: DataFrame, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Captures of each distinct url of a table, with the asked url as `asked`.

    Only the list of shards comes to the driver; its length is the number given when writing.
    Urls go to the shards whose range holds their key, spread so that a shard that many ask
    for is searched by several tasks.
    """
    parts = sorted((r.first_key, r.last_key, r.file, r.size) for r in shards.collect())
    firsts, lasts = [p[0] for p in parts], [p[1] for p in parts]
    asked_schema = pa.schema([("asked", pa.string()), ("key", pa.string()), ("shard", pa.int32())])
    found_schema = pa.schema([("asked", pa.string()), *CAPTURES])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for url in b.column(0).to_pylist():
                key = url_key(url)
                out += [(url, key, k) for k in range(bisect_left(lasts, key), bisect_right(firsts, key))]
            yield rows_of(asked_schema, out)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        for b in batches:
            out = []
            for url, key, k in zip(*(c.to_pylist() for c in b.columns)):
                if k != number:
                    number, shard = k, Shard(parts[k][2], parts[k][3])
                out += [(url, *line) for line in shard.find(key)]
            yield rows_of(found_schema, out)

    routed = urls.select(F.col(url_col).cast("string").alias("asked")).where("asked is not null").distinct().mapInArrow(
        route, "asked string, key string, shard int"
    )
    n = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = routed.repartition(n, "shard", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("shard", "key")
    return spread.mapInArrow(search, f"asked string, {CAPTURES_DDL}")


def read_records(captures: DataFrame, with_payload: bool = True) -> DataFrame:
    """Reads the records of captures by byte ranges; neighbours in a file are read at once.

    Columns: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload;
    the last two are null for revisits, and payload without with_payload.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            k = 0
            while k < len(rows):
                file, begin, end, last = rows[k][0], rows[k][1], rows[k][1], k
                while last < len(rows) and rows[last][:2] == (file, end) and end - begin < RANGE_BYTES:
                    end += rows[last][2]
                    last += 1
                if file != name:
                    name, f = file, open_random(file)
                raw = memoryview(f.read_at(end - begin, begin))
                out = []
                for _, at, n in rows[k:last]:
                    out.append(parse(zlib.decompress(raw[at - begin:at - begin + n], 31)))
                if not with_payload:
                    out = [(*r[:-1], None) for r in out]
                yield rows_of(RECORDS, out)
                k = last

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("offset") / (RANGE_BYTES * 4))
    spread = captures.select("file", "offset", "length").repartition(n, "file", part).sortWithinPartitions("file", "offset")
    return map_texts(spread, run, RECORDS_DDL)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records, with payload_bytes of a revisit taken from the response it refers to."""
    responses = records.where("record_type = 'response'").groupBy("page_id", "payload_digest").agg(
        F.max("payload_bytes").alias("bytes")
    ).select(F.col("page_id").alias("refers_to"), "payload_digest", "bytes")
    return records.join(responses, ["refers_to", "payload_digest"], "left").select(
        *[c for c in records.columns if c != "payload_bytes"],
        F.coalesce("payload_bytes", "bytes").alias("payload_bytes"),
    )


def archive(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Writes archives and index to fresh shared folders; returns the stored list of index shards."""
    captures = write_archives(pages, shared_dir(spark, "warc"), **options)
    return write_index(captures, shared_dir(spark, "warc-index"))
