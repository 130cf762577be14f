"""Token ids in patched frame-of-reference files.

A file holds the ids of its documents one after another, in blocks of BLOCK ids, then the
document table and the block index:

    magic | block ... | doc ids | doc lengths | block starts | footer

A block is its count, minimum, width and number of exceptions, then each id minus the
minimum in that many bits, then positions and high bits of the ids that need more. The width
covers a given share of the ids. The footer says where the parts begin.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import batch, map_texts, stored
from .storage import create, new_file, open_random
from .tokens import encode_in_slices, worker_encoder

MAGIC = b"TWPFOR01"
HEADER = "<IIBI"  # ids, minimum, width, exceptions
FOOTER = "<QQQQQ8s"  # docs, blocks, ids, where documents and block starts begin
BLOCK = 65_536
SHARE = 0.95
SCHEMA = "doc_id long, file string, bucket int, position long, n_tokens long"


def pack_bits(values: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpack_bits(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(raw, count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def encode_block(ids: np.ndarray, share: float = SHARE) -> bytes:
    low = int(ids.min())
    rest = ids - np.uint32(low)
    at = min(len(rest) - 1, int(share * len(rest)))
    width = int(np.partition(rest, at)[at]).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    high = rest[odd] >> np.uint32(width) if len(odd) else np.zeros(0, np.uint32)
    body = pack_bits(rest & np.uint32((1 << width) - 1), width)
    return struct.pack(HEADER, len(ids), low, width, len(odd)) + body + odd.astype("<u4").tobytes() + high.astype("<u4").tobytes()


def decode_block(raw: bytes) -> np.ndarray:
    n, low, width, n_odd = struct.unpack_from(HEADER, raw)
    size = (n * width + 7) // 8
    ids = unpack_bits(np.frombuffer(raw, np.uint8, size, struct.calcsize(HEADER)), width, n)
    odd = np.frombuffer(raw, "<u4", 2 * n_odd, struct.calcsize(HEADER) + size)
    ids[odd[:n_odd]] |= odd[n_odd:] << np.uint32(width)
    return ids + np.uint32(low)


class Writer:
    """Writes one file, a block in memory at a time."""

    def __init__(self, uri: str, share: float = SHARE):
        self.out, self.share = create(uri), share
        self.out.write(MAGIC)
        self.pending: list[bytes] = []
        self.waiting = self.total = 0
        self.starts, self.doc_ids, self.lengths = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> int:
        """Adds a document; returns how many ids stand before it in the file."""
        before = self.total
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.total += len(ids) // 4
        self.pending.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= BLOCK:
            self.flush(BLOCK)
        return before

    def flush(self, least: int) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        while len(ids) >= max(least, 1):
            self.starts.append(self.out.tell())
            self.out.write(encode_block(ids[:BLOCK], self.share))
            ids = ids[BLOCK:]
        self.pending, self.waiting = [ids.tobytes()], len(ids)

    def close(self) -> None:
        self.flush(1)
        at_docs = self.out.tell()
        missing = np.array([d is None for d in self.doc_ids], np.uint8)
        self.out.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self.out.write(np.array(self.lengths, "<u8").tobytes())
        self.out.write(missing.tobytes())
        at_starts = self.out.tell()
        self.out.write(np.array([*self.starts, at_docs], "<u8").tobytes())
        self.out.write(struct.pack(FOOTER, len(self.doc_ids), len(self.starts), self.total, at_docs, at_starts, MAGIC))
        self.out.close()


class Reader:
    """Reads a file by blocks; ids() fetches only the blocks that a range touches."""

    def __init__(self, uri: str):
        self.f = open_random(uri)
        size = self.f.size()
        docs, blocks, self.total, at_docs, at_starts, magic = struct.unpack(
            FOOTER, self.f.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER))
        )
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        raw = self.f.read_at(at_starts - at_docs, at_docs)
        self.doc_ids = np.frombuffer(raw, "<i8", docs)
        self.lengths = np.frombuffer(raw, "<u8", docs, 8 * docs).astype(np.int64)
        self.missing = np.frombuffer(raw, np.uint8, docs, 16 * docs).astype(bool)
        self.starts = np.frombuffer(self.f.read_at(8 * (blocks + 1), at_starts), "<u8").astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        return decode_block(self.f.read_at(int(self.starts[k + 1] - self.starts[k]), int(self.starts[k])))

    def ids(self, begin: int, end: int) -> np.ndarray:
        if end <= begin:
            return np.zeros(0, np.uint32)
        first, last = begin // BLOCK, (end - 1) // BLOCK
        parts = [self.block(k) for k in range(first, last + 1)]
        return np.concatenate(parts)[begin - first * BLOCK:end - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, ids before it in the file, length and crc32 of each document, in order."""
        at, done, k, crc, n = 0, 0, 0, 0, 0
        blocks = len(self.starts) - 1
        ids = np.zeros(0, np.uint32)
        for doc_id, gone, length in zip(self.doc_ids.tolist(), self.missing.tolist(), self.lengths.tolist()):
            crc, left = 0, length
            while left:
                if done == len(ids):
                    if k == blocks:
                        raise ValueError("token file ends early")
                    ids, done, k = self.block(k), 0, k + 1
                n = min(left, len(ids) - done)
                crc = zlib.crc32(ids[done:done + n].astype("<u4").tobytes(), crc)
                done, left = done + n, left - n
            yield None if gone else doc_id, at, length, crc
            at += length


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, files: int | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts and writes them in ascending doc_id order.

    Documents are dealt by ranges of doc_id, one file each (files, by default the number of
    shuffle partitions); the files of a lower bucket come before those of a higher one.
    Returns the stored table of documents: doc_id, file, bucket, position in the file and
    n_tokens. A null text is an empty one and has the end id only. Repeated ids stand next to
    each other by text, null ids come first. No rows write no files.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(
        F.percentile_approx("doc_id", [k / files for k in range(1, files)] or [0.5], 20_000).alias("b")
    ).first().b
    edges = F.array(*[F.lit(b).cast("long") for b in sorted(set(bounds or [0]))])
    bucket = F.coalesce(F.size(F.filter(edges, lambda e: e < F.col("doc_id"))), F.lit(0))
    dealt = rows.withColumn("bucket", bucket).repartition(files, "bucket").sortWithinPartitions("bucket", "doc_id", "text")
    schema = pa.schema([
        ("doc_id", pa.int64()), ("file", pa.string()), ("bucket", pa.int32()), ("position", pa.int64()),
        ("n_tokens", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = worker_encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        writer, name, current = None, "", None
        for b in batches:
            out = []
            texts = b.column(1).to_pylist()
            for doc_id, n, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), encode_in_slices(encoder, texts)):
                if n != current:
                    if writer:
                        writer.close()
                    name, current = new_file(folder, f"ids-{n:06d}"), n
                    writer = Writer(name)
                at = writer.add(doc_id, ids + end)
                out.append((doc_id, name, n, at, len(ids) // 4 + 1))
            yield batch(schema, *zip(*out)) if out else batch(schema, [], [], [], [], [])
        if writer:
            writer.close()

    return stored(map_texts(dealt, run, SCHEMA), "token-documents")


def read_token_files(written: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    per_file = written.groupBy("bucket", "file").agg(F.sum("n_tokens").alias("n"))
    # one row per file: the running sum over them is as long as the list of files
    before = F.sum("n").over(Window.orderBy("bucket", "file").rowsBetween(Window.unboundedPreceding, -1))
    files = per_file.select("file", F.coalesce(before, F.lit(0)).cast("long").alias("before"), "n")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base, n in zip(*(c.to_pylist() for c in b.columns)):
                reader = Reader(name)
                if reader.total != n:
                    raise ValueError(f"{name} holds {reader.total} ids, not {n}")
                found = [(d, base + at, size, crc) for d, at, size, crc in reader.documents()]
                for k in range(0, len(found), 50_000):
                    yield batch(schema, *zip(*found[k:k + 50_000]))

    spread = files.repartition(int(written.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes documents to a fresh shared folder and reads them back."""
    return read_token_files(write_token_files(docs, shared_dir(spark, "token-files"), tokenizer_path, end_id))
