"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_texts, stored
from .components import components

BITS = 64
SEED = 42
SHINGLE = 3
MAX_DISTANCE = 3
#: Shingles hashed at a time, and fingerprints that one task compares with as many others.
HASHES, TILE = 65_536, 4_096


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text; 0 without any word."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    width = min(shingle, len(words))
    starts = (ends - lengths)[:len(words) - width + 1].tolist()
    ends = ends[width - 1:].tolist()
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(starts), HASHES):
        hashes = np.array(
            [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[k:k + HASHES], ends[k:k + HASHES])], "<u8"
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long. A null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py() or "", shingle) for t in b.column(1)], np.uint64)
            yield batch(schema, b.column(0), found.view(np.int64))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, run, "doc_id long, fp long")


def segment_masks(max_distance: int) -> list[int]:
    """For each bit, the signed mask of its segment without it. With max_distance // 2 + 1
    segments, two fingerprints at that distance have one that differs by one bit at most."""
    segments = max_distance // 2 + 1
    edges = [BITS * k // segments for k in range(segments + 1)]
    out = []
    for lo, hi in zip(edges, edges[1:]):
        whole = ((1 << hi) - 1) ^ ((1 << lo) - 1)
        out += [whole & ~(1 << bit) for bit in range(lo, hi)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def spanning_links(nodes: np.ndarray, fps: np.ndarray, max_distance: int) -> tuple[list[int], list[int]]:
    """Links that connect all that are within the distance: one for each further member of a group."""
    a: list[int] = []
    b: list[int] = []
    left = np.arange(len(fps))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= max_distance
            if near.any():
                reached = left[near].tolist()
                a += [int(nodes[at])] * len(reached)
                b += nodes[reached].tolist()
                queue += reached
                left = left[~near]
    return a, b


def _verified(groups: DataFrame, max_distance: int) -> DataFrame:
    """Links within each array of (node, fp)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows.column(0)
            for k in range(len(lists)):
                members = lists[k].values
                a, b = spanning_links(
                    members.field("node").to_numpy(zero_copy_only=False),
                    members.field("fp").to_numpy(zero_copy_only=False).view(np.uint64), max_distance,
                )
                if a:
                    yield batch(schema, a, b)

    return map_texts(groups.select("members"), run, "a long, b long")


def links(marked: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links a, b that connect fingerprints within the distance; marked: node and distinct fp.

    Each fingerprint has one key for each bit: its segment with that bit left out. Keys that
    several share are joined and verified. A key with more than TILE fingerprints is cut into
    slices, and every two slices meet in a task of their own, so no task holds a whole bucket.
    """
    masks = F.array(*[F.lit(m) for m in segment_masks(max_distance)])
    keyed = marked.select("node", "fp", F.posexplode(masks).alias("bit", "mask")).select(
        F.col("bit").cast("byte").alias("bit"), F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "node", "fp"
    )
    shared = keyed.groupBy("bit", "part").agg(F.count("*").alias("n")).where("n > 1")
    # Spark takes the exploded rows for as many as there were before, and would broadcast them all
    found = stored(keyed.hint("merge").join(shared, ["bit", "part"]), "simhash-keys")
    member = F.struct("node", "fp")
    small = found.where(F.col("n") <= TILE).groupBy("bit", "part").agg(F.collect_list(member).alias("members"))
    slices = F.ceil(F.col("n") / TILE)
    tiled = (
        found.where(F.col("n") > TILE)
        .withColumn("own", F.pmod(F.xxhash64("fp"), slices))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)))
        .groupBy("bit", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .agg(F.collect_list(member).alias("members"))
    )
    return _verified(small.select("members").unionByName(tiled.select("members")), max_distance).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per document: doc_id, fp (signed), component_id.

    Words are split at ASCII white space after lower-casing A-Z; shingles are hashed with
    repeats. Documents whose fingerprints differ in at most max_distance bits are linked, and
    component_id is the least id reachable. A null text counts as empty; texts without words
    have fingerprint 0 and are linked like others. Repeated rows stay and get the same answer.
    A null id is never a component_id: such a row joins the component of its fingerprint, or
    none (null) where no row with that fingerprint has an id. No rows give no rows. Other
    columns of docs are not looked at.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    marked = stored(
        prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-distinct"
    )
    found = components(links(marked, max_distance))
    classes = marked.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without near-duplicates: of each component the one with the least id.

    Rows that repeat a kept id are duplicates as well: the first by text stays. Rows
    without an id can't be named as anyone's duplicate and stay.
    """
    ids = near_duplicates(docs, id_col, text_col, **options).where("doc_id = component_id").select(
        F.col("doc_id").alias("__kept_id")
    ).distinct()
    from pyspark.sql import Window

    named = docs.join(ids, docs[id_col].cast("long") == ids["__kept_id"], "left_semi")
    turn = F.row_number().over(Window.partitionBy(F.col(id_col).cast("long")).orderBy(F.col(text_col)))
    named = named.withColumn("__turn", turn).where("__turn = 1").drop("__turn")
    return named.unionByName(docs.where(F.col(id_col).isNull()))
