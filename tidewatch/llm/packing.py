"""Packing documents into fixed-length training sequences, in order.

The token stream of a partition is cut into windows by dynamic programming over all its places. A window
pays one unit for each token of padding, and its end pays a penalty that depends on what it
truncates: nothing at the end of a document, little at the end of a sentence, more elsewhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .tokens import encode_in_slices, worker_encoder

LENGTH = 2048
SENTENCE_COST, CUT_COST = 4, 8
#: More than any sum of penalties.
NEVER = 1 << 60
#: Tokens for which cuts are chosen at a time, of all their places; the best sum for more at a time is less by at most a window's.
SEGMENT = 1 << 21
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])


def values(costs: np.ndarray, length: int) -> np.ndarray:
    """The least sum of windows' lengths and penalties up to each place; costs[p] is the penalty of ending at p.

    Places are taken in blocks of one window's length. The windows that end in a block begin in the block before,
    from some place on (a running minimum from its end), or in the block itself. Of those, only windows that
    begin where one from the block before ends matter, as two windows within one block could be one.
    """
    n = len(costs)
    out = np.zeros(n, np.int64)
    before = np.full(length, NEVER, np.int64)
    before[-1] = 0
    for k in range(1, n, length):
        price = costs[k:k + length] + length
        now = np.minimum.accumulate(before[::-1])[::-1][:len(price)]
        inside = np.minimum.accumulate(now + price)
        now[1:] = np.minimum(now[1:], inside[:-1])
        before = out[k:k + length] = now + price
    return out


def previous(value: np.ndarray, place: int, length: int) -> int:
    """Where the window that ends at a place begins: of the best places the last."""
    least = max(place - length, 0)
    return place - 1 - int(value[least:place][::-1].argmin())


def cuts_to(value: np.ndarray, place: int, length: int) -> list[int]:
    """Window ends of the best way to a place."""
    cuts = []
    while place:
        cuts.append(place)
        place = previous(value, place, length)
    return cuts[::-1]


def best_cuts(places: list[int], costs: list[int], length: int = LENGTH, cut_cost: int = CUT_COST,
              run: int | None = None) -> tuple[list[int], int]:
    """Window ends from 0 to places[-1] of least padding plus penalties, and that sum.

    places: boundaries in ascending order from 0; costs: the penalty of ending at each. A window may end at
    any other place for cut_cost. With a run, only full windows may, at most `run` of which, the last
    full or not, lie between two chosen boundaries; the boundaries are then at most length apart.
    """
    end = places[-1]
    if run is None:
        dense = np.full(end + 1, cut_cost, np.int64)
        dense[places] = costs
        value = values(dense, length)
        return cuts_to(value, end, length), int(value[end]) - end
    spots = np.array(places, np.int64)
    value, parent = np.zeros(len(spots), np.int64), np.zeros(len(spots), np.int64)
    for j in range(1, len(spots)):
        first = int(np.searchsorted(spots, spots[j] - run * length))
        windows = -((spots[first:j] - spots[j]) // length)
        sums = value[first:j] + windows * (length + cut_cost)
        parent[j] = first + int(sums.argmin())
        value[j] = sums.min() - cut_cost + costs[j]
    cuts, j = [], len(spots) - 1
    while j:
        i = int(parent[j])
        cuts += [places[j], *range(places[i] + (places[j] - places[i] - 1) // length * length, places[i], -length)]
        j = i
    return cuts[::-1], int(value[-1]) - end


class Packer:
    """Cuts a stream of documents into windows, holding a bounded part of it."""

    def __init__(self, ends_sentence: np.ndarray, length: int, sentence_cost: int, cut_cost: int, first_id: int,
                 with_ids: bool):
        self.ends_sentence, self.length = ends_sentence, length
        self.sentence_cost, self.cut_cost = sentence_cost, cut_cost
        self.sequence, self.with_ids = first_id, with_ids
        self.docs: list[tuple[int | None, int, np.ndarray, int]] = []  # id, ids already placed, the rest, all
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, 0, ids, len(ids)))
        self.waiting += len(ids)
        if self.waiting >= SEGMENT:
            yield from self.cut(last=False)

    def cut(self, last: bool = True) -> Iterator[tuple]:
        """Places the waiting ids; unless it is the last time, the final windows wait for more."""
        if not self.docs:
            return
        ids = np.concatenate([d[2] for d in self.docs])
        costs = np.full(len(ids) + 1, self.cut_cost, np.int64)
        costs[1:][self.ends_sentence[ids]] = self.sentence_cost
        costs[np.cumsum([len(d[2]) for d in self.docs])] = 0
        cuts = cuts_to(values(costs, self.length), len(ids), self.length)
        if not last:
            cuts = [c for c in cuts if c <= len(ids) - 4 * self.length]
        at, d, used = 0, 0, 0  # place in ids; document and its ids placed in this round
        for end in cuts:
            offset = 0
            while at < end:
                doc_id, before, rest, total = self.docs[d]
                n = min(end - at, len(rest) - used)
                piece = ids[at:at + n].tobytes()
                yield (doc_id, before + used, n, zlib.crc32(piece), total, self.sequence, offset,
                       piece if self.with_ids else None)
                at, used, offset = at + n, used + n, offset + n
                if used == len(rest):
                    d, used = d + 1, 0
            self.sequence += 1
        self.docs = self.docs[d:]
        if used:
            doc_id, before, rest, total = self.docs[0]
            self.docs[0] = (doc_id, before + used, rest[used:], total)
        self.waiting = len(ids) - at


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = LENGTH, id_col: str = "doc_id",
         text_col: str = "text", sentence_cost: int = SENTENCE_COST, cut_cost: int = CUT_COST,
         with_ids: bool = True) -> DataFrame:
    """One row per piece of a document in a sequence.

    doc_id, start (its ids before the piece), length, ids_crc32, doc_tokens, sequence_id,
    offset (place in the sequence) and, with_ids, the ids as little-endian unsigned 32-bit
    numbers. Documents keep the order of the table: each input partition is a stream of its own, so
    nothing is shuffled and only its last sequence may be left short. A null or empty text has
    the end id only. Repeated rows are packed each; a null id stays null. No rows give no rows.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path)
        vocabulary = encoder.tokenizer.get_vocab(with_added_tokens=True)
        ends = np.zeros(max([*vocabulary.values(), end_id]) + 1, bool)
        for token, i in vocabulary.items():
            ends[i] = token.removesuffix("</w>").endswith((".", "!", "?", "Ċ"))  # the last stands for a line break
        packer = Packer(ends, length, sentence_cost, cut_cost, TaskContext.get().partitionId() << 33, with_ids)
        end = np.array([end_id], "<u4").tobytes()
        out: list[tuple] = []
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), encode_in_slices(encoder, b.column(1).to_pylist())):
                for piece in packer.add(doc_id, np.frombuffer(ids + end, "<u4")):
                    out.append(piece)
            if len(out) >= 2_000:
                yield as_batch(out)
                out = []
        out += packer.cut()
        for k in range(0, len(out), 10_000):
            yield as_batch(out[k:k + 10_000])

    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long, ids binary")
    out = map_texts(rows, run, schema)
    return out if with_ids else out.drop("ids")


def as_batch(pieces: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*pieces), SCHEMA)], schema=SCHEMA
    )
