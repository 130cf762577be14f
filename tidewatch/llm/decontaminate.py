"""Benchmark decontamination: rare n-gram seeds, an equality join, then Smith-Waterman alignment.

One pass counts how often the n-grams of the test items (1 to 4 words) occur in the documents outside of
longer matches, so that copies of an item do not make its own n-grams common. Those that are rare are seeds,
n-grams of 4 words always; a stretch of an item without a rare one has its rarest. A second pass finds the seeds in the
documents, and a join by seed gives the places of items. Places on nearby diagonals make a
passage; passages with two words of the item under seeds (one, if that is a copy), and enough of its words in all, are aligned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, bitmap_of, map_texts, stored
from .spelling import code_points, random_bits, spelled, table_size

WORD = re.compile(r"\w+")
#: Words of the longest seeds.
GRAM = 4
#: Items with fewer words match nothing.
LEAST_WORDS = 1
#: An n-gram is rare that occurs at most this often, or in this share of as many places as there are documents.
RARE, RARE_SHARE = 20, 1 / 5_000
#: Words of an item in which there is at least one seed, if any of its n-grams occurs at all.
STRETCH, RAREST = 8, 2
#: Share of an item's best possible score from which a passage counts as a copy of it.
SCORE = 0.4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words on both sides of the seeds' diagonals that the alignment may also use, at least.
MARGIN = 10
#: N-grams that are sent to the tasks one by one at most; beyond that a bitmap alone sorts out, and the join decides.
LISTED = 2_000_000
#: Items that a task keeps ready.
KNOWN_ITEMS = 1_000
#: Characters of texts that are hashed together.
TOGETHER = 1 << 18
#: Upper-case letters whose lower case depends on their word or is more than one character.
ODD_CASE = ("\u0130", "\u03a3")

U = np.uint64
HITS = pa.schema([("doc_id", pa.int64()), ("doc_key", pa.int64()), ("gram", pa.int64()), ("at", pa.int64())])
COUNTS = pa.schema([("gram", pa.int64()), ("f", pa.int64())])
GRAMS = pa.schema([("item", pa.int64()), ("place", pa.int32()), ("n", pa.int32()), ("words", pa.int32()), ("gram", pa.int64())])
SPOTS = pa.schema([("doc_id", pa.int64()), ("doc_key", pa.int64()), ("item", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])
ALIGNED = pa.schema([("doc_id", pa.int64()), ("doc_key", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                     ("start", pa.int64()), ("end", pa.int64())])


@lru_cache(2)
def letters(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each code point under n, whether it is part of a word, and 64 bits for its lower case."""
    chars = [chr(i) for i in range(n)]
    wordy = np.array([c.isalnum() or c == "_" for c in chars])
    return wordy, random_bits(np.array([ord(c.lower()[0]) for c in chars], U))


def codes_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of a text, and the tables of letters that cover them."""
    codes = code_points(text)
    return codes, *letters(table_size(codes))


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64 bits for each word in lower case, and where it begins and ends."""
    codes, wordy, bits = codes_of(text)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = wordy[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[::2], edges[1::2]
    out = spelled(codes, bits, begins, ends)
    if any(c in text for c in ODD_CASE):
        odd = np.flatnonzero(np.isin(codes, [ord(c) for c in ODD_CASE]))
        for k in np.unique(np.searchsorted(begins, odd, "right") - 1).tolist():
            own, _, own_bits = codes_of(text[begins[k]:ends[k]].lower())
            out[k] = spelled(own, own_bits, np.array([0]), np.array([len(own)]))[0]
    return out, begins, ends


def gram_hashes(words: np.ndarray) -> list[np.ndarray]:
    """For 1 to GRAM words, the hash of the n-gram that begins at each place. A 0 in words stands between texts."""
    out, mixed = [], words
    for n in range(1, GRAM + 1):
        if n > 1:
            mixed = mixed[:-1] * U(0x9E3779B97F4A7C15) + words[n - 1:]
        h = (mixed ^ (mixed >> U(31))) * U(0xD6E8FEB86659FD93) + U(n)
        out.append(h ^ (h >> U(32)))
    return out


class Wanted:
    """The n-grams to look for: a bitmap of bounded size, and the list itself if it is short."""

    def __init__(self, bits: int, raw: bytes, listed: np.ndarray | None):
        self.bits, self.raw, self.listed = bits, raw, listed

    @staticmethod
    def of(grams: DataFrame) -> Wanted:
        n = grams.count()
        bits = min(max(18, (64 * n).bit_length()), 27)
        raw = bitmap_of(grams, F.shiftrightunsigned("gram", 64 - bits), bits)
        listed = None
        if n <= LISTED:
            listed = np.sort(grams.select("gram").toArrow().column(0).to_numpy().view(U))
        return Wanted(bits, raw, listed)

    def has(self, grams: np.ndarray) -> np.ndarray:
        held = np.frombuffer(self.raw, np.uint8)
        place = (grams >> U(64 - self.bits)).astype(np.int64)
        found = (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        if self.listed is not None and found.any():
            at = np.flatnonzero(found)
            near = np.minimum(np.searchsorted(self.listed, grams[at]), len(self.listed) - 1)
            found[at] = self.listed[near] == grams[at]
        return found


def matches(words: np.ndarray, wanted: Wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of 1 to GRAM words, and at which places they are wanted."""
    inside = words != 0
    for n, grams in enumerate(gram_hashes(words)):
        found = wanted.has(grams)
        for k in range(n + 1):
            found &= inside[k:len(words) - n + k]
        yield grams, found


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with a 0 after each, and where each begins."""
    parts, sizes, first, chars = [], [], 0, 0
    for i, text in enumerate(texts, 1):
        chars += len(text) + 1
        if chars >= TOGETHER or i == len(texts):
            hashes, begins, _ = word_hashes("\n".join(texts[first:i]))
            ends = np.cumsum([len(t) + 1 for t in texts[first:i]])
            sizes.append(np.diff(np.searchsorted(begins, ends), prepend=0))
            parts.append(hashes)
            first, chars = i, 0
    words = np.concatenate([*parts, np.zeros(0, U)])
    counts = np.concatenate([*sizes, np.zeros(0, np.int64)])
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.zeros(max(int(starts[-1]), GRAM), U)
    out[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = words
    return out, starts


def item_grams(items: DataFrame) -> DataFrame:
    """item, place, n, words (those of the item) and gram of every n-gram of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words, _ = joined([text])
                size = int((words != 0).sum())
                for n, grams in enumerate(gram_hashes(words[:size]) if size else [], 1):
                    m = max(size - n + 1, 0)
                    yield batch(GRAMS, np.full(m, item), np.arange(m), np.full(m, n), np.full(m, size), grams[:m].view(np.int64))

    return map_texts(items.select("item", "text"), run, "item long, place int, n int, words int, gram long")


def background(rows: DataFrame, wanted: Wanted) -> DataFrame:
    """gram, f: how often the wanted n-grams occur without being part of a longer one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, _ = joined(b.column(2).to_pylist())
            levels = list(matches(words, wanted))
            for n, (grams, found) in enumerate(levels):
                alone = found.copy()
                if n + 1 < GRAM:
                    longer = levels[n + 1][1]
                    alone[:len(longer)] &= ~longer
                    alone[1:len(longer) + 1] &= ~longer
                values, counts = np.unique(grams[alone], return_counts=True)
                yield batch(COUNTS, values.view(np.int64), counts)

    return map_texts(rows, run, "gram long, f long").groupBy("gram").agg(F.sum("f").alias("f"))


def seeds_of(grams: DataFrame, counts: DataFrame, n_docs: int) -> DataFrame:
    """The n-grams that are joined: the longest, the rare, and the rarest of stretches without any."""
    rare = max(RARE, int(n_docs * RARE_SHARE))
    known = grams.join(counts, "gram", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    known = known.withColumns({
        "seed": (F.col("n") == GRAM) | (F.col("f") <= rare), "stretch": F.floor(F.col("place") / STRETCH),
    })
    part = Window.partitionBy("item", "stretch")
    rank = F.rank().over(part.orderBy("f"))
    few = F.count_if((F.col("f") <= rare) & (F.col("n") <= 2)).over(part) == 0
    return known.withColumns({"few": few, "rank": rank}).where(
        F.col("seed") | (F.col("few") & (F.col("rank") <= RAREST))
    ).select("gram", "item", "place", "n", "words")


def seed_hits(rows: DataFrame, wanted: Wanted) -> DataFrame:
    """doc_id, doc_key, gram and at (the word it begins at) for all places of seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, starts = joined(b.column(2).to_pylist())
            for grams, found in matches(words, wanted):
                at = np.flatnonzero(found)
                if len(at):
                    doc = np.searchsorted(starts, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)),
                        pa.array(grams[at].view(np.int64)), pa.array(at - starts[doc]),
                    ], schema=HITS)

    return map_texts(rows, run, "doc_id long, doc_key long, gram long, at long")


def margin_of(words: int) -> int:
    return max(MARGIN, words // 4)


def passages(places: list[tuple[int, int, int]], words: int, score: float = SCORE) -> Iterator[tuple[int, int]]:
    """Ranges of words around seeds on nearby diagonals, no longer than an alignment needs.

    places: diagonal, place in the item and length of each seed. A range of more than two alignments'
    reach is cut into overlapping ones that together hold every alignment.
    """
    columns = np.array(places, np.int64).reshape(-1, 3).T
    _, begins, ends = all_passages(np.array([len(places)]), *columns, np.array([words]), score)
    return zip(begins.tolist(), ends.tolist())


def all_passages(counts: np.ndarray, diagonals: np.ndarray, places: np.ndarray, lengths: np.ndarray, words: np.ndarray,
                 score: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the passages of many rows, counts[i] seeds of an item of words[i] words in row i."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((diagonals, row))
    diagonals, places, lengths = diagonals[order], places[order], lengths[order]
    reach = np.maximum(MARGIN, words // 4)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (diagonals[1:] - diagonals[:-1] > reach[row[1:]])
    first = np.flatnonzero(new)
    if not len(first):
        return row, diagonals, diagonals
    last = np.append(first[1:], len(row)) - 1
    row = row[first]
    # two different words of the item are under seeds, or one is enough
    several = (np.maximum.reduceat(lengths, first) > 1) | (np.maximum.reduceat(places, first) > np.minimum.reduceat(places, first))
    good = several | (np.ceil(score * words[row]) < 2)
    row, first, last = row[good], first[good], last[good]
    size, reach = words[row], reach[row]
    step = np.maximum(size + MATCH * size // -GAP, size + 2 * reach)
    begin, end = diagonals[first] - reach, diagonals[last] + size + reach
    cuts = np.maximum(-((begin + step - end) // step), 1)
    at = np.repeat(np.arange(len(row)), cuts)
    turn = np.arange(len(at)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    begins = begin[at] + turn * step[at]
    return row[at], np.maximum(begins, 0), np.minimum(begins + 2 * step[at], end[at])


def spots(hits: DataFrame, seeds: DataFrame, score: float) -> DataFrame:
    """doc_id, doc_key, item, begin and end (in words) of the passages to align."""
    met = hits.join(seeds, "gram").groupBy("doc_id", "doc_key", "item", "words").agg(
        F.collect_list(F.struct((F.col("at") - F.col("place")).alias("d"), "place", "n")).alias("places"),
        F.sum("n").alias("seeded"),
    )
    # seeds of fewer words in all can't cover what a passage needs
    met = met.where(F.col("seeded") >= F.least(F.lit(2), F.ceil(F.lit(score) * F.col("words")))).drop("seeded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = b.column(4)
            counts = pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64)
            seeded = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in places.flatten().flatten()]
            words = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            row, begins, ends = all_passages(counts, *seeded, words, score)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in range(3)], pa.array(begins), pa.array(ends)], schema=SPOTS)

    return map_texts(met, run, "doc_id long, doc_key long, item long, begin long, end long")


def align(item: list, words: list) -> tuple[float, int, int]:
    """Best local alignment: its share of the score of an exact copy, and the words it spans.

    One row of the table at a time; gaps along the row are a running maximum.
    """
    codes = {w: i for i, w in enumerate(item)}
    y = np.array([codes.get(w, -1) for w in words])
    ramp = np.arange(len(words) + 1)

    def best(x: list[int], y: np.ndarray) -> tuple[int, int]:
        row, top, end, at = np.zeros(len(y) + 1, np.int64), 0, 0, ramp[:len(y) + 1]
        for code in x:
            step = np.where(y == code, MATCH, MISMATCH)
            new = np.maximum(row + GAP, 0)
            new[1:] = np.maximum(new[1:], row[:-1] + step)
            row = np.maximum.accumulate(new - GAP * at) + GAP * at
            if row.max() > top:
                end = int(row.argmax())
                top = int(row[end])
        return top, end

    x = [codes[w] for w in item]
    score, end = best(x, y)
    if not score:
        return 0.0, 0, 0
    _, length = best(x[::-1], y[:end][::-1])
    return score / (MATCH * len(item)), end - length, end


class Item:
    """A test item's words, and their hashes with how often each is there."""

    def __init__(self, text: str):
        self.words = words_of(text)
        self.hashes, self.counts = np.unique(word_hashes(text)[0], return_counts=True)

    def shared(self, hashes: np.ndarray) -> int:
        """How many of the item's words can have a partner, each with one of its own."""
        if not len(self.hashes):
            return 0
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        held = np.bincount(at[self.hashes[at] == hashes], minlength=len(self.hashes))
        return int(np.minimum(held, self.counts).sum())


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def aligned(found: DataFrame, score: float) -> DataFrame:
    """Alignments that reach the score; found: doc_id, doc_key, text and asked, items with their ranges of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_of = lru_cache(KNOWN_ITEMS)(Item)
        for b in batches:
            out = []
            for doc_id, key, text, asked in zip(*(c.to_pylist() for c in b.columns)):
                hashes, begins, ends = word_hashes(text)
                for a in asked:
                    item, first, last = item_of(a["text"]), a["begin"], a["end"]
                    if item.shared(hashes[first:last]) < score * len(item.words) - 1e-9:
                        continue
                    part = [text[s:e].lower() for s, e in zip(begins[first:last].tolist(), ends[first:last].tolist())]
                    share, first, last = align(item.words, part)
                    if share >= score and last > first:
                        first, last = first + a["begin"], last + a["begin"]
                        out.append((doc_id, key, a["item_id"], share, int(begins[first]), int(ends[last - 1])))
            yield batch(ALIGNED, *(zip(*out) if out else [()] * 6))

    return map_texts(found, run, "doc_id long, doc_key long, item_id long, score double, start long, end long")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_key"), text.alias("text"))


def copies(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Documents and the test items that they hold a copy of, whole or edited.

    doc_id, doc_key (hash of the text), item_id, score (share of the alignment score of an exact copy,
    at least `score`), start and end (code points of the aligned passage), the best passage for each
    pair, of equal ones the first. Words are runs of letters and digits in lower case. Null and empty
    texts hold nothing; null and empty items, and those under least_words words, are in nothing.
    Repeated documents give equal rows once; repeated items one row each, those with one id and text one. Null ids stay
    null. Very long texts are looked through whole. Without documents or items there are no rows.
    """
    items = benchmark.select(
        F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")
    ).where("text is not null").distinct()
    items = stored(items.withColumn("item", F.monotonically_increasing_id()), "test-items")
    rows = keyed(docs, id_col, text_col)
    grams = stored(item_grams(items).where(F.col("words") >= least_words), "test-grams")
    counts = background(rows, Wanted.of(grams.select("gram").distinct()))
    seeds = stored(seeds_of(grams, counts, docs.count()), "seeds")
    hits = seed_hits(rows, Wanted.of(seeds.select("gram").distinct()))
    found = stored(spots(hits, seeds, score), "passages")
    asked = found.join(items, "item").groupBy("doc_id", "doc_key").agg(
        F.collect_list(F.struct("item_id", "text", "begin", "end")).alias("asked")
    ).withColumnsRenamed({"doc_id": "_id", "doc_key": "_key"})
    texts = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc_key") == F.col("_key")))
    done = aligned(texts.select("doc_id", "doc_key", "text", "asked"), score)
    best = F.max(F.struct("score", (-F.col("start")).alias("s"), "end")).alias("best")
    return done.groupBy("doc_id", "doc_key", "item_id").agg(best).select(
        "doc_id", "doc_key", "item_id", F.col("best.score").alias("score"), (-F.col("best.s")).alias("start"),
        F.col("best.end").alias("end"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no copy of a test item, with all their columns."""
    leaked = copies(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(
        F.col("doc_id").alias("__doc_id"), F.col("doc_key").alias("__doc_key")
    ).distinct()
    key = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(
        leaked, (key == leaked["__doc_key"]) & docs[id_col].cast("long").eqNullSafe(leaked["__doc_id"]), "left_anti"
    )
