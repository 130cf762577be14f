"""Phrase collocations of each language, counted in merged counting quotient filters.

Words are counted first; only those with min_count occurrences get numbers, as a phrase occurs at most
as often as each of its parts. For the same reason phrases of n words are counted only where both of
their parts of n - 1 words may have min_count occurrences, which a bitmap of bounded size tells, with
chance hits that cost time and change nothing. Each task counts its phrases in quotient filters cut
into blocks; filters of one block meet in one task, which merges them and gives the frequent phrases.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, bitmap_of, map_texts, stored
from .quotient_filter import Code, Shape, combined

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: Marks the end of a piece; no byte of UTF-8.
BREAK = b"\xff"
BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BREAK * 10)
#: Distinct words that a task counts before it hands them on, and phrases that it holds.
HELD_WORDS, HELD = 300_000, 1 << 21
#: Keys in one row of the shuffle, and phrases to a block of the filters on average.
ROW_KEYS, BLOCK_KEYS = 8_192, 1 << 22
#: Frequent words whose numbers are broadcast at most; more are joined by shuffle.
LISTED = 1_000_000
#: Bits of the bitmap of frequent shorter phrases, 16 MB at most.
LEAST_MAP, MOST_MAP = 16, 27

WORDS = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])
BLOCKS = pa.schema([("block", pa.int64()), ("filter", pa.binary())])
GRAMS = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("ids", pa.list_(pa.int32())), ("f", pa.int64())])
IDS = pa.schema([("ids", pa.binary())])


def tokens_of(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z only), with BREAK between pieces."""
    return text.lower().translate(BREAKS).replace(BREAK, b" \xff ").split()


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, n; the empty word has the number of all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def flushed() -> pa.RecordBatch:
            out = [(lang, word, n) for lang, c in counts.items() for word, n in c.items() if n]
            counts.clear()
            return batch(WORDS, *(zip(*out) if out else ((), (), ())))

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words, own = tokens_of(text), counts[lang]
                own.update(words)
                own[b""] += len(words) - own.pop(BREAK, 0)
            if sum(map(len, counts.values())) > HELD_WORDS:
                yield flushed()
        yield flushed()

    found = map_texts(rows, run, "lang string, word binary, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame, spread: int = 256) -> DataFrame:
    """Adds id, a number from 1 that no two rows share; no task sees all rows."""
    part = F.pmod(F.xxhash64("lang", "word"), F.lit(spread))
    place = F.row_number().over(Window.partitionBy(part).orderBy("lang", "word"))
    return words.withColumn("id", ((place - 1) * spread + part + 1).cast("int"))


def encoded(rows: DataFrame, words: DataFrame) -> DataFrame:
    """ids: the word numbers of each text (little-endian, 32 bits), 0 for rare words and ends of pieces."""
    if words.count() > LISTED:
        return encoded_by_join(rows, words)
    spark = rows.sparkSession
    lists = spark.sparkContext.broadcast(words.select("lang", "word", "id").toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, dict[bytes, int]] = defaultdict(dict)
        known = lists.value
        for lang, word, i in zip(*(known.column(c).to_pylist() for c in ("lang", "word", "id"))):
            numbers[lang][word] = i
        for b in batches:
            out = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = tokens_of(text)
                out.append(np.fromiter(map(numbers[lang].get, found, repeat(0)), "<i4", len(found)).tobytes())
            yield batch(IDS, out)

    return map_texts(rows, run, "ids binary")


def encoded_by_join(rows: DataFrame, words: DataFrame) -> DataFrame:
    """The same where the list of words is too long to be broadcast."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.binary()))])
        for b in batches:
            yield batch(schema, b.column(0), [tokens_of(t) for t in b.column(1).to_pylist()])

    texts = stored(
        map_texts(rows, cut, "lang string, words array<binary>").withColumn("row", F.monotonically_increasing_id()),
        "phrase-words",
    )
    placed = texts.select("row", "lang", F.posexplode("words").alias("place", "word"))
    joined = placed.join(words.select("lang", "word", "id"), ["lang", "word"], "left")
    number = F.struct("place", F.coalesce("id", F.lit(0)).alias("id"))
    lists = joined.groupBy("row").agg(F.sort_array(F.collect_list(number))["id"].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(IDS, [np.array(x, "<i4").tobytes() for x in b.column(0).to_pylist()])

    return map_texts(lists.select("ids"), run, "ids binary")


class Bitmap:
    """Which leading bits the keys of frequent phrases have."""

    def __init__(self, code: Code, bits: int, raw: bytes):
        self.code, self.bits, self.raw = code, bits, raw

    @staticmethod
    def of(grams: DataFrame, code: Code, n: int) -> Bitmap:
        bits = min(max(LEAST_MAP, (16 * n).bit_length()), MOST_MAP, code.high)
        return Bitmap(code, bits, bitmap_of(grams, F.shiftrightunsigned("hi", 64 - bits), bits))

    def has(self, hi: np.ndarray) -> np.ndarray:
        place = (hi >> np.uint64(64 - self.bits)).astype(np.int64)
        held = np.frombuffer(self.raw, np.uint8)
        return (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def places_of(ids: np.ndarray, n: int, shorter: Bitmap | None) -> np.ndarray:
    """Where the phrases of n words begin that may be frequent."""
    inside = ids != 0
    span = n if shorter is None else n - 1
    all_in = inside[:len(ids) - span + 1].copy() if len(ids) >= span else np.zeros(0, bool)
    for k in range(1, span):
        all_in &= inside[k:len(ids) - span + 1 + k]
    if shorter is not None:
        at = np.flatnonzero(all_in)
        hi, _ = shorter.code.pack([ids[at + k] for k in range(span)])
        all_in[at] = shorter.has(hi)
        all_in = all_in[:-1] & all_in[1:]
    return np.flatnonzero(all_in)


def joined_ids(b: pa.RecordBatch) -> np.ndarray:
    parts = [p for raw in b.column(0).to_pylist() for p in (np.frombuffer(raw, "<i4"), np.zeros(1, np.int32))]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


class Held:
    """Keys and counts of a task, combined whenever they are many."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((hi, lo, counts))
        self.size += len(hi)
        if self.size > HELD:
            self.combine()

    def combine(self) -> tuple[np.ndarray, ...]:
        if len(self.parts) > 1:
            self.parts = [combined(*map(np.concatenate, zip(*self.parts)))]
            self.size = len(self.parts[0][0])
        return self.parts[0] if self.parts else (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)

    def take(self) -> tuple[np.ndarray, ...]:
        out = self.combine()
        self.parts, self.size = [], 0
        return out


def frequent_phrases(ids: DataFrame, n: int, width: int, shorter: Bitmap | None, block_bits: int,
                     min_count: int) -> DataFrame:
    """hi, lo (the permuted number), ids and f of each phrase of n words with min_count occurrences."""
    code = Code(n, width)
    shape = Shape(code, block_bits)

    def filters(keys: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        hi, lo, counts = keys
        blocks = shape.block(hi)
        edges = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])).tolist() if len(hi) else []
        rows = []
        for a, z in zip(edges, [*edges[1:], len(hi)]):
            for k in range(a, z, ROW_KEYS):
                e = min(k + ROW_KEYS, z)
                rows.append((int(blocks[a]), shape.encode(hi[k:e], lo[k:e], counts[k:e])))
                if len(rows) == 64:
                    yield batch(BLOCKS, *zip(*rows))
                    rows = []
        if rows:
            yield batch(BLOCKS, *zip(*rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for b in batches:
            words = joined_ids(b)
            for k in range(0, len(words), HELD):  # a slice also sees the words that phrases at its end need
                part = words[k:k + HELD + n - 1]
                at = places_of(part, n, shorter)
                at = at[at < HELD]
                if len(at):
                    held.add(*combined(*code.pack([part[at + j] for j in range(n)])))
            if held.size > HELD // 2:
                held.combine()
                if held.size > HELD // 2:
                    yield from filters(held.take())
        yield from filters(held.take())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = Held(), None
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if block != current:
                    yield frequent(held.take())
                    current = block
                held.add(*shape.decode(block, raw))
        yield frequent(held.take())

    def frequent(keys: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        hi, lo, counts = (x[keys[2] >= min_count] for x in keys)
        lists = np.stack(code.unpack(hi, lo), axis=1).astype(np.int32).tolist() if len(hi) else []
        return batch(GRAMS, hi.view(np.int64), lo.view(np.int64), lists, counts)

    counted = map_texts(ids, count, "block long, filter binary")
    sorted_blocks = counted.repartition("block").sortWithinPartitions("block")
    return map_texts(sorted_blocks, merge, "hi long, lo long, ids array<int>, f long")


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, text_col: str = "text",
            lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: words (lang, word, id, n) with min_count occurrences, totals (lang, n) and grams
    (ids, f), all phrases of 1 to max_words words with min_count occurrences."""
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    counts = stored(word_counts(rows).where((F.col("n") >= min_count) | (F.length("word") == 0)), "phrase-counts")
    totals = counts.where(F.length("word") == 0).select("lang", "n")
    words = stored(numbered(counts.where((F.length("word") > 0) & (F.col("n") >= min_count))), "phrase-numbers")
    top = words.agg(F.max("id")).first()[0] or 1
    width, all_words = int(top).bit_length(), totals.agg(F.sum("n")).first()[0] or 0
    block_bits = max(3, int(all_words // BLOCK_KEYS).bit_length())
    grams = words.select(F.array("id").alias("ids"), F.col("n").alias("f"))
    ids = stored(encoded(rows, words), "phrase-ids") if max_words > 1 else None
    shorter = None
    for n in range(2, max_words + 1):
        found = stored(frequent_phrases(ids, n, width, shorter, block_bits, min_count), f"phrases-{n}")
        size = found.count()
        if not size:
            break
        grams = grams.unionByName(found.select("ids", "f"))
        shorter = Bitmap.of(found, Code(n, width), size)
    return words, totals, grams


def exact(column: str | Column) -> Column:
    """A whole number whose products may pass 64 bits."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(38,0)")


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first `top` phrases of each language by the score of their weakest cut.

    lang, rank (from 1), phrase, a (its occurrences), cut (words before the cut), l and r (those of the two
    parts), n (words of the language) and score, floor(1000 * a * n / (l * r)) of the cut where that is
    least (ties: the first). Phrases have 2 to max_words words, at least min_count occurrences, and
    lie in one piece between the marks .,;:!? and line ends; overlapping occurrences count.
    A phrase that is part of a longer one with as many occurrences is dropped. Order: score and a
    descending, then the phrase by its bytes. Null texts are empty, a null language is `und`; repeated rows count
    each. Without phrases there are no rows. Other columns are not looked at.
    """
    words, totals, grams = phrases(docs, min_count, max_words, text_col, lang_col)
    size = F.size("ids")
    longer = grams.where(size > 2)
    inner = F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1)))
    covered = longer.select(inner.alias("ids"), "f").distinct()
    left = grams.where(size > 1).join(covered, ["ids", "f"], "left_anti")
    langs = words.select(F.col("id").alias("first_id"), "lang").join(totals, "lang")
    left = left.withColumn("first_id", F.get("ids", F.lit(0))).join(langs, "first_id").drop("first_id")
    cuts = left.select("lang", "n", "ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.withColumns({
        "head": F.slice("ids", F.lit(1), F.col("cut")), "tail": F.slice("ids", F.col("cut") + 1, F.size("ids") - F.col("cut")),
    })
    cuts = cuts.join(grams.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head")
    cuts = cuts.join(grams.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    cuts = cuts.withColumns({"up": exact(F.lit(1000)) * exact("a") * exact("n"), "down": exact("l") * exact("r")})
    weakest = F.min(F.struct(F.expr("up div down").alias("score"), "cut", "l", "r")).alias("w")
    scored = cuts.groupBy("lang", "ids", "a", "n").agg(weakest).select("lang", "ids", "a", "n", "w.*")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = stored(scored.withColumn("rank", F.rank().over(best)).where(F.col("rank") <= top).drop("rank"), "phrase-best")
    spelled = (
        first.select("ids", F.posexplode("ids").alias("place", "id")).join(words.select("id", "word"), "id")
        .groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("place", F.col("word").cast("string").alias("w")))).alias("ws"))
        .select("ids", F.array_join("ws.w", " ").alias("phrase"))
    )
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        first.join(spelled, "ids").withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"), "cut")
    )
