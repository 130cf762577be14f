"""Collocations against plain counting, and the filters that count them."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import collocations
from tidewatch.llm.quotient_filter import Code, Shape, combined

DOCS = "doc_id long, text string, lang string, rank string, a double, ids string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1.0, "y") for i, (t, lang) in enumerate(rows)], DOCS)


def by_hand(rows, top, least, longest):
    out = []
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        n, found = totals[lang], []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, r, n, -s) for i, (s, a, p, left, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def sample(seed=3):
    rnd = random.Random(seed)
    words = ["the", "of", "New", "york", "Él", "ÉL", "a\x1cb", "x" * 30, "new", "\xa0"]
    rows = []
    for _ in range(60):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r"]) for _ in range(rnd.randrange(0, 60)))
        rows.append((text, rnd.choice(["en", "de", None, "und"])))
    return [*rows, (None, "en"), ("", None), ("word", "fr"), *[("san francisco bay area now", "fr")] * 30]


@pytest.mark.parametrize("top, least, longest", [(2000, 4, 5), (7, 3, 3), (3, 6, 2)])
def test_equals_plain_counting(spark, top, least, longest):
    rows = sample()
    got = collocations.collocations(documents(spark, rows), top, least, longest).collect()
    assert sorted(tuple(r)[:8] for r in got) == by_hand(rows, top, least, longest)


def test_many_blocks_and_small_holdings(spark, monkeypatch):
    for name, value in (("HELD", 64), ("ROW_KEYS", 5), ("BLOCK_KEYS", 16), ("HELD_WORDS", 3), ("LISTED", 2)):
        monkeypatch.setattr(collocations, name, value)
    rows = sample(4)
    got = collocations.collocations(documents(spark, rows).repartition(7), 50, 3).collect()
    assert sorted(tuple(r)[:8] for r in got) == by_hand(rows, 50, 3, 5)


def test_nothing_to_find_and_long_texts(spark):
    assert collocations.collocations(documents(spark, [])).count() == 0
    assert collocations.collocations(documents(spark, [(None, None), ("", "en"), ("one two", "en")])).count() == 0
    (row,) = collocations.collocations(documents(spark, [("aa bb. " * 400_000, "en")])).collect()
    assert (row.phrase, row.a, row.n, row.score) == ("aa bb", 400_000, 800_000, 1000 * 800_000 // 400_000)


def test_products_past_64_bits(spark):
    ids = [([1], 10**12), ([2], 10**12), ([1, 2], 10**11)]
    grams = spark.createDataFrame(ids, "ids array<int>, f long")
    words = spark.createDataFrame([("en", b"p", 1), ("en", b"q", 2)], "lang string, word binary, id int")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(collocations, "phrases", lambda *_: (words, totals, grams))
        (row,) = collocations.collocations(documents(spark, [])).collect()
    assert row.score == 1000 * 10**11 * 10**13 // 10**24


@pytest.mark.parametrize("n, width", [(1, 3), (2, 5), (2, 25), (3, 21), (3, 22), (4, 17), (5, 13), (5, 25), (2, 32)])
def test_filters_lose_nothing(n, width):
    rng = np.random.default_rng(n * 100 + width)
    code = Code(n, width)
    words = [rng.integers(0, 1 << width, 4000).astype(np.int64) for _ in range(n)]
    hi, lo = code.pack(words)
    assert all((a == b).all() for a, b in zip(words, code.unpack(hi, lo)))
    counts = rng.integers(1, 600, 4000)
    keys = combined(hi, lo, counts)
    want = Counter()
    for key, c in zip(zip(*words), counts):
        want[tuple(map(int, key))] += int(c)
    for block_bits in (0, 2, 9):
        shape, got = Shape(code, block_bits), Counter()
        blocks = shape.block(keys[0])
        for block in np.unique(blocks).tolist():
            part = [k[blocks == block] for k in keys]
            found = shape.decode(block, shape.encode(*part))
            assert all((a == b).all() for a, b in zip(part, found))
            for *key, c in zip(*code.unpack(*found[:2]), found[2]):
                got[tuple(map(int, key))] += int(c)
        assert got == want
