"""Copies of test items against the alignment of every item with every document."""

from __future__ import annotations

import random

import pytest

from tidewatch.llm import decontaminate
from tidewatch.llm.decontaminate import align, passages, words_of

DOCS = "doc_id long, text string, item_id string, score string, gram double, asked int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1.0, 2) for i, t in rows], DOCS)


def vocabulary(rnd, n):
    return ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(2, 7))) for _ in range(n)]


def planted(seed, n_docs=150, n_items=25):
    """Documents of common and rare words, of which some hold edited copies of items."""
    rnd = random.Random(seed)
    common, rare = vocabulary(rnd, 40), vocabulary(rnd, 3000)
    prose = lambda n: [rnd.choice(common) if rnd.random() < 0.7 else rnd.choice(rare) for _ in range(n)]
    items = [prose(rnd.randrange(12, 60)) for _ in range(n_items)]
    docs = []
    for i in range(n_docs):
        words = prose(rnd.randrange(0, 200))
        if i % 3 == 0:
            item, step = items[rnd.randrange(n_items)], rnd.choice([3, 4, 5, 1000])
            copy = [rnd.choice(rare) if k % step == step - 1 else w for k, w in enumerate(item)]
            if rnd.random() < 0.3:
                copy.insert(rnd.randrange(len(copy)), "inserted")
            at = rnd.randrange(len(words) + 1)
            words[at:at] = copy
        docs.append((i, " ".join(words)))
    # the whole of one item stands in very many documents, an edited copy of it in one
    hot = items[0]
    docs += [(1000 + k, " ".join([rnd.choice(rare), *hot])) for k in range(60)]
    docs.append((2000, " ".join("zzz" if k % 3 == 2 else w for k, w in enumerate(hot))))
    return docs, [(k, " ".join(w)) for k, w in enumerate(items)]


@pytest.mark.parametrize("seed, rare", [(1, 20), (2, 2)])
def test_recall_against_all_alignments(spark, monkeypatch, seed, rare):
    monkeypatch.setattr(decontaminate, "RARE", rare)
    docs, items = planted(seed)
    want = {(d, i): align(words_of(item), words_of(text))[0] for d, text in docs for i, item in items if text}
    want = {k: s for k, s in want.items() if s >= 0.4}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.copies(documents(spark, docs), bench).collect()}
    assert got.items() <= want.items() and len(want) > 100
    assert len(got) >= 0.97 * len(want)
    assert (2000, 0) in got and {1000 + k for k in range(60)} <= {d for d, i in got if i == 0}


def test_bitmap_alone_and_short_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "LISTED", 0)
    docs, items = planted(3, 60, 10)
    items += [(90, "Zebra"), (91, "quick Zebra"), (92, "-"), (93, None), (93, ""), (94, "quick zebra"), (94, "quick zebra")]
    docs += [(3000, "a quick\tZEBRA, ran"), (3001, "zebra"), (3002, None), (3003, ""), (None, "the quick zebra"), (3001, "zebra")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.copies(documents(spark, docs), bench)
    got = {(r.doc_id, r.item_id): (r.score, r.start, r.end) for r in found.collect()}
    assert got[3000, 91] == (1.0, 2, 13) and got[3000, 90] == (1.0, 8, 13) and got[None, 94] == (1.0, 4, 15)
    assert got[3001, 90] == (1.0, 0, 5) and got[3001, 91][0] == 0.5
    assert found.count() == len(got)
    none = decontaminate.copies(documents(spark, docs), bench, least_words=3)
    assert {r.item_id for r in none.collect()}.isdisjoint(range(90, 95))


def test_long_text_with_many_copies(spark):
    item = " ".join(f"w{k}" for k in range(30))
    text = " ".join(["filler"] * 50_000) + (" " + item) * 400
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    (row,) = decontaminate.copies(documents(spark, [(5, text)]), bench).collect()
    assert (row.score, row.start) == (1.0, 7 * 50_000)
    kept = decontaminate.clean_documents(documents(spark, [(5, text), (6, "w1 w2 filler")]), bench)
    assert [r.doc_id for r in kept.collect()] == [6] and kept.columns == documents(spark, []).columns


def test_passages_hold_every_alignment():
    rnd = random.Random(4)
    for _ in range(200):
        words = rnd.randrange(1, 30)
        places = [(rnd.randrange(0, 400), rnd.randrange(words), 1) for _ in range(rnd.randrange(1, 40))]
        places += [(d, (p + 1) % words, 1) for d, p, _ in places]
        ranges = list(passages(places, words))
        for d, _, _ in places:  # an alignment begins and ends within the reach of its seed's diagonal
            reach = decontaminate.margin_of(words)
            begin, end = max(d - reach, 0), d + words + reach
            assert any(a <= begin and min(end, max(p[0] for p in places) + words + reach) <= z for a, z in ranges)


def test_words_of_many_texts_at_once():
    """Places and equality of word hashes are those of the words in lower case, whatever the letters and lengths."""
    rnd = random.Random(5)
    letters = "abXYZ_9éÑİΣσς'٣𝒜𐐀ßﬁǅ̇K中.,\n" + " " * 12
    texts = ["".join(rnd.choices(letters, k=rnd.randrange(60))) for _ in range(300)]
    texts += ["", "x" * 200_000 + " a" * 40_000 + " " + "y" * 70_000 + " X Y", "ΟΔΟΣ οδος ΟΔΟΣΑ İ i̇"]
    seen = {}
    words, starts = decontaminate.joined(texts)
    for text, at, end in zip(texts, starts.tolist(), starts[1:].tolist()):
        hashes, begins, ends = decontaminate.word_hashes(text)
        assert [m.span() for m in decontaminate.WORD.finditer(text)] == list(zip(begins.tolist(), ends.tolist()))
        assert words[at:end].tolist() == [*hashes.tolist(), 0]
        for word, h in zip(words_of(text), hashes.tolist()):
            assert seen.setdefault(word, h) == h != 0
    assert len(set(seen.values())) == len(seen)
