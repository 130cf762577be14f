"""The corpus operators on small inputs, against brute force and at their edges."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import (
    components, decontaminate, embeddings, html, line_dedup, packing, quality, simhash, token_files, tokens, toxicity, warc,
)

DOCS = "doc_id long, text string, score double, component_id string"


def documents(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "one"), (None, "two words"), (4, "a b c d e"), (4, "a b c d e"), (5, " \n\t ")]


def test_components_equal_union_find(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(0, k) for k in range(300, 360)]
    found = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = list(range(360))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert found == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_by_hand():
    from xxhash import xxh64_intdigest

    text = "The cat SAT on\tthe mat É"
    words = ["the", "cat", "sat", "on", "the", "mat", "É"]
    grams = [" ".join(words[k:k + 3]) for k in range(5)]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 5)
    assert simhash.fingerprint("") == 0 and simhash.fingerprint("A") == xxh64_intdigest(b"a", 42)


def test_simhash_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)  # makes large buckets of small ones
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(5))) for b in base for _ in range(15)})
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    found = simhash.links(spark.createDataFrame(rows, "node long, fp long"))
    got = dict(components.components(found).collect())
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    assert {i: got.get(i, i) for i in range(len(fps))} == dict(enumerate(label))


def test_simhash_keys_are_not_broadcast(spark, monkeypatch):
    """64 rows of each fingerprint, which Spark sizes as one."""
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(simhash, "stored", lambda df, purpose: plans.append(plan(df)) or df)
    rows = simhash.stored(spark.range(100).selectExpr("id AS node", "id AS fp"), "fingerprints")
    found = {tuple(sorted(r)) for r in simhash.links(rows, 1).collect()}
    assert found and all((a ^ b).bit_count() == 1 for a, b in found)
    assert "SortMergeJoin" in plans[-1] and "Broadcast" not in plans[-1]


def test_simhash_edges(spark):
    rows = simhash.near_duplicates(documents(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    found = {(r.doc_id, r.component_id) for r in rows}
    assert {(1, 1), (2, 1), (5, 1), (4, 4), (3, 3), (None, None)} == found
    kept = simhash.one_of_each(documents(spark, ODD))
    assert sorted(kept.select("doc_id").collect(), key=str) == sorted([(1,), (3,), (4,), (None,)], key=str)
    assert kept.columns == ["doc_id", "text", "score", "component_id"]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_chunks_encode_like_whole_texts(name):
    rnd = random.Random(2)
    parts = list(" \n\t\x0b\x1c\x85　abAB'sd,.!#190|<>İ́é日") + ["'ll", " the", "  ", "\x01", "<|endoftext|>", "\r\n"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(60))) for _ in range(3000)] + ["", " ", "x" * 500]
    path = tokens.tokenizer_path(name)
    whole = tokens.load(path)
    got = list(tokens.encode_in_slices(tokens.ChunkEncoder(path), texts, chars=500))
    assert got == [tokens.as_bytes(whole.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_chunks_by_hash_with_any_room(name, monkeypatch):
    """Ids are right without room for chunks, with some, and where different chunks have one hash."""
    rnd = random.Random(6)
    parts = [*" \n ab.,'é中𝒜\u0301", "ing", "the ", ". ", ",\n", '"x', "a.b ", "don't ", "\xa0"]
    path = tokens.tokenizer_path(name)
    whole, tables = tokens.load(path), tokens.tables
    for room, bits in ((0, None), (40, None), (40, 0), (40, 1), (600_000, None)):
        monkeypatch.setattr(tokens, "CACHE_CHUNKS", room)
        same = lambda n: [t if i != bits else t * 0 for i, t in enumerate(tables(n)[1:])]
        monkeypatch.setattr(tokens, "tables", lambda n: (tables(n)[0], *same(n)))
        encoder = tokens.ChunkEncoder(path)
        for _ in range(4):
            texts = ["".join(rnd.choices(parts, k=rnd.randrange(40))) for _ in range(100)]
            assert encoder.encode(texts) == [tokens.as_bytes(whole.encode(t, add_special_tokens=False).ids) for t in texts]
            assert len(encoder.keys) <= room and (np.diff(encoder.keys.astype(float)) >= 0).all()
    texts = ["one two, three.", "", "\n"]
    begins, ends, counts = tokens.chunks_of(
        texts, tokens.code_points("".join(t + "\n" for t in texts)), tables(0x10000)[0], name == tokens.BYTE_BPE)
    assert counts.tolist() == [5, 0, int(name == tokens.BYTE_BPE)] and (ends - begins)[[2, 4]].tolist() == [1, 1]


@pytest.mark.parametrize("ids", [[5], [7] * 10, list(range(70_000)), [0, 2**32 - 1, 3], [2**31] * 3 + [0]])
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    for share in (0.0, 0.5, 0.95, 1.0):
        assert (token_files.decode_block(token_files.encode_block(ids, share)) == ids).all()


def test_token_files_and_packing(spark, tmp_path):
    rows = [*ODD, *[(100 + k, "Word one. Word two! " * (k * 40)) for k in range(30)]]
    docs = documents(spark, rows).repartition(3)
    path = tokens.tokenizer_path(tokens.WORD_BPE)
    whole = tokens.load(path)
    written = token_files.write_token_files(docs, str(tmp_path), path, 2, files=4)
    found = sorted(token_files.read_token_files(written).collect(), key=lambda r: r.start)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for (doc_id, text), r in zip(ordered, found, strict=True):
        ids = tokens.as_bytes([*whole.encode(text or "", add_special_tokens=False).ids, 2])
        assert tuple(r) == (doc_id, at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    name = written.where("n_tokens > 500").first()
    reader = token_files.Reader(name.file)
    assert len(reader.ids(name.position, name.position + name.n_tokens)) == name.n_tokens
    assert token_files.read_token_files(token_files.write_token_files(documents(spark, []), str(tmp_path), path, 2)).count() == 0

    path = tokens.tokenizer_path(tokens.BYTE_BPE)
    whole = tokens.load(path)
    pieces = packing.pack(docs, path, 1).toPandas()
    sizes = pieces.groupby("sequence_id").length.sum()
    assert sizes.max() <= packing.LENGTH
    by_place = pieces.sort_values(["sequence_id", "offset"])
    assert (by_place.offset == by_place.groupby("sequence_id").length.cumsum() - by_place.length).all()
    long = pieces[pieces.doc_id == 129].sort_values("start")
    want = tokens.as_bytes([*whole.encode(rows[-1][1], add_special_tokens=False).ids, 1])
    assert b"".join(long.ids) == want and [zlib.crc32(x) for x in long.ids] == long.ids_crc32.tolist()
    assert packing.pack(documents(spark, []), path, 1).count() == 0


def test_cuts_are_optimal():
    rnd = random.Random(3)
    for _ in range(30):
        places = sorted({0, *rnd.sample(range(1, 120), 25), 120})
        while any(b - a > 20 for a, b in zip(places, places[1:])):
            places = sorted({*places, *(a + 20 for a, b in zip(places, places[1:]) if b - a > 20)})
        costs = [rnd.choice([0, 2, 5]) for _ in places]
        best = [0] + [10**9] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                windows = -(-(places[j] - places[i]) // 20)
                if windows <= 2:
                    pad = windows * 20 - (places[j] - places[i])
                    best[j] = min(best[j], best[i] + pad + 3 * (windows - 1) + costs[j])
        cuts, cost = packing.best_cuts(places, costs, 20, 3, 2)
        assert cost == best[-1] and cuts[-1] == 120
        assert all(b - a <= 20 for a, b in zip([0, *cuts], cuts))


def test_cuts_look_at_every_place():
    """Any number of windows without a boundary between them, and every sentence end."""
    rnd = random.Random(4)
    for n in [1, 3, 20, 21, 40, *(rnd.randrange(2, 200) for _ in range(60))]:
        costs = [rnd.choice([0, 2, 5, 5, 5, 5]) for _ in range(n + 1)]
        best = [0] + [0] * n
        for j in range(1, n + 1):
            best[j] = min(best[max(j - 20, 0):j]) + 20 + costs[j]
        marked = [0, *(k for k in range(1, n) if costs[k] < 5), n]
        cuts, cost = packing.best_cuts(marked, [costs[k] for k in marked], 20, 5)
        assert cost == best[n] - n and cuts[-1] == n and all(0 < b - a <= 20 for a, b in zip([0, *cuts], cuts))
        assert cost == 20 * len(cuts) - n + sum(costs[c] for c in cuts)
    # four full windows and no padding; with two in a row at most, a window more
    assert packing.best_cuts([0, 1, 21, 41, 61, 80], [0, 5, 5, 5, 5, 0], 20, 3)[1] == 9
    # sentences end at every 25th id, so only some of the ends that stand within 64 ids of each other make full windows
    ids = np.where(np.arange(1, 2_001) % 25 == 0, 1, 0).astype("<u4")
    packer = packing.Packer(np.array([False, True]), 100, 4, 8, 0, False)
    pieces = [*packer.add(7, ids), *packer.cut()]
    assert [p[2] for p in pieces] == [100] * 20 and [p[1] for p in pieces] == [*range(0, 2_000, 100)]


def test_lines(spark):
    line = "the quick brown fox jumped over the seven lazy dogs where they were sleeping near the old stone bridge " * 3
    edited = line[:150] + "X" + line[151:]
    docs = documents(spark, [(1, f"{line}\nshort\nsome other line of text that stands alone"), (2, edited), (3, line),
                             (4, "short"), (5, None), (6, ""), (None, "another line that nobody else has here"), (7, line + "\nnew words in a fresh line here")])
    found = {(r.doc_id, r.line_no): (r.class_doc_id, r.kept) for r in line_dedup.classes(docs).collect()}
    assert found[1, 0] == (1, True) and found[2, 0] == (1, False) and found[3, 0] == (1, False)
    assert found[1, 2] == (1, True) and found[None, 0] == (None, True) and found[7, 1] == (7, True)
    left = {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}
    assert set(left) == {1, 4, 5, 6, 7, None}
    assert left[7] == "new words in a fresh line here" and left[5] is None
    assert line_dedup.classes(documents(spark, [])).count() == 0
    twice = documents(spark, [(1, line), (1, line)])
    assert line_dedup.without_repeats(twice).count() == 1


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    words = item.split()
    edited = " ".join(w if k % 6 != 5 else "other" for k, w in enumerate(words))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (5, item)], "item_id long, text string")
    docs = documents(spark, [(1, f"before {item.upper()}! after"), (2, f"x {edited} y"), (3, "alpha beta gamma delta and nothing else at all"),
                             (4, None), (5, ""), (None, item), (6, "clean words only " * 50)])
    rows = decontaminate.copies(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(d, i) for d in (1, 2, None) for i in (1, 5)}
    exact = next(r for r in rows if r.doc_id == 1 and r.item_id == 1)
    assert (exact.score, exact.start, exact.end) == (1.0, 7, 7 + len(item))
    kept = decontaminate.clean_documents(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == docs.columns
    assert decontaminate.copies(documents(spark, []), bench).count() == 0
    assert decontaminate.copies(docs, bench.limit(0)).count() == 0


def test_alignment_equals_plain_table():
    rnd = random.Random(6)
    for _ in range(50):
        x, y = ([rnd.choice("abcd") for _ in range(rnd.randrange(4, 15))] for _ in range(2))
        h = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, a in enumerate(x, 1):
            for j, b in enumerate(y, 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a == b else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(x, y)[0] == pytest.approx(h.max() / (2 * len(x)))


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<a", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"),
    ("<article><h1>T&eacute;</h1><p>One,  two <b>three</b>\n four.<br>five</p><aside>no</aside></article>", "Té\nOne, two three four. five"),
    ("<body><nav>menu</nav><div class='side-bar sidebar'><p>no, no, no</p></div><div><p>Yes, this is the text.</p></div>"
     "<div id=comments><p>me, too</p></div><footer>f</footer><script>x</script><form><p>name</p></form></body>", "Yes, this is the text."),
])
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>x</p>"), (2, "u", "<p>x</p>")], "page_id long, url string, html string")
    assert sorted(map(tuple, html.extract(pages).collect()), key=str) == sorted([(1, None, "", 0), (None, "u", "x", 1), (2, "u", "x", 1)], key=str)
    assert html.extract(pages.limit(0)).count() == 0


def test_archives(spark, tmp_path):
    rows = [(1, "http://b.example.org/x?y=1#z", "same"), (2, "http://a.example.org/", "same"), (3, None, None), (4, "", ""),
            (5, "http://b.example.org/x?y=1", "é\r\n\r\nlong" * 50), (1, "http://b.example.org/x?y=1#z", "same"), (None, "bad\nurl", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    captures = warc.write_archives(pages, str(tmp_path / "w"))
    shards = warc.write_index(captures, str(tmp_path / "i"), shards=3, block_lines=2)
    read = warc.resolve_revisits(warc.read_records(warc.all_captures(shards))).collect()
    assert len(read) == len(rows)
    for r in read:
        body = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.record_type == ("revisit" if r.page_id in (2, 4) else "response")
        assert r.refers_to == {2: 1, 4: 3}.get(r.page_id)
        assert r.payload is None if r.record_type == "revisit" else r.payload == body
    asked = spark.createDataFrame([("https://B.example.org/x?y=1",), ("http://none/",), (None,)], "url string")
    assert sorted(r.page_id for r in warc.look_up(shards, asked).collect()) == [1, 1, 5]
    empty = warc.archive(spark, pages.limit(0))
    assert warc.all_captures(empty).count() == 0
    assert warc.url_key("http://www.A.org:80/p?q") == "org,a,www)/p?q"


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 32)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 24))
    x = np.concatenate([centres[k % 12] + rng.normal(scale=0.12, size=24) for k in range(300)]).reshape(300, 24)
    x[50:60] = x[50]
    rows = [(i, v.tolist(), i % 3 if i % 7 else None) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [None] * 24, 1), (904, [], 1), (905, [1.0] * 5, 1)]
    found = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    n = np.sqrt((x**2).sum(1))
    label = np.array([r[2] if r[2] is not None else -1 for r in rows[:300]])
    near = (x @ x.T / np.outer(n, n) >= 0.98) & (label[:, None] == label[None, :]) & (label >= 0)[:, None]
    np.fill_diagonal(near, False)
    component = np.arange(300)
    for _ in range(300):
        component = np.array([min(component[i], component[near[i]].min(initial=i)) for i in range(300)])
    assert near.sum() > 100
    assert [found[i].n_links for i in range(300)] == near.sum(1).tolist()
    assert [found[i].component_id for i in range(300)] == component.tolist()
    assert all(found[i].n_links == 0 and found[i].kept for i in range(900, 906))
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_repeated_vector_ids(spark):
    a, b, near_a, near_b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.01, 0.0], [0.0, 1.0, 0.01]
    rows = [(5, a, 0), (9, near_a, 0), (5, b, 1), (7, near_b, 1), (4, near_b, 1), (8, a, 1), (8, a, 1)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    got = sorted(tuple(r) for r in embeddings.near_duplicates(given).collect())
    # 5 is two vectors with links of their own; those of label 1 are in the component of 4
    assert got == [(4, 2, 4, True), (5, 1, 5, True), (5, 2, 4, False), (7, 2, 4, False), (8, 1, 8, True), (8, 1, 8, True), (9, 1, 5, False)]


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_trees(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    constant = quality.fit_trees(x[:10], np.ones(10))
    assert (constant.score(x) > 0.9).all()
    assert quality.fit_trees(x[:0], y[:0]).score(x)[0] == pytest.approx(0.5)


def test_classifiers_on_odd_rows(spark):
    docs = documents(spark, ODD)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        for known in (labels, labels.limit(0)):
            rows = module.score_documents(docs, module.fit(docs, known)).collect()
            assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
            assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    model = quality.fit(docs, labels.limit(0))
    assert quality.accepted(docs, model).count() == len(ODD)


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(9)
    y = rng.random(4000) < 0.2
    votes = np.stack([np.where(rng.random(4000) < a, y, ~y).astype(int) for a in (0.95, 0.9, 0.85, 0.6)], axis=1)
    votes = np.concatenate([votes, votes[:, 3:], votes[:, 3:]], axis=1)  # a bad voter, three times over
    ballots, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    known = np.zeros((len(ballots), 2))
    for i, label in zip(inverse.ravel()[:100], y[:100]):
        known[i, int(label)] += 1
    model = toxicity.fit_label_model(ballots, counts, known)
    assert ((model.posterior(ballots)[inverse.ravel()] > 0.5) == y).mean() > 0.93
    assert model.weights[3] < model.weights[0] and model.correlations[3, 4] > 0.9


def test_line_links_equal_brute_force(spark):
    """Similarity is that of all 8-character shingles, of short, middle and long lines."""
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choices("eeeetaoinshrdlué", k=rnd.randrange(2, 9)))
    rows, pairs = [], []
    for k in range(240):
        line = " ".join(word() for _ in range((7, 22, 120)[k % 3]))
        edited = list(line)
        first = rnd.choice([0, len(line) - 5])  # edits near an end spoil fewer shingles
        for at in rnd.sample(range(first, len(line)), rnd.randrange(1, 2 + min(3, len(line) // 60))):
            edited[at] = "Z"
        pairs.append((line, "".join(edited)))
        rows += [(2 * k, line), (2 * k + 1, pairs[-1][1])]
    found = {r.doc_id: r.class_doc_id for r in line_dedup.classes(documents(spark, rows)).collect()}

    def grams(text):
        return {text[i:i + 8] for i in range(max(1, len(text) - 7))}

    share = [len(a & b) / len(a | b) for x, y in pairs for a, b in [(grams(x), grams(y))]]
    linked = [found[2 * k + 1] == 2 * k for k in range(len(pairs))]
    assert not any(x for x, j in zip(linked, share) if j < 0.8)
    for kind in range(3):
        near = [x for x, j in list(zip(linked, share))[kind::3] if j >= 0.8]
        assert len(near) >= 15 and sum(near) >= 0.95 * len(near)


def test_one_letter_of_a_line(spark):
    line = "we left the house before the rest were there, then the others came here and everyone ate bread near the green trees"
    found = line_dedup.classes(documents(spark, [(1, line), (2, line.replace("house", "hXuse"))])).collect()
    assert {r.class_doc_id for r in found} == {1}


@pytest.mark.parametrize("page", [
    "<!doctype html><html><head><title>T</title><meta charset=utf-8><body><p>The text, whole.</p></body></html>",
    "<html><head><title>T</title><link rel=x href=y>\n<p>The text, whole.</p></html>",
    "<head><style>b{}</style>The text, whole.", "<title>T</title><p>The text, whole.</p>",
    "<html><head><title>T</title></head><p>The text, whole.</p>", "<head><script>1</script><b>The text, whole.</b>",
])
def test_head_without_end(page):
    assert html.main_text(page) == "The text, whole."


def test_siblings_of_the_best_container():
    body = "".join(f"<p>Paragraph {k} of the body, with a comma, and words enough.</p>" for k in range(10))
    page = ("<body><div class=content><h1>Title</h1><p class=lead>The lead.</p><div class=body>" + body + "</div><section>"
            "<h2>More</h2><p>One short section.</p></section><p>Outro</p><ul><li><a href=x>Other page</a></li></ul></div></body>")
    lines = html.main_text(page).split("\n")
    assert lines[:2] == ["Title", "The lead."] and lines[-3:] == ["More", "One short section.", "Outro"] and len(lines) == 15


BODY = "".join(f"<p>Paragraph {k} of the body, with a comma, and words enough.</p>" for k in range(10))


@pytest.mark.parametrize("page, first, last", [
    (f"<div id=wrap><div><h1>Title</h1></div><div><div class=body>{BODY}</div></div><p>Sign-off.</p></div>", ["Title"], ["Sign-off."]),
    (f"<div id=wrap>Before, bare.<div class=body>{BODY}</div>After, <b>bare</b>.</div>", ["Before, bare."], ["After, bare."]),
    (f"<div id=wrap><div>A short lead.</div><div class=body>{BODY}</div><figcaption>A caption.</figcaption></div>",
     ["A short lead."], ["A caption."]),
    (f"<div id=wrap><div class=body>{BODY}</div><div class=sidebar>Other things</div><ul><li><a href=x>Other page</a></li></ul></div>",
     [], []),
    (f"<body><div><h1>Title</h1></div><div class=body>{BODY}</div><div><a href=x>Other page</a> and</div></body>", ["Title"], []),
    (f"<body><div><h1>Title</h1><article>{BODY}</article><div>(c) somebody</div></div></body>", ["Title"], []),
])
def test_what_stands_beside_the_article(page, first, last):
    lines = html.main_text(page).split("\n")
    assert lines == [*first, *[f"Paragraph {k} of the body, with a comma, and words enough." for k in range(10)], *last]


@pytest.mark.parametrize("every", [3, 4, 5])
def test_edited_copies_equal_brute_force(spark, every):
    rnd = random.Random(every)
    words = [f"w{k}" for k in range(400)]
    items = [[rnd.choice(words) for _ in range(n)] for n in (12, 20, 20, 50, 50)]
    rows = []
    for k in range(40):
        text = [rnd.choice(words) for _ in range(60)]
        text[20:20] = [w if i % every != every - 1 else "other" for i, w in enumerate(items[k % 5])]
        rows.append((k, " ".join(text)))
    rows += [(100 + k, " ".join(w)) for k, w in enumerate(items * 4)]  # whole copies make the n-grams frequent
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    want = {(d, i) for d, t in rows for i, w in enumerate(items) if decontaminate.align(w, t.split())[0] >= decontaminate.SCORE}
    assert {(r.doc_id, r.item_id) for r in decontaminate.copies(documents(spark, rows), bench).collect()} == want
    assert len(want) >= 60


def test_unlabelled_insults_and_posteriors(spark, monkeypatch):
    """Insults and patterns that no labelled row has raise the score; targets are the label model's."""
    texts = [(k, ("zorg " if k % 4 == 0 else "calm ") + f"plain words number {k}") for k in range(200)]
    docs = documents(spark, [*texts, (1000, "plain words, imbecile"), (1001, "go to hell now"), (1002, "plain words")])
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int")
    seen, fit_linear, fit_model = {}, toxicity.fit_linear, toxicity.fit_label_model

    def label_model(distinct, counts, known):
        seen["model"], seen["ballots"] = fit_model(distinct, counts, known), distinct
        return seen["model"]

    def linear(rows, target, names, **more):
        seen["target"] = target
        return fit_linear(rows, target, names, **more)

    monkeypatch.setattr(toxicity, "fit_label_model", label_model)
    monkeypatch.setattr(toxicity, "fit_linear", linear)
    model = toxicity.fit(docs, labels)
    assert set(seen["target"]) == set(seen["model"].posterior(seen["ballots"]))
    clean = model.score("plain words")
    assert model.score("plain words, imbecile") > 0.5 and model.score("go to hell now") > 0.5
    assert model.score("zorg again") > 0.5 > clean


def test_equal_short_lines(spark):
    docs = documents(spark, [(1, "All rights reserved\nok\n \u3000\n\n你好"), (2, "你好\nok\nAll rights reserved"), (3, "All rights reserve")])
    found = {(r.doc_id, r.line_no): r.class_doc_id for r in line_dedup.classes(docs).collect()}
    assert found == {(1, 0): 1, (1, 1): 1, (1, 4): 1, (2, 0): 1, (2, 1): 1, (2, 2): 1, (3, 0): 3}
    assert {r.doc_id for r in line_dedup.without_repeats(docs, exact_chars=1).collect()} == {1, 3}


def test_lines_of_one_template_equal_brute_force(spark):
    """Lines that share bands with a hub that most of them are not near."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=7))
    head, tail = " ".join(word() for _ in range(12)), " ".join(word() for _ in range(8))
    lines = []
    for k in range(60):
        own = [word() for _ in range(rnd.choice([3, 6, 10]))]
        for _ in range(rnd.choice([1, 1, 3])):
            lines.append(f"{head} {' '.join([*own[:-1], word()] if len(own) > 3 else own)} {tail}")
    lines += [head, head + " and", tail, lines[0][20:], lines[5][:90]]
    lines = sorted(set(lines))

    def grams(text):
        return {text[i:i + 8] for i in range(max(1, len(text) - 7))}

    sets = [grams(x) for x in lines]
    near = {(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    hub = lines.index(max(lines, key=len))
    first = spark.createDataFrame(
        [(i, hub, lines[i].encode(), lines[hub].encode(), (max(i, hub), min(i, hub)) in near) for i in range(len(lines)) if i != hub],
        "a long, b long, key_a binary, key_b binary, near boolean",
    )
    texts = spark.createDataFrame([(i, x.encode(), x) for i, x in enumerate(lines)], "id long, key binary, line string")
    none = spark.createDataFrame([], "key binary, component binary")
    found = {tuple(sorted((r.a, r.b), reverse=True)) for r in line_dedup.crossing(first, texts, none, 0.8).collect()}
    assert {p for p in near if hub not in p} <= found
    assert len(found) < len(lines) * (len(lines) - 1) / 8 and len(near) > 20
    # links that are known already are not looked for again
    one = spark.createDataFrame([(x.encode(), b"x") for x in lines], "key binary, component binary")
    assert line_dedup.crossing(first, texts, one, 0.8).count() == 0
    classes = line_dedup.classes(documents(spark, list(enumerate(lines))))
    got = {r.doc_id: r.class_doc_id for r in classes.collect()}
    parent = list(range(len(lines)))
    for _ in lines:
        for i, j in near:
            parent[i] = parent[j] = min(parent[i], parent[j])
    assert sum(got[i] != parent[i] for i in range(len(lines))) <= 0.05 * len(lines)


def test_lines_far_from_their_hub_meet_by_what_they_share(spark):
    """Many lines near to nobody under one hub, some families of near lines, and some that are all near to what is usual."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=7))
    base = [word() for _ in range(60)]

    def edited(words, count, places=range(60)):
        out = list(words)
        for at in rnd.sample(list(places), count):
            out[at] = word()
        return out

    lines = [edited(base, 10) for _ in range(150)]
    for head in lines[:6]:
        lines += [edited(head, 2) for _ in range(3)]
    lines += [edited(base, 1) for _ in range(40)]
    lines = [" ".join(x) for x in lines]
    hub = len(lines)
    lines.append(" ".join([*base[:45], *(word() for _ in range(15))]))

    def grams(text):
        return {text[i:i + 8] for i in range(len(text) - 7)}

    sets = [grams(x) for x in lines]
    near = {(i, j) for i in range(hub) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert not any(len(s & sets[hub]) >= 0.8 * len(s | sets[hub]) for s in sets[:hub]) and len(near) > 700
    first = spark.createDataFrame([(i, hub, lines[i].encode(), lines[hub].encode(), False) for i in range(hub)],
                                  "a long, b long, key_a binary, key_b binary, near boolean")
    texts = spark.createDataFrame([(i, x.encode(), x) for i, x in enumerate(lines)], "id long, key binary, line string")
    none = spark.createDataFrame([], "key binary, component binary")
    found = {tuple(sorted((r.a, r.b), reverse=True)) for r in line_dedup.crossing(first, texts, none, 0.8).collect()}

    def roots(pairs):
        parent = list(range(hub))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in pairs:
            parent[max(root(i), root(j))] = min(root(i), root(j))
        return [root(x) for x in range(hub)]

    assert roots(near & found) == roots(near) and len(set(roots(near))) > 100
    assert len(found) < 1_000  # of 21,528 pairs, and fewer than the near ones alone with those of the usual lines
