"""Repairs against exhaustive search, and whole conversations against a plain loop."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tidewatch.llm import conversations
from tidewatch.llm.conversations import Way, search

ROWS = "conv_id long, turn long, role string, text string, run string, key int, cost string, kind double"
CODES = [i + f for i in "suax" for f in "0bdt"]


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2.0) for r in rows], ROWS)


def cheapest(codes):
    """Uniform-cost search over all edits; of equal cost the least audit."""
    heap, best, seen = [(0, "", 0, "")], None, {}
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if i == len(codes) and re.fullmatch(r"(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
            continue
        if seen.setdefault((i, roles[-1:]), cost) < cost:
            continue
        steps = [(3, "I", i, x) for x in "ua"]
        if i < len(codes):
            initial, fault = codes[i]
            steps.append((4, "D", i + 1, ""))
            if fault not in "bd":
                extra = 3 * (fault == "t")
                steps += [(extra, "K", i + 1, initial), *((3 + extra, "R", i + 1, x) for x in "ua")]
        for price, edit, j, x in steps:
            if re.fullmatch(r"s?(ua)*u?", roles + x):
                heapq.heappush(heap, (cost + price, audit + edit, j, roles + x))
    return best


def test_search_equals_exhaustive():
    rnd = random.Random(1)
    for _ in range(1500):
        pool = CODES if rnd.random() < 0.5 else ["u0", "a0", "s0", "ut"]
        codes = tuple(rnd.choice(pool) for _ in range(rnd.randrange(0, 8)))
        assert search(codes) == cheapest(codes), codes


def test_runs_compose_to_the_same_way():
    rnd = random.Random(2)
    for _ in range(150):
        codes = tuple(rnd.choice(CODES) for _ in range(rnd.randrange(4, 24)))
        a, b = sorted(rnd.sample(range(1, len(codes)), 2))
        way = Way()
        for part in (codes[:a], codes[a:b], codes[b:]):
            way.add({(x, z): w for x in range(4) for z in range(4) if (w := search(part, x, (z,)))})
        cost, steps = way.finished()
        assert (cost, "".join(audit for _, audit in steps)) == search(codes) and len(steps) == 3


def by_hand(rows, damage=True):
    out = {}
    for conv in {r[0] for r in rows}:
        alive = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            shown = lambda v: " " if v is None else v
            kind = zlib.crc32(f"{shown(c)}:{shown(turn)}".encode()) % 20 if damage else 9
            role, text = shown(role), shown(text)
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            alive += [] if kind == 0 else [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
        alive.sort()
        faults, seen = [], set()
        for *_, role, text in alive:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not solid else "d" if (role, text) in seen else "0" if solid[-1] in ".!?" else "t")
            seen.add((role, text))
        turns = [t for known, t, *_ in alive if known]
        initials = [r[2][:1] for r in alive]
        cost, audit = search(tuple((i if i and i in "sua" else "x") + f for i, f in zip(initials, faults)))
        roles, lines, at = "", [], 0
        for edit in audit:
            expect = "assistant" if roles[-1:] == "u" else "user"
            if edit == "I":
                lines.append(f"{expect}:")
            else:
                *_, role, text = alive[at]
                at += 1
                if edit == "D":
                    continue
                lines.append(f"{role if edit == 'K' else expect}:{text}")
            roles += lines[-1][0]
        assert re.fullmatch(r"(s?(ua)+)?", roles)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in "bdt"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def sample(seed, sizes):
    rnd = random.Random(seed)
    rows = []
    for conv, n in sizes.items():
        for turn in range(n):
            if rnd.random() < 0.1:
                continue
            role = rnd.choice(["user", "assistant"]) if rnd.random() < 0.2 else ["user", "assistant"][turn % 2]
            text = rnd.choice(["Yes.", "No!", "É fine? ", "cut off", " \t", "one. two", "same."]) if rnd.random() < 0.5 else f"text {turn}."
            rows.append((conv, turn, "system" if turn == 0 and rnd.random() < 0.5 else role, text))
    return rows


ODD = [(9001, None, "user", "a."), (9001, None, "assistant", None), (9001, 4, None, "b."), (9001, 4, "", "b."), (None, 1, "user", "q?"),
       (None, None, None, None), (9002, 3, "user", "x."), (9002, 3, "user", "x."), (9002, 3, "user", "x."), (9003, 0, "tool", "z."),
       (9004, 5, "system", "only."), (9005, -3, "user", "w" * 200_000), (9005, 900_000, "assistant", "fine.\n")]


@pytest.mark.parametrize("damage", [True, False])
def test_equals_plain_loop(spark, damage):
    rows = sample(3, {k: k % 12 for k in range(150)}) + ODD
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(table_of(spark, rows), damage=damage).collect()}
    assert got == by_hand(rows, damage)


def test_long_conversations_in_runs(spark, monkeypatch):
    rows = sample(5, {1: 700, 2: 90, 3: 10, 4: 31}) + ODD
    want = by_hand(rows)
    for turns, size, block in ((16, 5, 1 << 20), (64, 64, 40)):
        monkeypatch.setattr(conversations, "RUN_TURNS", turns)
        monkeypatch.setattr(conversations, "RUN_ROWS", size)
        monkeypatch.setattr(conversations, "BLOCK", block)
        got = {r[0]: tuple(r)[1:] for r in conversations.repair(table_of(spark, rows)).collect()}
        assert got == want


def test_lost_rows_and_empty_table(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    (row,) = conversations.repair(table_of(spark, [(7, turn, "user", "hi.")])).collect()
    assert tuple(row) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert conversations.repair(table_of(spark, [])).count() == 0
