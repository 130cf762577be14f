"""Secrets against the plain patterns, and links of parts against all pairs."""

from __future__ import annotations

import hashlib
import random
import re

from tidewatch.llm import secret_parts

DOCS = "doc_id long, text string, kind string, start double, bin int, parts string"
KEY = "AKIA" + "Z9" * 8
BARE = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKE9"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1.0, 2, "y") for i, t in rows], DOCS)


def plain(text):
    """The base spans as the contract words them."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


ODD = [
    (1, None), (2, ""), (3, "É password = 'abcdefghijkl' token:short api_key=" + "0123456789abcdef" * 2),
    (4, "PaſſwORD=abcdefghijklm toKen=abcdefghijklm"), (5, f"{KEY}AKIA{KEY} AKIAZ {KEY[:17]}"),
    (6, "password=token:abcdefghijklmnop secret   =  \"x+/_.=-x+/_.=-"), (6, "password=token:abcdefghijklmnop secret   =  \"x+/_.=-x+/_.=-"),
    (None, "a" * 300_000 + "\n" + "token=0123456789abcdef " * 5_000), (7, "tokentokentoken==abcabcabcabc"),
]


def test_base_spans(spark):
    rows = secret_parts.scan(documents(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    texts = {(i, hashlib.sha256(plain(t or "").encode()).hexdigest()) for i, t in ODD}
    assert {(r.doc_id, r.base_sha256) for r in rows} == texts
    want = {i: plain(t or "") for i, t in ODD}
    for r in rows:
        assert r.spans == want[r.doc_id] and r.n_linked == 0
        assert [r.n_assign, r.n_access, r.n_hex] == [want[r.doc_id].count(k + ":") for k in ("assign", "access", "hex")]
    assert secret_parts.scan(documents(spark, [])).count() == 0


def test_weak_parts_need_each_other(spark):
    far = "x " * secret_parts.REACH
    rows = [
        (1, "user: joe\npassword: hunter2\nhost: db.internal:5432"), (2, "password: hunter2"), (3, "user: joe"),
        (4, f"user: joe\n\npassword: hunter2"), (5, f"user: joe {far} password: hunter2"),
        (6, f"{KEY}\n{BARE}\nhttps://s3.example.com/bucket"), (7, f"{BARE} https://s3.example.com"),
        (8, f"login=joe, password=abcdefghijklmnop"), (9, "https://a.example user of https://b.example"),
    ]
    got = {r.doc_id: r.spans for r in secret_parts.scan(documents(spark, rows * 2)).collect()}
    assert got[1] == "user:6:9,short:20:27,endpoint:28:50"
    assert got[6] == "access:0:20,bare:21:61,endpoint:62:91"
    assert got[8] == "user:6:9,assign:11:36"
    assert {got[k] for k in (2, 3, 4, 5, 7, 9)} == {""}
    found = secret_parts.credentials(documents(spark, rows * 2)).collect()
    assert sorted((r.doc_id, r.identifier.text, r.secret.text, r.endpoint and r.endpoint.text) for r in found) == [
        (1, "joe", "hunter2", "host: db.internal:5432"), (6, KEY, BARE, "https://s3.example.com/bucket"),
        (8, "joe", "password=abcdefghijklmnop", None),
    ]


def test_links_equal_all_pairs(spark):
    rnd = random.Random(8)
    rows = []
    for d in range(12):
        at = 0
        for _ in range(rnd.randrange(2, 60)):
            at += rnd.randrange(1, 300)
            size = rnd.randrange(1, 30)
            rows.append((d, d, rnd.choice([0, 1, 3, 4, 5, 6]), at, at + size, at // 3_000))
            at += size
    parts = spark.createDataFrame(rows, "doc_id long, doc_key long, kind int, start long, end long, scope long")
    got = {(r.doc_id, tuple(r.secret), tuple(r.identifier), r.endpoint and tuple(r.endpoint)) for r in secret_parts.links(parts).collect()}
    kinds = secret_parts.KINDS

    def gap(p, q):
        return max(q[0] - p[1], p[0] - q[1], 0)

    want = set()
    for d in range(12):
        for scope in {r[5] for r in rows if r[0] == d}:
            own = [(s, e, k) for i, _, k, s, e, c in rows if i == d and c == scope]
            names = [p for p in own if kinds[p[2]] in secret_parts.IDENTIFIERS]
            secrets = [p for p in own if kinds[p[2]] in secret_parts.SECRETS]
            pairs = {(min(((gap(n, s), n) for n in names))[1], s) for s in secrets if any(gap(n, s) <= secret_parts.REACH for n in names)}
            pairs |= {(n, min(((gap(n, s), s) for s in secrets))[1]) for n in names if any(gap(n, s) <= secret_parts.REACH for s in secrets)}
            for n, s in pairs:
                whole = (min(n[0], s[0]), max(n[1], s[1]))
                near = [(gap(whole, p), p) for p in own if kinds[p[2]] == "endpoint" and gap(whole, p) <= secret_parts.REACH]
                want.add((d, s, n, min(near)[1] if near else None))
    assert got == want and len(got) > 30
