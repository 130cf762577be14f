"""Secrets in texts, and credentials whose parts stand apart.

Some strings are secrets by their form alone. Others are weak: a user name, a short password, a bare
token or the address of a service says little by itself. Weak ones are reported where their other
parts are near. Parts are joined by overlap of intervals: each identifier reaches REACH code points to
both sides within its scope (lines without a blank one between them), and is joined with the secrets in that range by the
bins that the range touches. A bin has a bounded number of parts, whatever the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, map_texts, stored

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Kinds whose spans stand by themselves, in the order that equal starts have; weak kinds follow.
BASE = ("assign", "access", "hex")
#: Weak parts: a name and a value. The span is that of the value.
USER = re.compile(
    r"""\b(?:user_?(?:name|id)?|login|account|client_?id|key_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""",
    re.IGNORECASE | re.ASCII,
)
SHORT = re.compile(
    r"""\b(?:password|passwd|passphrase|pwd|pass|pin|secret(?:_?key)?|client_?secret|auth|token|api_?key|private_?key)["']?\x20*[:=]\x20*["']?([^\s"',;]{4,})""",
    re.IGNORECASE | re.ASCII,
)
BARE = re.compile(r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", re.ASCII)
ENDPOINT = re.compile(
    r"""\b(?:[a-z][a-z0-9+]{1,11}://[A-Za-z0-9][^\s"'<>,;]{2,}|(?:host(?:name)?|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9.:_-]{2,})""",
    re.ASCII,
)
WEAK = ("user", "short", "bare", "endpoint")
KINDS = BASE + WEAK
#: What a text must have for a weak identifier; without any there is nothing to link.
NAMES = re.compile(r"user|login|account|client_?id|key|AKIA", re.IGNORECASE | re.ASCII)
IDENTIFIERS, SECRETS, ENDPOINTS = ("access", "user"), ("assign", "short", "bare"), ("endpoint",)
SCOPE_END = re.compile(r"\n[ \t\r]*\n")
#: Code points between the parts of one credential at most.
REACH = 400
SCANNED = pa.schema([
    ("doc_id", pa.int64()), ("doc_key", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
    ("base", pa.string()),
    ("parts", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int64())]))),
])
SCANNED_TYPE = ("doc_id long, doc_key long, n_assign long, n_access long, n_hex long, base string, "
                "parts array<struct<kind:int,start:bigint,end:bigint,scope:bigint>>")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, number of the kind and end of strings that are secrets by their form, in order."""
    found = [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    found += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted((s, k, e) for s, e, k in found)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that no strong one overlaps, nor one of a kind before theirs."""
    taken = sorted((s, e) for s, _, e in base)
    out: list[tuple[int, int, int]] = []
    for number, (pattern, group) in enumerate(((USER, 1), (SHORT, 1), (BARE, 0), (ENDPOINT, 0)), len(BASE)):
        k, new = 0, []
        for m in pattern.finditer(text):
            s, e = m.span(group)
            while k < len(taken) and taken[k][1] <= s:
                k += 1
            if k == len(taken) or taken[k][0] >= e:
                new.append((s, number, e))
        out += new
        if new:
            taken = merged(taken + [(s, e) for s, _, e in new])
    return sorted(out)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def parts_of(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Kind, start, end and scope of all parts that links are made of; none without an identifier and a secret."""
    if not NAMES.search(text):
        return []
    parts = sorted([p for p in base if KINDS[p[1]] != "hex"] + weak_spans(text, merged_base(base)))
    kinds = {KINDS[k] for _, k, _ in parts}
    if kinds.isdisjoint(IDENTIFIERS) or kinds.isdisjoint(SECRETS):
        return []
    ends = [m.end() for m in SCOPE_END.finditer(text)]
    out, scope = [], 0
    for s, k, e in parts:
        while scope < len(ends) and ends[scope] <= s:
            scope += 1
        out.append((k, s, e, scope))
    return out


def merged_base(base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    return [(s, 0, e) for s, e in merged([(s, e) for s, _, e in base])]


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row's strong spans as text and its parts; one pass over whole texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, key, text in zip(*(c.to_pylist() for c in b.columns)):
                base = base_spans(text)
                counts = [0, 0, 0]
                for _, k, _ in base:
                    counts[k] += 1
                parts = [dict(zip(("kind", "start", "end", "scope"), p)) for p in parts_of(text, base)]
                out.append((doc_id, key, *counts, ",".join(f"{BASE[k]}:{s}:{e}" for s, k, e in base), parts))
            yield batch(SCANNED, *(zip(*out) if out else [()] * len(SCANNED)))

    return map_texts(rows, run, SCANNED_TYPE)


def kind_in(column: str, kinds: tuple[str, ...]) -> Column:
    return F.col(column).isin([KINDS.index(k) for k in kinds])


def near(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of parts of one scope with at most REACH code points between them.

    The left part's range is entered in every bin it touches, the right part in that of its start.
    """
    place = ["doc_id", "doc_key", "scope"]
    reach = left.withColumn("bin", F.explode(F.sequence(
        F.floor((F.col("start") - 2 * REACH) / REACH), F.floor((F.col("end") + REACH) / REACH)
    )))
    other = right.withColumn("bin", F.floor(F.col("start") / REACH)).select(
        *[F.col(c).alias(f"_{c}") for c in [*place, "bin"]], F.struct("start", "end", "kind").alias("other")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place] + [F.col("bin") == F.col("_bin")]
    joined = reach.join(other, on=same)
    gap = F.greatest(F.col("other.start") - F.col("end"), F.col("start") - F.col("other.end"), F.lit(0))
    return joined.withColumn("gap", gap).where(F.col("gap") <= REACH).select(*place, "start", "end", "kind", "other", "gap")


def links(parts: DataFrame) -> DataFrame:
    """Credentials: each secret with its nearest identifier, and their nearest endpoint where one is in reach.

    parts: doc_id, doc_key, kind (a number), start, end, scope. Returns doc_id, doc_key, scope, secret, identifier and
    endpoint (null: none), each a struct of start, end and kind. Ties: the first in the text. Every identifier within
    reach of a secret is in a row as well, with the secret nearest to it.
    """
    place = ["doc_id", "doc_key", "scope"]
    secrets, names = parts.where(kind_in("kind", SECRETS)), parts.where(kind_in("kind", IDENTIFIERS))
    pairs = near(names, secrets)
    nearest = F.min(F.struct("gap", "one")).alias("m")
    first = (
        pairs.withColumn("one", F.struct("start", "end", "kind")).groupBy(*place, "other").agg(nearest)
        .select(*place, F.col("other").alias("secret"), F.col("m.one").alias("identifier"))
    )
    second = (
        pairs.withColumn("one", F.col("other")).groupBy(*place, F.struct("start", "end", "kind").alias("identifier"))
        .agg(nearest).select(*place, F.col("m.one").alias("secret"), "identifier")
    )
    both = first.unionByName(second).distinct()
    around = both.withColumns({
        "start": F.least("secret.start", "identifier.start"), "end": F.greatest("secret.end", "identifier.end"),
        "kind": F.lit(0),
    })
    met = near(around.select(*place, "start", "end", "kind"), parts.where(kind_in("kind", ENDPOINTS)))
    met = met.groupBy(*[F.col(c).alias(f"_{c}") for c in [*place, "start", "end"]]).agg(
        F.min(F.struct("gap", "other"))["other"].alias("endpoint")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*place, "start", "end"]]
    return around.join(met, on=same, how="left").select(*place, "secret", "identifier", "endpoint")


def kind_name(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)


def credentials(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per credential found: doc_id, secret, identifier and endpoint (null: none near), each a struct of
    kind, start, end and the text itself. Documents without one have no rows; repeated rows have theirs once."""
    found = links(distinct_parts(stored(scanned(docs, id_col, text_col), "secrets")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_key"), text.alias("_text")).distinct()
    joined = found.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc_key") == F.col("_key")))

    def shown(part: str) -> Column:
        p = F.col(part)
        cut = F.substring(F.col("_text"), p["start"].cast("int") + 1, (p["end"] - p["start"]).cast("int"))
        return F.when(p.isNotNull(), F.struct(
            kind_name(p["kind"]).alias("kind"), p["start"].alias("start"), p["end"].alias("end"), cut.alias("text")
        )).alias(part)

    return joined.select("doc_id", *[shown(p) for p in ("secret", "identifier", "endpoint")])


def distinct_parts(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("parts") > 0).select("doc_id", "doc_key", F.explode("parts").alias("p")).select(
        "doc_id", "doc_key", "p.*"
    ).distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_linked.

    Strong spans (assign, access, hex) are always reported. Weak ones, user, short, bare and endpoint, are
    where a credential joins them with their other parts: an identifier and a secret within REACH
    code points in one scope, and an endpoint with both. spans has `kind:start:end` by start, then
    kind, comma-joined, in code points; base_sha256 is the hash of the strong ones joined likewise; n_linked counts the
    weak ones. A null text is empty; empty texts have no spans. Repeated rows stay and get the same answer; null
    ids stay null. No rows give no rows. Other columns are not looked at.
    """
    rows = stored(scanned(docs, id_col, text_col), "secrets")
    found = links(distinct_parts(rows))
    used = found.select("doc_id", "doc_key", F.explode(F.array("secret", "identifier", "endpoint")).alias("p"))
    added = used.where(F.col("p").isNotNull() & kind_in("p.kind", WEAK)).distinct().groupBy("doc_id", "doc_key").agg(
        F.collect_list(F.struct("p.start", "p.kind", "p.end")).alias("weak")
    )
    joined = rows.join(
        added.withColumnsRenamed({"doc_id": "_id", "doc_key": "_key"}),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc_key") == F.col("_key")), "left",
    )
    strong = F.transform(F.split("base", ","), lambda s: F.struct(
        F.split(s, ":")[1].cast("long").alias("start"),
        (F.array_position(F.array(*[F.lit(k) for k in BASE]), F.split(s, ":")[0]) - 1).cast("int").alias("kind"),
        F.split(s, ":")[2].cast("long").alias("end"),
    ))
    both = F.when(F.col("base") == "", F.col("weak")).otherwise(F.concat(strong, "weak"))
    text = F.array_join(F.transform(F.sort_array(both), lambda p: F.concat_ws(
        ":", kind_name(p["kind"]), p["start"].cast("string"), p["end"].cast("string")
    )), ",")
    return joined.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"),
        F.when(F.col("weak").isNull(), F.col("base")).otherwise(text).alias("spans"),
        F.coalesce(F.size("weak"), F.lit(0)).cast("long").alias("n_linked"),
    )
