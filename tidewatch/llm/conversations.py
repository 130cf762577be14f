"""Repair of conversations by cheapest edits, found by bidirectional Dijkstra over the edit lattice.

A node of the lattice is a number of rows done and what the output ends with: nothing yet, the system
row, a user row or an assistant row. Edges keep, rerole or delete the next row or insert one. Two heaps
grow from both ends; once the sum of their least costs passes the best path, every
edge between the two settled sides that completes a path of that cost is looked at, and the least
concatenated audit is taken.

Conversations are cut into runs of rows by turn. A run of a long conversation is searched from each
state to each state in a task of its own; the results of its runs are composed in order.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, map_texts, stored

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: States of the output by their number: empty, after the system row, after user, after assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES, FINAL = (EMPTY, SYSTEM, USER, ASSISTANT), (EMPTY, ASSISTANT)
#: The role that has to follow, and the state then.
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Role initials that may follow each other.
LEGAL = {"su", "ua", "au"}
#: Turns, and rows, that one run of a conversation spans.
RUN_TURNS, RUN_ROWS = 4096, 4096
#: Different sequences of rows whose repair a task remembers.
MEMO = 20_000
#: Characters of rows handed on at a time.
BLOCK = 1 << 20

#: Faults in the codes of rows; a row's code is its role initial (x: none of s, u, a) and its fault.
SOUND, BLANK, DUPLICATE, TRUNCATED = "0", "b", "d", "t"


def kept_state(state: int, initial: str) -> int | None:
    """The state after a row that is kept, or None where it can't stand."""
    if initial == "s":
        return SYSTEM if state == EMPTY else None
    if initial == ("a" if state == USER else "u"):
        return NEXT[state]
    return None


def steps(code: str) -> list[list[tuple[int, int, str]]]:
    """For each state, what a row with this code may lead to: state, cost, edit."""
    initial, fault = code
    out = []
    for state in STATES:
        edges = [(state, DELETE_COST, DELETE)]
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED_COST if fault == TRUNCATED else 0
            kept = kept_state(state, initial)
            if kept is not None:
                edges.append((kept, extra, KEEP))
            edges.append((NEXT[state], REROLE_COST + extra, REROLE))
        out.append(edges)
    return out


STEPS = {i + f: steps(i + f) for i in "suax" for f in (SOUND, BLANK, DUPLICATE, TRUNCATED)}


class Side:
    """One of the two searches: settled and open nodes with their cost and audit so far."""

    def __init__(self, sources: list[tuple[int, int]], sign: int):
        self.sign = sign  # nodes nearer to the source come first among equal costs
        self.label = {node: (0, "") for node in sources}
        self.heap = [(0, sign * node[0], node[1]) for node in sources]
        heapq.heapify(self.heap)
        self.settled: dict[tuple[int, int], tuple[int, str]] = {}

    def least(self) -> float:
        while self.heap and (abs(self.heap[0][1]), self.heap[0][2]) in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def pop(self) -> tuple[tuple[int, int], int, str]:
        _, place, state = heapq.heappop(self.heap)
        node = (abs(place), state)
        self.settled[node] = self.label.pop(node)
        return node, *self.settled[node]

    def reach(self, node: tuple[int, int], cost: int, audit: str) -> None:
        if node in self.settled:
            return
        before = self.label.get(node)
        if before is None or (cost, audit) < before:
            self.label[node] = (cost, audit)
            if before is None or cost < before[0]:
                heapq.heappush(self.heap, (cost, self.sign * node[0], node[1]))


def edges_from(codes: tuple[str, ...], node: tuple[int, int]) -> Iterator[tuple[tuple[int, int], int, str]]:
    i, state = node
    yield (i, NEXT[state]), INSERT_COST, INSERT
    if i < len(codes):
        for after, cost, edit in STEPS[codes[i]][state]:
            yield (i + 1, after), cost, edit


#: For each code, what leads to each state.
INTO = {
    code: [[(before, cost, edit) for before in STATES for after, cost, edit in out[before] if after == state] for state in STATES]
    for code, out in STEPS.items()
}
INSERTED_INTO = [[s for s in STATES if NEXT[s] == state] for state in STATES]


def edges_into(codes: tuple[str, ...], node: tuple[int, int]) -> Iterator[tuple[tuple[int, int], int, str]]:
    i, state = node
    for before in INSERTED_INTO[state]:
        yield (i, before), INSERT_COST, INSERT
    if i:
        for before, cost, edit in INTO[codes[i - 1]][state]:
            yield (i - 1, before), cost, edit


def search(codes: tuple[str, ...], start: int = EMPTY, ends: tuple[int, ...] = FINAL) -> tuple[int, str] | None:
    """Least cost of edits from a state to one of the ends, and the least of the audits of that cost.

    No audit of equal cost to the same node is the beginning of another (it would have further
    inserts, which cost), so the least audit of each half gives the least of the whole. None where no path leads there.
    """
    n = len(codes)
    front, back = Side([(0, start)], 1), Side([(n, e) for e in ends], -1)
    best = float("inf")
    while (a := front.least()) + (b := back.least()) <= best and a + b < float("inf"):
        side, other, edges = (front, back, edges_from) if a <= b else (back, front, edges_into)
        node, cost, audit = side.pop()
        if node in other.settled:
            best = min(best, cost + other.settled[node][0])
        for after, price, edit in edges(codes, node):
            side.reach(after, cost + price, audit + edit if side is front else edit + audit)
            met = other.settled.get(after)
            if met is not None:
                best = min(best, cost + price + met[0])
    if best == float("inf"):
        return None
    audits = [a + back.settled[node][1] for node, (cost, a) in front.settled.items()
              if node in back.settled and cost + back.settled[node][0] == best]
    for node, (cost, audit) in front.settled.items():
        for after, price, edit in edges_from(codes, node):
            met = back.settled.get(after)
            if met is not None and cost + price + met[0] == best:
                audits.append(audit + edit + met[1])
    return int(best), min(audits)


def repaired(audit: str, state: int, rows: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], int]:
    """Role and text after the edits, and the state then."""
    out, at = [], 0
    for edit in audit:
        if edit == INSERT:
            state = NEXT[state]
            out.append((ROLE[state], ""))
            continue
        role, text = rows[at]
        at += 1
        if edit == KEEP:
            state = SYSTEM if role[:1] == "s" else NEXT[state]
            out.append((role, text))
        elif edit == REROLE:
            state = NEXT[state]
            out.append((ROLE[state], text))
    return out, state


class Way:
    """The way through the runs of a conversation, composed run by run.

    For each state the least cost, then the least audit so far; what all of them begin with is kept once.
    """

    def __init__(self):
        self.common: list[tuple[int, str]] = []
        self.reach: dict[int, tuple[int, str, list]] = {EMPTY: (0, "", [])}

    def add(self, run: dict[tuple[int, int], tuple[int, str]]) -> None:
        ahead: dict[int, tuple[int, str, list]] = {}
        for (a, z), (cost, audit) in run.items():
            if a in self.reach:
                before = self.reach[a]
                found = (before[0] + cost, before[1] + audit)
                if z not in ahead or found < ahead[z][:2]:
                    ahead[z] = (*found, [*before[2], (a, audit)])
        while len({way[0] if way else None for *_, way in ahead.values()} - {None}) == 1 and all(len(w) > 1 for *_, w in ahead.values()):
            first = next(iter(ahead.values()))[2][0]
            self.common.append(first)
            ahead = {z: (c, audit[len(first[1]):], way[1:]) for z, (c, audit, way) in ahead.items()}
        self.reach = ahead

    def finished(self) -> tuple[int, list[tuple[int, str]]]:
        """The cost; the state before, and the audit, of each run."""
        cost, _, way = min((r for z, r in self.reach.items() if z in FINAL), key=lambda r: r[:2])
        return cost, self.common + way


def null_safe(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of rows after the damage that their id and turn decide."""
    kind = F.crc32(F.concat(null_safe("conv_id"), F.lit(":"), null_safe("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.withColumns({"role": null_safe("role"), "text": null_safe("text")}).where(kind != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def with_order(rows: DataFrame) -> DataFrame:
    """Adds run (the span of turns, null for none), key (128 bits of role and text), again (the same role and
    text stand at an earlier turn) and long (the conversation has more than one run)."""
    rows = rows.withColumns({
        "run": F.floor(F.col("turn") / RUN_TURNS),
        "key": F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))),
    })
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = rows.groupBy("conv_id", "key").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    said = said.where("first <> last").select(
        F.col("conv_id").alias("c"), F.col("key").alias("k"), "first"
    )
    span = F.struct(F.col("run").isNotNull().alias("known"), "run")
    long = rows.groupBy("conv_id").agg(F.min(span).alias("a"), F.max(span).alias("z"), F.sum("copies").alias("n"))
    long = long.where((F.col("a") != F.col("z")) | (F.col("n") > RUN_ROWS)).select(F.col("conv_id").alias("lc"), F.lit(True).alias("long"))
    rows = rows.join(said, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left")
    rows = rows.withColumn("again", F.coalesce(F.col("first") != order, F.lit(False))).drop("c", "k", "first")
    return rows.join(long, F.col("conv_id").eqNullSafe(F.col("lc")), "left").withColumn(
        "long", F.coalesce("long", F.lit(False))
    ).drop("lc")


WHITE = " \t\n\x0b\x0c\r"
RUNS_SCHEMA = "conv_id long, kind int, run long, part long, data binary"
RUNS = pa.schema([("conv_id", pa.int64()), ("kind", pa.int32()), ("run", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])
OUT = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                 ("audit", pa.string()), ("repaired_sha256", pa.string())])
OUT_SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
              "repaired_sha256 string")


def fault_of(text: str, again: bool) -> str:
    last = text.rstrip(WHITE)[-1:]
    return BLANK if not last else DUPLICATE if again else SOUND if last in ".!?" else TRUNCATED


class Tally:
    """What is counted over the rows of a conversation, in order; adds up over its runs."""

    def __init__(self):
        self.turns, self.low, self.high, self.last_turn = 0, None, None, None
        self.faults = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
        self.illegal, self.first, self.last, self.rows = 0, None, None, 0

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None:
            self.turns += turn != self.last_turn
            self.low, self.high, self.last_turn = turn if self.low is None else self.low, turn, turn
        if fault in self.faults:
            self.faults[fault] += 1
        if self.rows:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.last = initial
        self.rows += 1

    def extend(self, later: Tally) -> None:
        if later.low is not None:
            self.turns += later.turns - (later.low == self.high)
            self.low, self.high = later.low if self.low is None else self.low, later.high
        for k in self.faults:
            self.faults[k] += later.faults[k]
        if self.rows and later.rows:
            self.illegal += self.last + later.first not in LEGAL
        self.illegal += later.illegal
        self.first = self.first if self.rows else later.first
        self.last = later.last if later.rows else self.last
        self.rows += later.rows

    def state(self) -> dict:
        return vars(self)

    @staticmethod
    def of(state: dict) -> Tally:
        out = Tally()
        vars(out).update(state)
        return out

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def counts(self) -> tuple[int, ...]:
        return self.gaps(), self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal


def ordered_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """conv_id, run, turn, role, text, again, long of each row, copies written out; rows come sorted."""
    before = None
    for b in batches:
        for conv, run, turn, role, text, copies, again, long in zip(*(c.to_pylist() for c in b.columns)):
            this = (conv, turn, role, text)
            yield conv, run, turn, role, text, again or this == before, long
            for _ in range(copies - 1):
                yield conv, run, turn, role, text, True, long
            before = this


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", damage: bool = True) -> DataFrame:
    """One row per conversation of the input: its faults, the cheapest repair and a hash of the result.

    conv_id, gaps (missing turns between the first and the last), blank, duplicate, truncated (rows by first
    fault), illegal (neighbours whose role initials are not su, ua or au), cost, audit (K, R, D, I:
    keep, rerole, delete, insert) and repaired_sha256 of the `role:text` lines. Rows are in order of turn, nulls
    first, then of role and text; equal rows of a turn are one and its duplicates. A null role or text is one
    space; a null conv_id is a conversation of its own. With `damage`, rows are damaged first, as crc32 of
    `conv_id:turn` decides; a conversation that loses all rows has zeros, an empty audit and the hash of the
    empty string. No rows give no rows. Other columns are not looked at.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    if damage:
        alive = damaged(rows)
    else:
        alive = rows.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            null_safe("role").alias("role"), null_safe("text").alias("text"), F.lit(1).alias("copies"),
        )
    placed = with_order(alive).select("conv_id", "run", "turn", "role", "text", "copies", "again", "long")
    # runs of one conversation are spread over tasks, unless it has only one
    runs = map_texts(
        placed.repartition("conv_id", "run").sortWithinPartitions("conv_id", "run", "turn", "role", "text"), searched, RUNS_SCHEMA
    )
    runs = stored(runs, "conversation-runs")
    whole = runs.where("kind = 2").select("data")
    parts = runs.where("kind < 2").repartition("conv_id").sortWithinPartitions("conv_id", "kind", "run", "part")
    done = map_texts(whole, unpacked, OUT_SCHEMA).unionByName(map_texts(parts, composed, OUT_SCHEMA))
    found = ids.withColumnRenamed("conv_id", "c").join(done, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    zeros = {n: F.coalesce(n, F.lit(0)) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return found.withColumns({
        **zeros, "audit": F.coalesce("audit", F.lit("")),
        "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())),
    }).drop("conv_id").withColumnRenamed("c", "conv_id").select(*OUT.names)


def hashed(rows: list[tuple[str, str]], digest, begun: bool) -> bool:
    for role, text in rows:
        if begun:
            digest.update(b"\n")
        digest.update(f"{role}:{text}".encode())
        begun = True
    return begun


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 2: the result of a conversation with one run. Kind 0 and 1: ways through a run of a
    longer one, and its rows in blocks."""
    import pickle

    out, key, part = [], None, 0
    known: dict[tuple[str, ...], tuple[int, str]] = {}
    codes, texts, size, tally, pending = [], [], 0, Tally(), []

    def closed(last_block: bool = True) -> None:
        nonlocal codes, texts, size, tally, pending
        if key is None or not codes:
            return
        conv, run, long = key
        order = -1 if run is None else run
        if not long:
            asked = tuple(codes)
            if asked not in known:
                if len(known) >= MEMO:
                    known.clear()
                known[asked] = search(asked)
            cost, audit = known[asked]
            digest = hashlib.sha256()
            hashed(repaired(audit, EMPTY, texts)[0], digest, False)
            out.append((conv, 2, order, 0, pickle.dumps((conv, *tally.counts(), cost, audit, digest.hexdigest()))))
        else:
            whole = tuple(codes)
            ways = {(a, z): w for a in STATES for z in STATES if (w := search(whole, a, (z,)))}
            out.append((conv, 0, order, part, zlib.compress(pickle.dumps((tally.state(), ways)))))
            out.append((conv, 1, order, part, zlib.compress(pickle.dumps(texts))))
        codes, texts, size, tally = [], [], 0, Tally()

    for conv, run, turn, role, text, again, long in ordered_rows(batches):
        if key is None or key[:2] != (conv, run):
            closed()
            key, part = (conv, run, long), 0
        elif long and (len(codes) >= RUN_ROWS or size >= BLOCK):
            closed()
            part += 1
        initial, fault = role[:1], fault_of(text, again)
        codes.append((initial if initial in ("s", "u", "a") else "x") + fault)
        texts.append((role, text))
        size += len(text)
        tally.add(turn, initial, fault)
        if len(out) >= 256:
            yield batch(RUNS, *zip(*out))
            out = []
    closed()
    if out:
        yield batch(RUNS, *zip(*out))


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pickle

    for b in batches:
        rows = [pickle.loads(x) for x in b.column(0).to_pylist()]
        if rows:
            yield batch(OUT, *zip(*rows))


def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of long conversations: all their runs' ways come first, then their rows, run by run."""
    import pickle

    out: list[tuple] = []
    conv, route, way, tally, cost = None, None, None, None, 0
    digest, begun, at = None, False, 0

    def closed() -> None:
        if route is not None:
            out.append((conv, *tally.counts(), cost, "".join(a for _, a in way), digest.hexdigest()))

    for b in batches:
        for this, kind, _, _, data in zip(*(c.to_pylist() for c in b.columns)):
            data = pickle.loads(zlib.decompress(data))
            if kind == 0:
                if route is None or this != conv or way is not None:
                    closed()
                    conv, route, way, tally, digest, begun, at = this, Way(), None, Tally(), hashlib.sha256(), False, 0
                tally.extend(Tally.of(data[0]))
                route.add(data[1])
                continue
            if way is None:
                cost, way = route.finished()
            state, audit = way[at]
            begun = hashed(repaired(audit, state, data)[0], digest, begun)
            at += 1
        if out:
            yield batch(OUT, *zip(*out))
            out.clear()
    closed()
    if out:
        yield batch(OUT, *zip(*out))
