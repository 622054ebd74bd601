"""Conversation structure repair: cheapest edits that make the roles of a conversation fit ``(s?(ua)+)?``.

For each cost c = 0, 1, 2 ... a layer holds, before every turn, the bitset of grammar states from which the rest of the
conversation can be repaired for c or less; a layer follows from the three layers before it by table lookups.
The first layer whose first bitset has the start state gives the cost, and walking forward along set bits, always by
the least edit that stays on a cheapest path, gives the least audit.

Turns are sorted over the whole table by ranges, so a conversation of any length spreads over tasks.  Tasks cut it into
pieces of at most ``PIECE_ROWS`` turns.  A conversation that is one piece is repaired where it stands.  Pieces of longer
ones give a small matrix (cheapest cost from state to state); those are scanned backwards per conversation, then every
piece traces its edits from each state it may start in, and one ordered pass picks the right ones and hashes the result.

Defined results: null roles and texts are one space; rows of equal conversation, turn, role and text are counted, not
kept, and all but the first are duplicates; rows of one turn are taken by role, then text; a null conversation is one
conversation, null turns come first; an unknown role cannot be kept; forced deletions stand before insertions at the
same place; a conversation without rows has zeros, an empty audit and the hash of nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

PIECE_ROWS = 64
PIECE_BYTES = 4 << 20
RANGE_BYTES = 32 << 20
NONE = 1 << 40  # no path
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
STEP = {"s": {START: AFTER_SYSTEM}, "u": {START: AFTER_USER, AFTER_SYSTEM: AFTER_USER, AFTER_ASSISTANT: AFTER_USER}, "a": {AFTER_USER: AFTER_ASSISTANT}}
#: cost of the insertions that complete a conversation in each state
FINISH = (0, 4, 2, 0)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")


def _before(role: str) -> list[int]:
    """For each bitset of states, the bitset of states that ``role`` leads into it."""
    return [sum(1 << s for s, t in STEP.get(role, {}).items() if b >> t & 1) for b in range(16)]


KEEP = {r: _before(r) for r in "suax"}
PUT = [u | a for u, a in zip(KEEP["u"], KEEP["a"])]


def layers(units: str, end: list[int], start: int) -> list[list[int]]:
    """Bitsets before each turn and at the end, for costs 0, 1, ... until the states ``start`` that can be repaired are.

    A unit is the initial of a turn's role (x: none that fits), a capital where keeping its text costs 1; ``end`` gives
    what the rest costs in each state after the last turn.
    """
    n = len(units)
    wanted = start & _reachable(units, end)
    nothing = [0] * (n + 1)
    found: list[list[int]] = []
    c = 0
    while not found or wanted & ~found[-1][0]:
        one, two, three = (found[c - k] if c >= k else nothing for k in (1, 2, 3))
        layer = [0] * (n + 1)
        layer[n] = sum(1 << t for t in range(4) if end[t] <= c)
        for i in range(n - 1, -1, -1):
            unit = units[i]
            if unit.islower():
                kept = KEEP[unit][layer[i + 1]] | PUT[two[i + 1]]
            else:
                kept = KEEP[unit.lower()][one[i + 1]] | PUT[three[i + 1]]
            layer[i] = one[i] | kept | three[i + 1] | PUT[two[i]]
        found.append(layer)
        c += 1
    return found


def _reachable(units: str, end: list[int]) -> int:
    """States before the first turn from which some edits lead to an end that is allowed."""
    b = sum(1 << t for t in range(4) if end[t] < NONE)
    for unit in reversed(units):
        b = b | KEEP[unit.lower()][b] | PUT[b]
        b |= PUT[b]
        b |= PUT[b]
    return b


def cheapest(found: list[list[int]], state: int) -> int:
    return next((c for c, layer in enumerate(found) if layer[0] >> state & 1), NONE)


def matrix(units: str) -> list[int]:
    """Cheapest cost from each state before the turns to each state after them, row by row."""
    columns = [layers(units, [0 if t == e else NONE for t in range(4)], 15) for e in range(4)]
    return [cheapest(columns[e], s) for s in range(4) for e in range(4)]


def trace(units: str, found: list[list[int]], state: int) -> tuple[str, int]:
    """The least edits (D, I, K, R) from ``state`` on a cheapest path, and the state they end in."""
    c, i, out = cheapest(found, state), 0, []
    has = lambda cost, place, s: s is not None and cost >= 0 and found[cost][place] >> s & 1
    put = lambda s: STEP["u"].get(s, STEP["a"].get(s))
    while i < len(units):
        unit = units[i]
        x = 0 if unit.islower() else 1
        if has(c - 3, i + 1, state):
            out.append("D")
            c, i = c - 3, i + 1
        elif has(c - 2, i, put(state)):
            out.append("I")
            c, state = c - 2, put(state)
        elif has(c - x, i + 1, kept := STEP.get(unit.lower(), {}).get(state)):
            out.append("K")
            c, i, state = c - x, i + 1, kept
        else:
            out.append("R")
            c, i, state = c - 2 - x, i + 1, put(state)
    return "".join(out), state


def repaired(entries: list[dict], moves: str, state: int) -> tuple[str, int, list[dict]]:
    """Audit, cost and turns that remain of some turns and their edits; edits past the last turn are insertions."""
    audit, cost, turns, at = [], 0, [], 0

    def insert():
        nonlocal at, state, cost
        role = "u" if state in STEP["u"] else "a"
        state = STEP[role][state]
        turns.append({"role": ROLES[role], "text": ""})
        audit.append("I")
        at, cost = at + 1, cost + 2

    for e in entries:
        if e["fault"] in ("blank", "duplicate"):
            audit.append("D" * e["copies"])
            cost += 3 * e["copies"]
            continue
        while moves[at] == "I":
            insert()
        move, at = moves[at], at + 1
        audit.append(move + "D" * (e["copies"] - 1))
        cost += 3 * (e["copies"] - 1)
        if move == "D":
            cost += 3
            continue
        role = e["role"]
        if move == "R":
            role, cost = ROLES["u" if state in STEP["u"] else "a"], cost + 2
        state = STEP[role[:1]][state]
        cost += e["fault"] == "truncated"
        turns.append({"role": role, "text": e["text"]})
    while at < len(moves):
        insert()
    return "".join(audit), cost, turns


def completion(state: int) -> str:
    return "I" * (FINISH[state] // 2)


def units_of(entries: list[dict]) -> str:
    """Units of the turns that need not be deleted."""
    out = []
    for e in entries:
        if e["fault"] not in ("blank", "duplicate"):
            initial = e["role"][:1] if e["role"][:1] in STEP else "x"
            out.append(initial.upper() if e["fault"] == "truncated" else initial)
    return "".join(out)


COUNTS = ("blank", "duplicate", "truncated", "illegal")
ENTRY = pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("fault", pa.string())])
TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
PIECE = [
    ("conv_id", None), ("part", pa.int32()), ("piece", pa.int32()), ("whole", pa.bool_()), *[(c, pa.int64()) for c in COUNTS], ("low", pa.int64()), ("high", pa.int64()), ("distinct", pa.int64()), ("first", pa.string()), ("last", pa.string()),
    ("units", pa.string()), ("costs", pa.list_(pa.int64())), ("entries", pa.list_(ENTRY)), ("audit", pa.string()), ("cost", pa.int64()), ("turns", pa.list_(TURN)), ("sha256", pa.string()),
]
PIECE_DDL = (
    "part int, piece int, whole boolean, blank long, duplicate long, truncated long, illegal long, low long, high long, `distinct` long, `first` string, `last` string, units string, costs array<long>, "
    "entries array<struct<role:string,text:string,copies:long,fault:string>>, audit string, cost long, turns array<struct<role:string,text:string>>, sha256 string"
)
CHUNK = [("conv_id", None), ("chunk", pa.int64()), ("turns", pa.list_(TURN)), ("gaps", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("cost", pa.int64()), ("audit", pa.string()), ("sha256", pa.string())]
CHUNK_DDL = "chunk long, turns array<struct<role:string,text:string>>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha256 string"


def _batch(rows: list[dict], columns: list, conv: pa.DataType) -> pa.RecordBatch:
    schema = pa.schema([(c, conv if t is None else t) for c, t in columns])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Distinct turns after damage with their number of copies; a conversation's dropped turns become one row of none."""
    conv, turn = F.col("conv_id"), F.col("turn")
    part = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    code = F.crc32(F.concat(part(conv), F.lit(":"), part(turn))) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    gone = code == 0
    rows = conversations.select(
        "conv_id",
        gone.alias("dropped"),
        F.when(~gone, turn.cast("long")).alias("turn"),
        F.when(gone, "").when(code == 4, "user").otherwise(role).alias("role"),
        F.when(gone | (code == 1), "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(gone, 0).when(code == 3, 2).otherwise(1).cast("long").alias("copies"),
    )
    return counted(rows)


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv_id", "dropped", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """The first fault of the first copy of each distinct turn: blank, duplicate, truncated or null."""
    rows = rows.withColumn("same", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    at = F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn"))
    seen = rows.where("NOT dropped").groupBy(F.col("conv_id").alias("conv"), F.col("same").alias("same_")).agg(F.min(at).alias("earliest"))
    out = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("same") == F.col("same_")), "left")
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    ended = F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    fault: Column = F.when(blank, "blank").when(at > F.col("earliest"), "duplicate").when(~ended, "truncated")
    return out.select("conv_id", "dropped", "turn", "role", "text", "copies", fault.alias("fault"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[dict], int, int, bool]]:
    """(conversation, turns, its number here, piece, whether another conversation follows) of sorted turns."""
    held: list[dict] = []
    size = number = piece = 0
    for batch in batches:
        for r in batch.to_pylist():
            if held and r["conv_id"] != held[0]["conv_id"]:
                yield held[0]["conv_id"], held, number, piece, True
                held, size, number, piece = [], 0, number + 1, 0
            elif len(held) >= PIECE_ROWS or size >= PIECE_BYTES:
                yield held[0]["conv_id"], held, number, piece, False
                held, size, piece = [], 0, piece + 1
            held.append(r)
            size += len(r["text"])
    if held:
        yield held[0]["conv_id"], held, number, piece, False


def _facts(rows: list[dict]) -> dict:
    """Counts, turns and role initials of a piece."""
    out = dict.fromkeys(COUNTS, 0)
    last, turns = None, []
    for r in rows:
        n, initial = r["copies"], r["role"][:1]
        out["illegal"] += (last is not None and last + initial not in LEGAL) + n - 1
        last = initial
        if r["fault"] == "blank":
            out["blank"] += n
        else:
            out["duplicate"] += n - 1
            if r["fault"]:
                out[r["fault"]] += 1
        if r["turn"] is not None and (not turns or turns[-1] != r["turn"]):
            turns.append(r["turn"])
    ends = {"low": turns[0], "high": turns[-1]} if turns else {"low": None, "high": None}
    return out | ends | {"distinct": len(turns), "first": rows[0]["role"][:1] if rows else None, "last": last}


def pieces(turns: DataFrame, conv: pa.DataType) -> DataFrame:
    """Pieces of conversations from turns sorted over all partitions; those of one piece are repaired already."""

    def run(batches):
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        size = 0
        for conv_id, rows, number, piece, closed in _cut(batches):
            rows = [r for r in rows if not r["dropped"]]
            row = {"conv_id": conv_id, "part": part, "piece": piece, "whole": closed and number > 0 and piece == 0, **_facts(rows)}
            units = units_of(rows)
            entries = [{k: r[k] for k in ("role", "text", "copies", "fault")} for r in rows]
            if row["whole"]:
                moves, state = trace(units, layers(units, list(FINISH), 1), START)
                row["audit"], row["cost"], row["turns"] = repaired(entries, moves + completion(state), START)
                row["sha256"] = hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in row["turns"]).encode()).hexdigest()
            else:
                row |= {"units": units, "costs": matrix(units), "entries": entries}
            out.append(row)
            size += sum(len(e["text"]) for e in entries)
            if len(out) >= 1000 or size >= PIECE_BYTES:
                yield _batch(out, PIECE, conv)
                out, size = [], 0
        if out:
            yield _batch(out, PIECE, conv)

    return turns.mapInArrow(run, f"conv_id {dict(turns.dtypes)['conv_id']}, {PIECE_DDL}")


def _ahead(open_: DataFrame, conv: pa.DataType) -> DataFrame:
    """What the rest costs in each state after every piece, by a scan from the last piece of a conversation to its first."""
    schema = [("conv_id", None), ("part", pa.int32()), ("piece", pa.int32()), ("ahead", pa.list_(pa.int64()))]

    def run(batches):
        last, rest = object(), list(FINISH)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["conv_id"] != last:
                    last, rest = r["conv_id"], list(FINISH)
                out.append({"conv_id": last, "part": r["part"], "piece": r["piece"], "ahead": rest})
                c = r["costs"]
                rest = [min(NONE, *(c[4 * s + e] + rest[e] for e in range(4))) for s in range(4)]
            yield _batch(out, schema, conv)

    back = open_.select("conv_id", "part", "piece", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("piece"))
    return back.mapInArrow(run, f"conv_id {dict(open_.dtypes)['conv_id']}, part int, piece int, ahead array<long>")


def _moves(known: DataFrame, conv: pa.DataType) -> DataFrame:
    """Every piece's edits and last state for each state it may start in."""
    schema = [("conv_id", None), ("part", pa.int32()), ("piece", pa.int32()), ("moves", pa.list_(pa.string())), ("ends", pa.list_(pa.int64()))]

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                least = min(r["ahead"])
                found = layers(r["units"], [min(NONE, a - least) if a < NONE else NONE for a in r["ahead"]], 15)
                ways = [trace(r["units"], found, s) if cheapest(found, s) < NONE else (None, None) for s in range(4)]
                out.append({"conv_id": r["conv_id"], "part": r["part"], "piece": r["piece"], "moves": [w[0] for w in ways], "ends": [w[1] for w in ways]})
            yield _batch(out, schema, conv)

    return known.select("conv_id", "part", "piece", "units", "ahead").mapInArrow(run, f"conv_id {dict(known.dtypes)['conv_id']}, part int, piece int, moves array<string>, ends array<long>")


def _assembled(ordered: DataFrame, conv: pa.DataType) -> DataFrame:
    """Chunks of repaired conversations from their pieces in order; the last chunk carries the totals."""

    def run(batches):
        held = None  # the last piece's row, until it is known whether more follow

        def rows():
            for batch in batches:
                yield from batch.to_pylist()

        def chunk(closing: bool) -> dict:
            out = {"conv_id": held["conv_id"], "chunk": held["chunk"], "turns": held["turns"]}
            if not closing:
                return out
            rest = completion(held["state"])
            audit, cost, turns = repaired([], rest, held["state"])
            text = "\n".join(f"{t['role']}:{t['text']}" for t in turns)
            if text:
                held["hash"].update(("\n" * held["any"] + text).encode())
            gaps = held["high"] - held["low"] + 1 - held["distinct"] if held["low"] is not None else 0
            audits = "".join(held["audits"]) + audit
            return out | {"turns": held["turns"] + turns, "gaps": gaps, **{c: held[c] for c in COUNTS}, "cost": held["cost"] + cost, "audit": audits, "sha256": held["hash"].hexdigest()}

        for r in rows():
            done = []
            if held is not None:
                same = held["conv_id"] == r["conv_id"]
                done.append(chunk(not same))
                if not same:
                    held = None
            if held is None:
                held = {"conv_id": r["conv_id"], "chunk": -1, "state": START, "hash": hashlib.sha256(), "any": False, "audits": [], "cost": 0, "low": None, "high": None, "distinct": 0, "last": None, **dict.fromkeys(COUNTS, 0)}
            state = held["state"]
            audit, cost, turns = repaired(r["entries"], r["moves"][state], state)
            text = "\n".join(f"{t['role']}:{t['text']}" for t in turns)
            if turns:
                held["hash"].update(("\n" * held["any"] + text).encode())
                held["any"] = True
            for c in COUNTS:
                held[c] += r[c]
            if r["first"] is not None:
                held["illegal"] += held["last"] is not None and held["last"] + r["first"] not in LEGAL
                held["last"] = r["last"]
            if r["low"] is not None:
                held["distinct"] += r["distinct"] - (held["high"] == r["low"])
                held["low"], held["high"] = r["low"] if held["low"] is None else held["low"], r["high"]
            held["audits"].append(audit)
            held |= {"chunk": held["chunk"] + 1, "turns": turns, "state": r["ends"][state], "cost": held["cost"] + cost}
            if done:
                yield _batch(done, CHUNK, conv)
        if held is not None:
            yield _batch([chunk(True)], CHUNK, conv)

    return ordered.mapInArrow(run, f"conv_id {dict(ordered.dtypes)['conv_id']}, {CHUNK_DDL}")


def repair(rows: DataFrame) -> DataFrame:
    """Repaired conversations in chunks: conv_id, chunk, turns (role and text), and on the last chunk what was found.

    ``rows``: conv_id, dropped, turn, role, text and copies, as :func:`damaged` returns them.
    """
    spark = rows.sparkSession
    turns = shared.stored(with_faults(shared.stored(rows, "rows")), "turns")
    total = turns.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0
    ranges = max(shared.shuffle_partitions(spark), total // RANGE_BYTES)
    conv = turns.select("conv_id").limit(0).toArrow().schema.field(0).type
    order = ["conv_id", "turn", "role", "text"]
    cut = shared.stored(pieces(turns.repartitionByRange(ranges, *order).sortWithinPartitions(*order), conv), "pieces")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0))
    closed = cut.where("whole").select("conv_id", F.lit(0).cast("long").alias("chunk"), "turns", gaps.alias("gaps"), *COUNTS, "cost", "audit", "sha256")
    open_ = cut.where("NOT whole")
    place = ["part", "piece"]
    ahead = _ahead(open_, conv).withColumnRenamed("conv_id", "conv_")
    units = open_.select("conv_id", *place, "units")
    known = units.join(ahead, [units.conv_id.eqNullSafe(ahead.conv_), *[units[p] == ahead[p] for p in place]]).select("conv_id", *[units[p] for p in place], "units", "ahead")
    moves = _moves(known, conv).withColumnRenamed("conv_id", "conv_")
    both = open_.join(moves, [open_.conv_id.eqNullSafe(moves.conv_), *[open_[p] == moves[p] for p in place]])
    both = both.select("conv_id", *[open_[p] for p in place], *COUNTS, "low", "high", "distinct", "first", "last", "entries", "moves", "ends")
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", *place)
    return closed.unionByName(_assembled(ordered, conv))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    out = repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).where("audit IS NOT NULL")
    return out.select("conv_id", "gaps", *COUNTS, "cost", "audit", F.col("sha256").alias("repaired_sha256"))
