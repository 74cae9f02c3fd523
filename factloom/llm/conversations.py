"""Repair of conversations by the cheapest edits.

A conversation's messages should be of a form that the roles' initials spell: ``(s?(ua)+)?``. Edits keep a message (0), give it the role
user or assistant (1), delete it (2; a blank or repeated one must go) or insert an empty one (5); a truncated message that stays
costs 5. The messages and the four states of that form make a graph; forward and backward minimum costs tell which of its arcs lie on a cheapest
path, and walking those arcs from the start, the least letter first, gives the edits that come first in ASCII among the cheapest. A letter and a state
fix the next state, so the frontier of that walk holds one state.

Messages are sorted by conversation and turn over all tasks and packed into blocks of one conversation. Nearly every conversation is one
block and is solved where it lies. Of those that go over more blocks, or lie at the end of a task, each block is summed up by the least costs between
its four states at either end; these are put together backwards for what is to come, then forwards for the state that the walk enters each
block in, and each block is solved by itself again. A conversation of any length is so spread over tasks; only summaries of its blocks are brought in
order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Messages and characters of a block.
BLOCK, BLOCK_CHARS = 4096, 1 << 20
#: Messages up to which the edits of a form are remembered.
SHORT = 24
FAR = 1 << 60
# What edits cost, and what a truncated message that stays costs.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The state after a message with that initial: 0 at the start, then after the system's, a user's or an assistant's message. It may end in 0 and 3.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: The one state that a message of a user or assistant leads to.
TURN = {0: 2, 1: 2, 2: 3, 3: 2}
END = (0, INSERT * 2, INSERT, 0)
ROLES = {2: "user", 3: "assistant"}


def inserted_forward(f: list[int]) -> list[int]:
    """Costs to reach each state once messages may be inserted."""
    user = min(f[2], f[0] + INSERT, f[1] + INSERT, f[3] + INSERT)
    return [f[0], f[1], user, min(f[3], user + INSERT)]


def inserted_backward(b: list[int]) -> list[int]:
    """Costs to go on from each state if messages may be inserted first."""
    user = min(b[2], b[3] + INSERT)
    return [min(b[0], user + INSERT), min(b[1], user + INSERT), user, min(b[3], user + INSERT)]


def arcs(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may become of a message. A symbol is its role's initial, in upper case if it is truncated, ``o`` for other roles, ``x`` if it must go."""
    out = [("D", DELETE, state)]
    if symbol != "x":
        stays = TRUNCATED * symbol.isupper()
        if (to := NEXT.get((state, symbol.lower()))) is not None:
            out.append(("K", stays, to))
        out.append(("R", REROLE + stays, TURN[state]))
    return out


_ARCS = {(c, s): arcs(c, s) for c in "suaoSUAOx" for s in range(4)}


def forward(symbols: str, f: Iterable[int]) -> list[list[int]]:
    """Least costs to arrive in each state before each message, insertions after it not counted; one more at the end."""
    out = [list(f)]
    for c in symbols:
        f, to = inserted_forward(out[-1]), [FAR] * 4
        for s in range(4):
            if f[s] < FAR:
                for _, cost, t in _ARCS[c, s]:
                    to[t] = min(to[t], f[s] + cost)
        out.append(to)
    return out


def backward(symbols: str, b: Iterable[int]) -> list[list[int]]:
    """Least costs from each state before each message, insertions there included, to the end; ``b`` is that of the end."""
    out = [list(b)]
    for c in reversed(symbols):
        out.append(inserted_backward([min(cost + out[-1][t] for _, cost, t in _ARCS[c, s]) for s in range(4)]))
    return out[::-1]


def walk(symbols: str, state: int, f: list[int], b: list[int], total: int, last: bool) -> tuple[str, list[int], int]:
    """The edits' letters, the state after each, and the state at the end: of the arcs on cheapest paths the least letter at each step.

    ``f`` and ``b`` are the costs before the first message and after the last, ``total`` those of the conversation. Unless
    the block is the ``last``, what is inserted at its end belongs to the next.
    """
    fs, bs = forward(symbols, f), backward(symbols, b)
    letters, states, i = [], [], 0
    fs = [inserted_forward(x) for x in fs]
    while i < len(symbols) or last and bs[i][state]:
        least = None
        if i < len(symbols):
            for letter, cost, to in _ARCS[symbols[i], state]:
                if fs[i][state] + cost + bs[i + 1][to] == total and (least is None or letter < least[0]):
                    least = letter, to, i + 1
        if (least is None or least[0] > "I") and fs[i][state] + INSERT + bs[i][TURN[state]] == total:
            least = "I", TURN[state], i
        letter, state, i = least
        letters.append(letter)
        states.append(state)
    return "".join(letters), states, state


@lru_cache(maxsize=1 << 16)
def _short(symbols: str) -> tuple[int, str, tuple[int, ...]]:
    total = backward(symbols, END)[0][0]
    letters, states, _ = walk(symbols, 0, [0, FAR, FAR, FAR], list(END), total, True)
    return total, letters, tuple(states)


def repaired(letters: str, states: Iterable[int], roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of the messages after the edits."""
    i = 0
    for letter, state in zip(letters, states, strict=True):
        if letter == "I":
            yield ROLES[state], ""
            continue
        if letter != "D":
            yield roles[i] if letter == "K" else ROLES[state], texts[i]
        i += 1


def _joined(messages: Iterable[tuple[str, str]]) -> bytes:
    return "\n".join(f"{r}:{t}" for r, t in messages).encode("utf-8", "surrogatepass")


_LONGS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _rows(df: DataFrame) -> DataFrame:
    """(c, t, conv, turn, role, text, n, first): different messages, how often each is there, and whether none like it is at an earlier turn.

    ``c`` and ``t`` are conversation and turn as keys without nulls that sort as these do. Repeats are counted before messages move.
    No join has a hot key: a message meets the earliest of its like by its own turn.
    """
    df = df.withColumn("like", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.col("text")), 256)))
    one = df.groupBy("c", "t", "like").agg(F.first("conv").alias("conv"), F.first("turn").alias("turn"), F.first("role").alias("role"), F.first("text").alias("text"), F.count("role").alias("n"))
    early = df.groupBy("c", "like").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn", "t")).alias("e")).select("c", "like", F.col("e.t").alias("t"), F.lit(True).alias("first"))
    return one.join(early, ["c", "t", "like"], "left").drop("like")


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    """Blocks of sorted messages of one conversation. ``alone`` if it certainly is its conversation's only one."""
    names = ["c", "conv", "part", "seq", "alone", "turn_min", "turn_max", "turns", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "symbols", "roles", "texts"]
    schema = f"c string, conv {kind}, part int, seq long, alone boolean, turn_min long, turn_max long, turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, symbols string, roles array<string>, texts array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, conv_kind = TaskContext.get().partitionId(), None

        def batch(rows: list[list]) -> pa.RecordBatch:
            kinds = [pa.string(), conv_kind, pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 7, *[pa.string()] * 3, *[pa.list_(pa.string())] * 2]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def messages() -> Iterator[tuple]:
            nonlocal conv_kind
            for b in batches:
                conv_kind = b.column("conv").type
                for c, conv, turn, role, text, n, first, fault in zip(*(b.column(x).to_pylist() for x in ("c", "conv", "turn", "role", "text", "n", "first", "fault")), strict=True):
                    if not n:
                        yield c, conv, None, None, None, None
                    for k in range(n):
                        yield c, conv, turn, role, text, "blank" if fault == "blank" else "duplicate" if k or not first else fault

        def blocks() -> Iterator[list]:
            """Blocks with ``alone`` set where the conversation has no other in this task."""
            block, chars, seq = None, 0, 0
            for c, conv, turn, role, text, fault in messages():
                if block is not None and (c != block[0] or len(block[15]) >= BLOCK or chars >= BLOCK_CHARS):
                    block[4] = same = block[4] and c != block[0]
                    yield block
                    seq = seq + 1 if c == block[0] else 0
                    block = [c, conv, number, seq, same or c != block[0], None, None, 0, 0, 0, 0, 0, None, None, [], [], []]
                    chars = 0
                elif block is None:
                    block = [c, conv, number, seq, True, None, None, 0, 0, 0, 0, 0, None, None, [], [], []]
                if role is None:
                    continue
                initial = role[:1]
                if turn is not None:
                    block[5] = turn if block[5] is None else block[5]
                    block[7] += turn != block[6]
                    block[6] = turn
                if fault:
                    block[{"blank": 8, "duplicate": 9, "truncated": 10}[fault]] += 1
                if block[12] is None:
                    block[12] = initial
                else:
                    block[11] += block[13] + initial not in ("su", "ua", "au")
                block[13] = initial
                known = initial if initial in ("s", "u", "a") else "o"
                block[14].append("x" if fault in ("blank", "duplicate") else known.upper() if fault else known)
                block[15].append(role)
                block[16].append(text)
                chars += len(text)
            if block is not None:
                yield block

        before, out, size, first = None, [], 0, None
        for block in blocks():
            block[14] = "".join(block[14])
            if before is None:
                first = block[0]
            else:
                out.append(before)
            before = block
            block[4] = block[4] and block[0] != first  # the first and the last conversation may go on in other tasks
            size += sum(map(len, block[16])) + 100
            if size > 1 << 21 and out:
                yield batch(out)
                out, size = [], 0
        if before is not None:
            before[4] = False
            yield batch([*out, before])

    order = ["c", F.asc_nulls_first("turn"), "role", "text"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _solved(blocks: DataFrame) -> DataFrame:
    """The repair of blocks that are conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for low, high, turns, symbols, roles, texts in zip(*(b.column(c).to_pylist() for c in ("turn_min", "turn_max", "turns", "symbols", "roles", "texts")), strict=True):
                cost, letters, states = _short(symbols) if len(symbols) <= SHORT else _short.__wrapped__(symbols)
                out.append((high - low + 1 - turns if low is not None else 0, cost, letters, hashlib.sha256(_joined(repaired(letters, states, roles, texts))).hexdigest()))
            gaps, cost, letters, digest = zip(*out, strict=True) if out else ((),) * 4
            columns = [b.column("conv"), pa.array(gaps, pa.int64()), *[b.column(c) for c in _LONGS[1:5]], pa.array(cost, pa.int64()), pa.array(letters, pa.string()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["conv", *_LONGS, "audit", "repaired_sha256"])

    return blocks.mapInArrow(run, _result(blocks))


def _result(blocks: DataFrame) -> str:
    return ", ".join([f"conv {blocks.schema['conv'].dataType.simpleString()}", *[f"{c} long" for c in _LONGS], "audit string", "repaired_sha256 string"])


def _in_order(df: DataFrame, backwards: bool = False) -> DataFrame:
    order = [F.desc(c) if backwards else F.asc(c) for c in ("c", "part", "seq")]
    return df.repartition("c").sortWithinPartitions(*order)


def _walked(ws: Workspace, blocks: DataFrame) -> DataFrame:
    """(c, part, seq, entered, before, after, total, last): what each block has to know of the others of its conversation."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            found = []
            for symbols in b.column("symbols").to_pylist():
                found.append([x for s in range(4) for x in forward(symbols, [0 if s == i else FAR for i in range(4)])[-1]])
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("part"), b.column("seq"), b.column("symbols"), pa.array(found, pa.list_(pa.int64()))], ["c", "part", "seq", "symbols", "costs"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Costs after each block, from the last one on, and the state that each of the four leads to."""
        inside, b_end = None, None
        for b in (b for b in batches if b.num_rows):
            out = []
            for c, symbols, costs in zip(b.column("c").to_pylist(), b.column("symbols").to_pylist(), b.column("costs").to_pylist(), strict=True):
                last = c != inside
                if last:
                    inside, b_end = c, list(END)
                start = [min(costs[4 * s + t] + b_end[t] for t in range(4)) for s in range(4)]
                exits = []
                for s in range(4):
                    f = [0 if s == i else FAR for i in range(4)]
                    exits.append(walk(symbols, s, f, b_end, start[s], last)[2])
                out.append((b_end, exits, start, last))
                b_end = start
            after, exits, start, last = zip(*out, strict=True)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (after, exits, start)]
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in ("c", "part", "seq", "costs")], *lists, pa.array(last, pa.bool_())], ["c", "part", "seq", "costs", "after", "exits", "start", "last"])

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, state, f, total = None, 0, None, 0
        for b in (b for b in batches if b.num_rows):
            out = []
            for c, costs, exits, start in zip(*(b.column(x).to_pylist() for x in ("c", "costs", "exits", "start")), strict=True):
                if c != inside:
                    inside, state, f, total = c, 0, [0, FAR, FAR, FAR], start[0]
                out.append((state, f, total))
                state, f = exits[state], [min(min(f[s] + costs[4 * s + t], FAR) for s in range(4)) for t in range(4)]
            entered, before, totals = zip(*out, strict=True)
            columns = [*[b.column(x) for x in ("c", "part", "seq")], pa.array(entered, pa.int32()), pa.array(before, pa.list_(pa.int64())), b.column("after"), pa.array(totals, pa.int64()), b.column("last")]
            yield pa.RecordBatch.from_arrays(columns, ["c", "part", "seq", "entered", "before", "after", "total", "last"])

    key = "c string, part int, seq long"
    summed = blocks.select("c", "part", "seq", "symbols").mapInArrow(sums, f"{key}, symbols string, costs array<long>")
    known = ws.stage(_in_order(summed, backwards=True).mapInArrow(back, f"{key}, costs array<long>, after array<long>, exits array<long>, start array<long>, last boolean"), "back")
    return _in_order(known).mapInArrow(on, f"{key}, entered int, before array<long>, after array<long>, total long, last boolean")


def _spread(ws: Workspace, blocks: DataFrame) -> DataFrame:
    """The repair of conversations that go over blocks: each is solved by itself, and what comes out is put together in order."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for symbols, roles, texts, state, before, after, total, last in zip(*(b.column(c).to_pylist() for c in ("symbols", "roles", "texts", "entered", "before", "after", "total", "last")), strict=True):
                letters, states, _ = walk(symbols, state, before, after, total, last)
                out.append((letters, _joined(repaired(letters, states, roles, texts)), len(letters) - letters.count("D")))
            letters, joined, n = zip(*out, strict=True) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(letters, pa.string()), pa.array(joined, pa.binary()), pa.array(n, pa.int64())], [*kept, "letters", "joined", "left"])

    kept = ["c", "conv", "part", "seq", "turn_min", "turn_max", "turns", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "total"]
    conv = blocks.schema["conv"].dataType.simpleString()
    schema = f"c string, conv {conv}, part int, seq long, turn_min long, turn_max long, turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, total long, letters string, joined binary, left long"
    names = [x.split()[0] for x in schema.split(", ")]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each conversation from its blocks in order. Texts go into the digest as they come; of the rest letters are kept."""
        now, conv_kind = None, None

        def batch() -> pa.RecordBatch:
            low, high, turns, initial, letters, digest, any_, sums, conv, cost = (now[k] for k in ("low", "high", "turns", "initial", "letters", "digest", "any", "sums", "conv", "cost"))
            row = [conv, high - low + 1 - turns if low is not None else 0, *sums, cost, "".join(letters), digest.hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, [conv_kind, *[pa.int64()] * 6, pa.string(), pa.string()], strict=True)], ["conv", *_LONGS, "audit", "repaired_sha256"])

        for b in batches:
            conv_kind = b.column("conv").type
            for row in zip(*(b.column(x).to_pylist() for x in names), strict=True):
                r = dict(zip(names, row, strict=True))
                if now is None or now["c"] != r["c"]:
                    if now is not None:
                        yield batch()
                    now = {"c": r["c"], "conv": r["conv"], "low": None, "high": None, "turns": 0, "initial": None, "letters": [], "digest": hashlib.sha256(), "any": False, "sums": [0] * 4, "cost": r["total"]}
                if r["turn_min"] is not None:
                    now["turns"] += r["turns"] - (r["turn_min"] == now["high"])
                    now["low"] = r["turn_min"] if now["low"] is None else now["low"]
                    now["high"] = r["turn_max"]
                if r["first_initial"] is not None:
                    crossing = now["initial"] is not None and now["initial"] + r["first_initial"] not in ("su", "ua", "au")
                    now["sums"] = [a + r[k] for a, k in zip(now["sums"], _LONGS[1:5], strict=True)]
                    now["sums"][3] += crossing
                    now["initial"] = r["last_initial"]
                now["letters"].append(r["letters"])
                if r["left"]:
                    now["digest"].update(b"\n" * now["any"])
                    now["digest"].update(r["joined"])
                    now["any"] = True
        if now is not None:
            yield batch()

    told = _walked(ws, blocks)
    solved = blocks.join(told, ["c", "part", "seq"]).mapInArrow(solve, schema)
    return _in_order(solved).mapInArrow(whole, _result(blocks))


def fault_of(text: Column) -> Column:
    """``blank`` without a character other than blanks, ``truncated`` if the last such character ends no sentence; else null."""
    # The blanks and the signs that end a sentence.
    said = F.regexp_replace(text, r"[\x20\x09-\x0D]+\z", "")
    return F.when(said == "", "blank").when(~F.substring(said, -1, 1).isin(".", "!", "?"), "truncated")


def repair(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Messages are taken by turn, nulls first, then role and text. ``gaps`` are turns missing between the first and the last; each message counts by its first
    fault: blank, a duplicate (role and text were there before), truncated; ``illegal`` counts neighbours whose roles' initials can't
    follow each other. ``audit`` has the initials of the cheapest edits, Keep, Rerole, Delete and Insert, the first in ASCII of equal ones, and
    the digest is that of the repaired ``role:text`` lines. A row with a null role is no message; it says that the conversation is
    there, which has zeros if it has no other row. A null text is empty; a null id is a conversation; repeated rows are repeated
    messages; an empty table gives an empty one; other columns are not read. ``turn`` is an integer.

    What grows with one conversation alone is its audit and the digest's pass over its text, block by block, in one task; no fewer would do.
    """
    ws = Workspace(messages.sparkSession, "conversations")
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumns({"c": _key("conv"), "t": _key("turn")})
    counted = _rows(rows).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("fault", fault_of(F.col("text")))
    blocks = ws.stage(_packed(counted, rows.schema["conv"].dataType.simpleString()), "blocks")
    return _solved(blocks.where("alone")).unionByName(_spread(ws, blocks.where("not alone"))).withColumnRenamed("conv", conv_col)


def _key(column: str) -> Column:
    """A value as text, null as the empty text."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))
