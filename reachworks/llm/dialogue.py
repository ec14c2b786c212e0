"""Cheapest repair of the turn structure of conversations, by dynamic programming with square-root checkpoints.

A sound conversation has roles `s?(ua)+` by their initials, or no turn at all. Every turn is kept (cost 0), given the
role user or assistant (1) or deleted (2; blank and repeated turns must be), an empty turn of either role may be put in
anywhere (5), and a truncated turn that is not deleted costs 5 more. Four states say which initials may follow, so the
cost of repairing the rest of a conversation is a vector of four numbers. A backward pass keeps these vectors only
where it passes a checkpoint, every square root of the length; the forward walk computes the vectors of one stretch
again and takes, among the edits that reach the least cost, the first in ASCII order.

A conversation may hold any share of all rows. Its turns are numbered by an ordered scan and cut into blocks of BLOCK
turns, each a string of one character a turn. A block is first reduced to the 4 x 4 table of its costs from state to
state; these tables are scanned from the last block to the first for the vector behind each block, the blocks walk
forward from all four states at once, and a second scan picks the state in which each is entered. Both scans hold some
numbers a block, and a conversation's audit is one value of its result row anyway. Texts never meet: they are sorted
behind the edits of their block and hashed or passed on one by one.

Defined results: null roles and texts count as one space (so such a text is blank), null conversation ids are one
conversation of their own, null turns come first and do not count towards gaps. Turns of one number go by role, then by
the first HEAD characters of the text, then by its MD5, so equal rows stand together and all but the first are
duplicates. An empty table has an empty result. Columns other than the four are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachworks.operators.ordered import row_numbers
from reachworks.session import freeze

BLOCK = 4096  # turns
HEAD = 32  # characters of a text that order turns of equal number and role
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5  # for a truncated turn that stays
SPACE = r"\x20\x09-\x0D"

# States by what the conversation so far ends in, and the state that a user or assistant turn put next leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("", "", "user", "assistant")  # what such a turn is called, by the state it leads to
# KEPT[initial][state]: the state after a turn of that initial is kept, None where it may not stand.
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None), "-": (None,) * 4}
_INITIALS, _FAULTS = "sua-", ("", "blank", "duplicate", "truncated")
# A turn as one letter: its initial and its fault.
CODES = {chr(65 + 4 * i + f): (initial, fault) for i, initial in enumerate(_INITIALS) for f, fault in enumerate(_FAULTS)}
_LEGAL = {"su", "ua", "au"}
FAR = 1 << 50
END = (0, 2 * INSERT, INSERT, 0)  # cost of closing a conversation in each state

_KEY = ["turn", "role", "head", "digest"]


def damage(conversations: DataFrame) -> DataFrame:
    """The conversations with one row in five hurt, chosen by a checksum of conversation and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


# --- the repair of a run of turns

def close(cost: tuple) -> tuple:
    """Costs in each state when turns may be put in first."""
    start, system, user, assistant = cost
    user, assistant = min(user, INSERT + assistant), min(assistant, INSERT + user)
    return min(start, INSERT + user), min(system, INSERT + user), user, assistant


def edits(code: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) of one turn in ASCII order; putting a turn in is not among them."""
    initial, fault = CODES[code]
    yield "D", DELETE, state
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED if fault == "truncated" else 0
        if KEPT[initial][state] is not None:
            yield "K", KEEP + extra, KEPT[initial][state]
        yield "R", REROLE + extra, NEXT[state]


EDITS = {code: tuple(tuple(edits(code, state)) for state in range(4)) for code in CODES}


def before(code: str, after: tuple) -> tuple:
    """The costs before a turn from those after it."""
    return close(tuple(min(cost + after[to] for _, cost, to in EDITS[code][state]) for state in range(4)))


def checkpoints(codes: str, after: tuple) -> tuple[tuple, list[tuple], int]:
    """(costs before the first turn, costs behind every stretch, length of a stretch)."""
    span = max(1, math.isqrt(len(codes)))
    kept = [after] * (-(-len(codes) // span))
    for i in range(len(codes) - 1, -1, -1):
        if (i + 1) % span == 0:
            kept[i // span] = after
        after = before(codes[i], after)
    return after, kept, span


def table(codes: str) -> list[int]:
    """Least costs from state (row) to state (column) over a block."""
    columns = [checkpoints(codes, tuple(0 if s == to else FAR for s in range(4)))[0] for to in range(4)]
    return [columns[to][state] for state in range(4) for to in range(4)]


def walk(codes: str, after: tuple, entries: tuple[int, ...] = (START,), last: bool = True) -> list[tuple[str, int, int]]:
    """(ASCII-least cheapest edits, cost of all that follows, state at the end) for every entry state."""
    first, kept, span = checkpoints(codes, after)
    states, out = list(entries), [[] for _ in entries]
    for k, behind in enumerate(kept):
        stretch = codes[k * span:(k + 1) * span]
        costs = [behind]
        for code in reversed(stretch):
            costs.append(before(code, costs[-1]))
        costs.reverse()
        for i, code in enumerate(stretch):
            here, there = costs[i], costs[i + 1]
            for j, state in enumerate(states):
                while True:
                    edit, to = next(((e, t) for e, c, t in EDITS[code][state] if e < "I" and c + there[t] == here[state]), (None, None))
                    if edit is None and INSERT + here[NEXT[state]] == here[state]:
                        out[j].append("I")
                        state = NEXT[state]
                        continue
                    if edit is None:
                        edit, to = next((e, t) for e, c, t in EDITS[code][state] if c + there[t] == here[state])
                    out[j].append(edit)
                    states[j] = to
                    break
    if last:
        for j, state in enumerate(states):
            while END[state]:
                out[j].append("I")
                state = NEXT[state]
            states[j] = state
    return [("".join(o), first[e], s) for o, e, s in zip(out, entries, states)]


def faults(codes: str) -> tuple[int, int, int, int]:
    """(blank, duplicate, truncated turns, neighbours of illegal roles)."""
    kinds = [CODES[c] for c in codes]
    count = lambda name: sum(f == name for _, f in kinds)
    illegal = sum(a[0] + b[0] not in _LEGAL for a, b in zip(kinds, kinds[1:]))
    return count("blank"), count("duplicate"), count("truncated"), illegal


# --- over all conversations

def _narrow(rows: DataFrame) -> DataFrame:
    """The four columns without nulls but in turn and id, and what orders and compares texts in their place."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), F.substring(text, 1, HEAD).alias("head"),
                       F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))


def code_of(role: Column, blank: Column, duplicate: Column, truncated: Column) -> Column:
    initial = F.coalesce(F.nullif(F.instr(F.lit(_INITIALS[:3]), F.nullif(F.substring(role, 1, 1), F.lit(""))), F.lit(0)), F.lit(4)) - 1
    fault = F.when(blank, 1).when(duplicate, 2).when(truncated, 3).otherwise(0)
    return F.char(F.lit(65) + 4 * initial + fault)


def blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks of coded turns with the order key of their first turn, gaps per conversation)."""
    text = F.col("text")
    blank = ~text.rlike(f"[^{SPACE}]")
    ends = text.rlike(f"[.!?][{SPACE}]*\\z")
    narrow = _narrow(rows).select("conv_id", *_KEY, blank.alias("blank"), (~ends).alias("truncated"))
    turns = freeze(row_numbers(narrow, _KEY, "seq", ["conv_id"]))
    same = turns.groupBy("conv_id", "role", "digest").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = same.select(*[F.col(c).alias(f"__{c}") for c in ("conv_id", "role", "digest", "first")])
    coded = turns.join(same, turns["conv_id"].eqNullSafe(same["__conv_id"]) & (turns["role"] == same["__role"])
                       & (turns["digest"] == same["__digest"]), "left")
    code = code_of(F.col("role"), F.col("blank"), F.coalesce(F.col("seq") > F.col("__first"), F.lit(False)), F.col("truncated"))
    ranked = coded.select("conv_id", F.expr(f"(seq - 1) div {BLOCK}").alias("block"), "seq", code.alias("code"), F.struct(*_KEY).alias("key"))
    out = ranked.groupBy("conv_id", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "code"))), lambda x: x["code"]), "").alias("codes"), F.min("key").alias("key"))
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    return out, turns.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_FIRST = ("block bigint, codes string, audit string, entry int, cost bigint, costs array<bigint>, "
          + ", ".join(f"{c} bigint" for c in _COUNTS))


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one block are repaired at once; blocks of longer ones become tables."""
    for batch in batches:
        out = {c: [] for c in ("audit", "entry", "cost", "costs", *_COUNTS)}
        for block, codes in zip(batch.column("block").to_pylist(), batch.column("codes").to_pylist()):
            if block == 0 and len(codes) < BLOCK:
                audit, cost, _ = walk(codes, END)[0]
                found = (audit, START, cost, None)
            else:
                found = (None, None, None, table(codes))
            for name, value in zip(out, (*found, *faults(codes))):
                out[name].append(value)
        types = {"audit": pa.string(), "entry": pa.int32(), "costs": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, types.get(k, pa.int64())) for k, v in out.items()]],
                                         names=[*batch.schema.names, *out])


def _scan_back(blocks_: pa.Table) -> pa.Table:
    """The costs behind every block of a conversation, from the last to the first."""
    rows = blocks_.sort_by("block")
    after, out = END, []
    for costs in reversed(rows.column("costs").to_pylist()):
        out.append(list(after))
        # No costs are closed here: a block's table ends before the turns put in ahead of the next one.
        after = tuple(min(costs[4 * s + t] + after[t] for t in range(4)) for s in range(4))
    last = [False] * (len(out) - 1) + [True]
    return pa.table({"__conv": rows.column("conv_id"), "__block": rows.column("block"), "behind": pa.array(out[::-1], pa.list_(pa.int64())),
                     "last": pa.array(last, pa.bool_())})


def _walk_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        audits, costs, exits = [], [], []
        for codes, behind, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "behind", "last"))):
            found = walk(codes, tuple(behind), (START, SYSTEM, USER, ASSISTANT), last)
            audits.append([f[0] for f in found])
            costs.append(found[START][1])
            exits.append([f[2] for f in found])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(audits, pa.list_(pa.string())), pa.array(costs, pa.int64()), pa.array(exits, pa.list_(pa.int32()))],
                                         names=[*batch.schema.names, "audits", "from_start", "exits"])


def _scan_on(blocks_: pa.Table) -> pa.Table:
    """The state in which every block is entered, and whether its first turn may not follow the turn before."""
    rows = blocks_.sort_by("block")
    state, entries, joints, previous = START, [], [], None
    for exits, first, last in zip(*(rows.column(c).to_pylist() for c in ("exits", "first", "final"))):
        entries.append(state)
        joints.append(0 if previous is None or CODES[previous][0] + CODES[first][0] in _LEGAL else 1)
        state, previous = exits[state], last
    return pa.table({"__conv": rows.column("conv_id"), "__block": rows.column("block"), "into": pa.array(entries, pa.int32()), "joint": pa.array(joints, pa.int64())})


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits of every block with the state it is entered in, gaps per conversation)."""
    coded, gaps = blocks(rows)
    kind = dict(coded.dtypes)["conv_id"]
    fields = ", ".join(f"{c} {t}" for c, t in coded.select("key.*").dtypes)
    flat = coded.select("conv_id", "key.*", "block", "codes")
    solved = freeze(flat.mapInArrow(_first_pass, f"conv_id {kind}, {fields}, {_FIRST}"))
    names = ["conv_id", *_KEY, "block", "audit", "entry", "cost", *_COUNTS]
    done, long = solved.where("audit is not null"), solved.where("audit is null")
    if long.isEmpty():
        return done.select(names), gaps
    on = lambda a, b: a["conv_id"].eqNullSafe(b["__conv"]) & (a["block"] == b["__block"])
    behind = long.select("conv_id", "block", "costs").groupBy("conv_id").applyInArrow(
        _scan_back, f"__conv {kind}, __block bigint, behind array<bigint>, last boolean")
    ahead = long.join(behind, on(long, behind)).drop("__conv", "__block")
    shape = ", ".join(f"{c} {t}" for c, t in ahead.dtypes)
    walked = freeze(ahead.mapInArrow(_walk_all, f"{shape}, audits array<string>, from_start bigint, exits array<int>"))
    into = walked.select("conv_id", "block", "exits", F.substring("codes", 1, 1).alias("first"), F.substring("codes", -1, 1).alias("final")).groupBy(
        "conv_id").applyInArrow(_scan_on, f"__conv {kind}, __block bigint, into int, joint bigint")
    picked = walked.join(into, on(walked, into))
    cost = F.when(F.col("block") == 0, F.col("from_start")).otherwise(0)
    replaced = {"audit": F.col("audits")[F.col("into")], "entry": F.col("into"), "cost": cost, "illegal": F.col("illegal") + F.col("joint")}
    return done.select(names).unionByName(picked.withColumns(replaced).select(names)), gaps


def _replay(batches: Iterator[pa.RecordBatch], emit) -> Iterator[pa.RecordBatch]:
    """Turns of each conversation behind the edits of their block; `emit.turn` gets every turn that stays.

    Only edits that are not yet used, and one batch of texts, are held.
    """
    nobody = object()
    conv, state, waiting = nobody, START, deque()

    def inserts():
        nonlocal state
        while waiting and waiting[0] == "I":
            waiting.popleft()
            state = NEXT[state]
            emit.turn(conv, ROLE[state], "")

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "audit", "text")]
        for who, role, audit, text in zip(*columns):
            if who != conv or conv is nobody:
                if conv is not nobody:
                    inserts()
                    emit.end(conv)
                conv, state = who, START
                waiting.clear()
            if audit is not None:
                waiting.extend(audit)
                continue
            inserts()
            edit = waiting.popleft()
            if edit == "K":
                state = KEPT[role[0]][state]
                emit.turn(conv, role, text)
            elif edit == "R":
                state = NEXT[state]
                emit.turn(conv, ROLE[state], text)
        yield from emit.flush()
    if conv is not nobody:
        inserts()
        emit.end(conv)
    yield from emit.flush()


class _Digests:
    """SHA-256 of the repaired conversation, a turn at a time."""

    schema = "repaired_sha256 string"

    def __init__(self, kind: pa.DataType) -> None:
        self.kind, self.sha, self.any, self.rows = kind, hashlib.sha256(), False, []

    def turn(self, conv, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def end(self, conv) -> None:
        self.rows.append((conv, self.sha.hexdigest()))
        self.sha, self.any = hashlib.sha256(), False

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            convs, shas = zip(*self.rows)
            self.rows = []
            yield pa.RecordBatch.from_arrays([pa.array(convs, self.kind), pa.array(shas, pa.string())], names=["conv_id", "repaired_sha256"])


class _Turns:
    """The repaired turns, numbered from 0."""

    schema = "turn bigint, role string, text string"

    def __init__(self, kind: pa.DataType) -> None:
        self.kind, self.rows, self.n = kind, [], 0

    def turn(self, conv, role: str, text: str) -> None:
        self.rows.append((conv, self.n, role, text))
        self.n += 1

    def end(self, conv) -> None:
        self.n = 0

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = list(zip(*self.rows))
            self.rows = []
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], self.kind), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
                                              pa.array(columns[3], pa.string())], names=["conv_id", "turn", "role", "text"])


def _replayed(rows: DataFrame, pieces: DataFrame, sink: type) -> DataFrame:
    """One shuffle of the texts, sorted behind the edits of their block."""
    null = lambda t: F.lit(None).cast(t)
    keys = ["conv_id", *_KEY, "block"]  # texts have no block number of their own and go last
    texts = _narrow(rows).select("conv_id", *_KEY, F.lit((1 << 63) - 1).alias("block"), null("string").alias("audit"), "text")
    marks = pieces.select("conv_id", *_KEY, "block", "audit", null("string").alias("text"))
    both = marks.unionByName(texts).repartition("conv_id").sortWithinPartitions(*keys)
    kind = dict(rows.dtypes)["conv_id"]
    arrow = both.select("conv_id").limit(0).toArrow().schema.field("conv_id").type
    return both.select("conv_id", "role", "audit", "text").mapInArrow(lambda b: _replay(b, sink(arrow)), f"conv_id {kind}, {sink.schema}")


def repaired(rows: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    """The turns of every conversation after its cheapest repair."""
    return _replayed(rows, plan(rows)[0] if pieces is None else pieces, _Turns)


def repair_report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Faults, cost, edits and digest of every conversation of `ids`, those without a row included."""
    pieces, gaps = plan(rows)
    pieces = freeze(pieces)
    digests = _replayed(rows, pieces, _Digests)
    counts = {"cost": "cost", **{c: c for c in _COUNTS}}
    parts = pieces.select("conv_id", F.struct("block", "audit").alias("piece"), *counts)
    rows_ = ids.select("conv_id").distinct()
    for more in (gaps, parts, digests):
        rows_ = rows_.unionByName(more, allowMissingColumns=True)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["audit"]), "")
    return rows_.groupBy("conv_id").agg(
        zero(F.max("gaps")).alias("gaps"), *[zero(F.sum(c)).alias(c) for c in (*_COUNTS, "cost")], audit.alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
