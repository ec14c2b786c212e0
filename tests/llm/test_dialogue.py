"""Repair of conversations against a plain search for the least (cost, edits)."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest

from reachworks.llm import dialogue, queries

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def hurt(rows):
    out = []
    for r in rows:
        conv, turn = (" " if r[c] is None else r[c] for c in ("conv_id", "turn"))
        role, text = (" " if r[c] is None else r[c] for c in ("role", "text"))
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(r["conv_id"], r["turn"], "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def least(rows):
    """(cost, edits) over every way to a sound conversation, state by state, and the turns that stay."""
    grammar = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def with_inserts(best):
        for _ in range(2):
            for state, (cost, edits, lines) in list(best.items()):
                for initial, to in grammar[state].items():
                    if initial in names:
                        new = (cost + 5, edits + "I", lines + (f"{names[initial]}:",))
                        best[to] = min(best.get(to, new), new)
        return best

    best = with_inserts({"": (0, "", ())})
    for role, text, fault in rows:
        after = {}
        for state, (cost, edits, lines) in best.items():
            options = [(cost + 2, edits + "D", lines, state)]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role[:1] in grammar[state]:
                    options.append((cost + extra, edits + "K", lines + (f"{role}:{text}",), grammar[state][role[:1]]))
                options += [(cost + extra + 1, edits + "R", lines + (f"{names[i]}:{text}",), to) for i, to in grammar[state].items() if i in names]
            for *new, to in options:
                after[to] = min(after.get(to, tuple(new)), tuple(new))
        best = with_inserts(after)
    return min(best[s] for s in ("", "a") if s in best)


def report(rows, ids):
    talks = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn, role, text))
    out = {}
    for conv in ids:
        t = sorted(talks[conv], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2][:dialogue.HEAD], hashlib.md5(x[2].encode()).digest()))
        seen, marked, counts = set(), [], collections.Counter()
        for turn, role, text in t:
            body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = ("blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen
                     else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, fault))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, edits, lines = least(marked)
        numbers = [x[0] for x in t if x[0] is not None]
        out[conv] = {"gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, **{c: counts[c] for c in ("blank", "duplicate", "truncated")},
                     "illegal": illegal, "cost": cost, "audit": edits, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(), "lines": lines}
    return out


def same(got, want):
    assert len(got) == len(want)
    for r in got:
        r = r.asDict() if hasattr(r, "asDict") else r
        assert {k: v for k, v in r.items() if k != "conv_id"} == {k: v for k, v in want[r["conv_id"]].items() if k != "lines"}


def test_query_equals_plain_search(spark):
    rows = pq.read_table(f"{FOLDER}/conversations.parquet").to_pylist()
    got = queries.QUERIES["op11_checkpointed_repair"](spark, FOLDER).toArrow().to_pylist()
    same(got, report(hurt(rows), {r["conv_id"] for r in rows}))


def odd_rows(rng, convs, turns):
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["Yes.", "No", "", " \t", None, "Why? ", "a. b", "long " * 9 + "one.", "long " * 9 + "two!", "é!"]
    return [(rng.choice([*range(convs), None]), rng.choice([*range(turns), None]), rng.choice(roles), rng.choice(texts)) for _ in range(convs * turns)]


@pytest.mark.parametrize("block", [1, 2, 3, 5, 4096])
def test_blocks_of_any_length(spark, monkeypatch, block):
    rows = odd_rows(random.Random(block), 12, 14)
    # Blocks are cut in tasks too, so the length goes there with the functions.
    real = dialogue._first_pass

    def first_pass(batches, block=block):
        dialogue.BLOCK = block
        yield from real(batches)

    monkeypatch.setattr(dialogue, "BLOCK", block)
    monkeypatch.setattr(dialogue, "_first_pass", first_pass)
    table = spark.createDataFrame(rows, SCHEMA)
    want = report([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], {r[0] for r in rows})
    same(dialogue.repair_report(table, table).collect(), want)
    turns = collections.defaultdict(list)
    for r in sorted(dialogue.repaired(table).collect(), key=lambda r: r["turn"]):
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert dict(turns) == {k: list(v["lines"]) for k, v in want.items() if v["lines"]}


def test_walk_takes_the_least_edits_of_every_short_run():
    rng = random.Random(3)
    for _ in range(3000):
        codes = "".join(rng.choice(list(dialogue.CODES)) for _ in range(rng.randrange(12)))
        marked = [({"s": "system", "u": "user", "a": "assistant", "-": "tool"}[i], "x", f) for i, f in (dialogue.CODES[c] for c in codes)]
        audit, cost, _ = dialogue.walk(codes, dialogue.END)[0]
        assert (cost, audit) == least(marked)[:2]


def test_empty_lost_and_wide_tables(spark):
    schema = SCHEMA + ", block string, audit string, seq int, code string, digest string"
    rows = [(1, 0, "user", "Hi.", "b", "a", 1, "c", "d"), (1, 1, "assistant", "Ho.", "b", "a", 1, "c", "d")]
    table = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], schema)
    ids = spark.createDataFrame([(1,), (2,), (None,)], "conv_id bigint")
    got = {r["conv_id"]: r for r in dialogue.repair_report(table, ids).collect()}
    assert got[1]["audit"] == "KK" and got[2]["audit"] == got[None]["audit"] == "" and got[2]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert dialogue.repair_report(none, none).collect() == [] and dialogue.repaired(none).collect() == []
    assert dialogue.damage(none).collect() == []


def test_long_conversation(spark):
    """Ten thousand turns of one conversation cross blocks; a text of 2 MB passes through."""
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(10_000)]
    rows[5000] = (7, 5000, "user", "word " * 400_000 + ".")
    rows[9000] = (7, 9000, "user", "cut")
    table = spark.createDataFrame(rows, SCHEMA)
    same(dialogue.repair_report(table, table).collect(), report(rows, [7]))
