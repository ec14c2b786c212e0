"""Alignment of two tokenisers against whole texts, token by token."""

from __future__ import annotations

import collections
import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from test_text_operators import SCHEMA, odd_texts  # noqa: E402

from reachworks.llm import alignment, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def coders():
    return alignment.ByteLevel(), alignment.Pieces()


def spans(ids, pieces):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(pieces[i])))
        at = out[-1][1]
    return out


def plain(texts, coders):
    """Every column of every text by comparing all pairs of tokens of one text."""
    a, b = coders
    linked, each = collections.Counter(), []
    for text in texts:
        ids_a = ids_b = []
        if text:
            whole = " " + text
            ids_a = a.tokenizer.encode(whole, add_special_tokens=False).ids
            ids_b = b.processor.encode(text)
            if not all(b"".join(c.pieces[i] for i in ids) == whole.encode() for c, ids in ((a, ids_a), (b, ids_b))):
                ids_a = ids_b = []
        at_a, at_b = spans(ids_a, a.pieces), spans(ids_b, b.pieces)
        links, k = [], 0
        for i, (s, e) in enumerate(at_a):
            while k and at_b[k][0] >= s:
                k -= 1
            while at_b[k][1] <= s:
                k += 1
            j = k
            while j < len(at_b) and at_b[j][0] < e:
                links.append((ids_a[i], ids_b[j]))
                j += 1
        ends = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, i, j = [], 0, 0
        for end in ends:
            x, y = [], []
            while i < len(at_a) and at_a[i][1] <= end:
                x.append(ids_a[i])
                i += 1
            while j < len(at_b) and at_b[j][1] <= end:
                y.append(ids_b[j])
                j += 1
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        linked.update(set(links))
        text_of = ";".join(groups)
        each.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(text_of.encode()).hexdigest() if text_of else "", text_of))
    top = collections.Counter()
    for (x, _), n in linked.items():
        top[x] = max(top[x], n)
    return [(na, nb, ng, len(ls), sum(linked[p] == top[p[0]] for p in ls), sum(linked[p] for p in ls), sha, g) for na, nb, ng, ls, sha, g in each]


def rows(df):
    cols = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")
    return sorted((str(r["doc_id"]), *(r[c] for c in cols)) for r in df.collect())


def hard_texts():
    rng = random.Random(11)
    marks = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "日", "▁", "'s", ".", "1", " ", "　", "́", "😀", "<0x0A>", "</s>", "<|endoftext|>", "\r", "\x00", "\x1c", "ﬁ"]
    return [*[t for t in odd_texts() if t is None or len(t) < 20_000], " x", "x ", " ", "▁", "a▁b c", "word " * 50 + "▁ end", "<s>", "<|endoftext|> x", "a" * 3000,
            *["".join(rng.choices(marks, k=rng.randrange(40))) for _ in range(300)]]


@pytest.mark.parametrize("chunk", [1, 300, 1 << 22])
def test_hard_texts(spark, coders, chunk):
    texts = hard_texts()
    table = spark.createDataFrame([(i, t, None, None, None, "d", 1, "g", 0.5) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    want = sorted((str(i), *w) for i, w in enumerate(plain(texts, coders)))
    assert rows(alignment.align(table, keep_groups=True, chunk_bytes=chunk)) == want


def test_query_equals_whole_texts(spark, coders):
    docs = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    want = {d["doc_id"]: w for d, w in zip(docs, plain([d["text"] for d in docs], coders))}
    got = queries.QUERIES["op12_pointer_alignment"](spark, FOLDER).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) == want[r["doc_id"]][:7]


def test_repeated_null_and_empty(spark):
    table = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, "")], "doc_id bigint, text string")
    got = rows(alignment.align(table))
    assert [r[1:7] for r in got] == [(0,) * 6] * 2 + [(2, 2, 2, 2, 2, 4)] * 2 and got[0][7] == ""
    assert alignment.align(table.limit(0)).collect() == []


def test_cache_begins_anew(coders, monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_BYTES", 10)
    aligner = alignment.Aligner(*coders)
    for text in ("some words here", "other words there", "some words here"):
        raw = np.frombuffer(text.encode(), np.uint8)
        _, _, groups = aligner.chunk(raw, np.array([0, len(raw)]))
        assert groups[0].decode() == plain([text], coders)[0][7]
    assert aligner.bytes < 40


def test_pointers_meet_at_the_last_token():
    """A staircase of overlaps is one group; it takes as many doublings as the logarithm of its length."""
    n = 1000
    end_a = np.append(np.arange(1, n) * 2, 2 * n)
    end_b = np.append(np.arange(1, n) * 2 + 1, 2 * n)
    start = lambda e: np.concatenate([[0], e[:-1]])
    group_a, group_b, of_a, of_b = alignment.link(start(end_a), end_a, start(end_b), end_b)
    assert len(set(group_a) | set(group_b)) == 1 and len(of_a) == 2 * n - 1


def test_no_token_crosses_a_cut(coders):
    assert not [p for p in coders[1].pieces if b" " in p.lstrip(b" ")]
    text = " ".join(r["text"] for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()[:20])
    raw = np.frombuffer(text.encode(), np.uint8)
    assert alignment.Aligner(*coders).chunk(raw, np.array([0, len(raw)]))[2][0].decode() == plain([text], coders)[0][7]
