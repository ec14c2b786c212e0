"""Adaptive quality rules against plain Python."""

from __future__ import annotations

import bisect
import collections
import math
import random
import re
import sys
from pathlib import Path

import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from test_text_operators import SCHEMA, odd_texts  # noqa: E402

from reachworks.llm import quality, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def counts(text):
    """The five counts and two more that the rates need, from their definitions."""
    text = text or ""
    words = brute.spaced_words_as_is(text)
    found = collections.defaultdict(list)
    for i in range(len(words) - 7):
        found[tuple(words[i:i + 8])].append(i)
    inside = {p for at in found.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside)}, len(lines), sum(c.isupper() for c in text if c.isalpha())


def verdicts(rows):
    """kept and broken by the same sketches, each a plain counter."""
    seen, rates = collections.defaultdict(collections.Counter), []
    for r in rows:
        c, lines, capitals = counts(r["text"])
        share = lambda a, b: a / b if b else None
        rate = {"word_length": share(c["word_chars"], c["n_words"]), "symbol_share": share(c["n_symbols"], c["n_words"]),
                "repeat_share": share(c["n_repeat_words"], c["n_words"]), "dup_line_share": share(c["n_dup_lines"], lines),
                "capital_share": share(capitals, c["word_chars"])}
        rates.append((c, rate))
        for rule, v in rate.items():
            if v is not None:
                bucket = math.ceil(math.log(v) / math.log(quality.GAMMA)) if v > 0 else -(1 << 30)
                for group in ((r["lang"], r["source"]), (r["lang"],), ()):
                    seen[group, rule][bucket] += 1

    def at(counter, share):
        keys = sorted(counter)
        sums = [0]
        for k in keys:
            sums.append(sums[-1] + counter[k])
        b = keys[bisect.bisect_left(sums, math.ceil(share * sums[-1])) - 1]
        return 0.0 if b == -(1 << 30) else 2 * quality.GAMMA ** b / (quality.GAMMA + 1)

    out = []
    for r, (c, rate) in zip(rows, rates):
        broken = []
        for rule, (slack, low) in quality.RULES.items():
            if rate[rule] is None:
                continue
            group = next(g for g in ((r["lang"], r["source"]), (r["lang"],), ())
                         if not g or sum(seen[g, rule].values()) >= quality.MIN_ROWS)
            q = [at(seen[group, rule], s) for s in (0.25, 0.5, 0.75)]
            high, floor = q[1] + max(slack, quality.REACH * (q[2] - q[1])), q[1] - max(slack, quality.REACH * (q[1] - q[0]))
            if rate[rule] > high or low and rate[rule] < floor:
                broken.append(rule)
        failed = c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]
        out.append({"doc_id": r["doc_id"], **c, "base_failed": failed, "kept": not failed and not broken, "broken": ",".join(broken)})
    return out


def test_query_equals_plain_python(spark):
    rows = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    got = queries.QUERIES["op13_adaptive_quality"](spark, FOLDER).toArrow().to_pylist()
    assert sorted(got, key=lambda r: r["doc_id"]) == sorted(verdicts(rows), key=lambda r: r["doc_id"])


def test_clean_documents_stay_and_junk_goes(spark):
    folder = "/root/testdata/sf0.01"
    good = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    got = queries.QUERIES["op13_adaptive_quality"](spark, folder).toArrow().to_pylist()
    clean = [r["kept"] for r in got if good.get(r["doc_id"]) == 1 and not r["base_failed"]]
    junk = [r["kept"] for r in got if good.get(r["doc_id"]) == 0]
    assert sum(clean) > 0.99 * len(clean) and sum(junk) < 0.5 * len(junk)


def repeated_texts():
    rng = random.Random(5)
    few = ["a b", "c", "dd", "é x", " "]
    return ["", "a b c d e f g h a b c d e f g h", "a " * 8, "a " * 9, "x y " * 40, "one\n\none\n \none", "\n", "# * $%&|<>", "ÀÉ ÑÜ ß",
            *[" ".join(rng.choices(few, k=rng.randrange(60))) for _ in range(40)]]


def test_counts_on_hard_texts(spark):
    texts = [*odd_texts(), *repeated_texts()]
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", None, "d", 1, "g", 0.5) for i, t in enumerate(texts)]
    got = quality.measure(spark.createDataFrame([*rows, rows[-1]], SCHEMA)).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        want, _, _ = counts(texts[r["doc_id"]])
        assert {c: r[c] for c in quality.COUNTS} == want, texts[r["doc_id"]][:80]


def test_extra_columns_nulls_ties_and_empty_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, rates string, n_words string, kept string, limits string, rule string, n bigint"
    rows = [(None, "a b", None, None, "r", "w", "k", "l", "u", 1)] * 3 + [(1, None, None, "s", "r", "w", "k", "l", "u", 1)] + [
        (2, " ".join(f"w{i}" for i in range(30)), "en", "s", "r", "w", "k", "l", "u", 1)] * 2
    docs = spark.createDataFrame(rows, schema)
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and [r["doc_id"] for r in good.collect()] == [2, 2]
    judged = quality.judge(quality.measure(docs))
    assert judged.count() == 6 and {r["limits"] for r in judged.collect()} == {"l"}
    assert quality.keep_good(docs.limit(0)).collect() == []


def test_sketches_merge(spark):
    measured = quality.measure(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    whole = quality.sketch(measured)
    parts = [quality.sketch(measured.where(f"doc_id % 3 = {k}")) for k in range(3)]
    assert sorted(map(str, quality.merge(*parts).collect())) == sorted(map(str, whole.collect()))
    exact = measured.selectExpr("percentile_disc(0.5) within group (order by rates.word_length) as m").first()["m"]
    q = {r["rule"]: r["q"] for r in quality.quantiles(whole, ()).collect()}
    assert q["word_length"][1] == pytest.approx(exact, rel=0.011)


def test_limits_follow_the_group(spark):
    """One symbol a word is usual in one source and not in the other."""
    word = lambda i, mark: " ".join(f"w{i}x{k}{mark}" for k in range(40))
    rows = [(i, word(i, "#"), "en", "marked") for i in range(300)] + [(1000 + i, word(i, ""), "en", "plain") for i in range(300)] + [
        (5000, word(5000, "#"), "en", "plain"), (5001, word(5001, ""), "en", "marked")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.keep_good(docs).collect()}
    assert kept == {r[0] for r in rows} - {5000}
