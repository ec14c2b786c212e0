"""Each operator against plain Python, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from reachworks.llm import (components, decontaminate, exact_dedup, html_text, katz, langid, ngram_join, packing, pii, queries, secrets,  # noqa: E402
                            tokens, toxicity)

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, n bigint, grams string, score double"


def rows_of(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


DOCS = rows_of("documents")


def odd_texts():
    long = " ".join(f"word{i % 977} x{i}" for i in range(30_000))
    base = " ".join(f"alpha{i}" for i in range(60))
    return [None, "", " \t\n", ".,;", "a", "A  b\tc", "a b c", long, long, base, base + " tail", base.replace("alpha3 ", "beta "), "日本語 テキスト ünï", "x" * 5000,
            "same text here again five", "same text here again five"]


@pytest.fixture(scope="module")
def odd(spark):
    """Hard texts with columns whose names the operators use themselves; the last row comes twice."""
    rows = [(i, t, None if i % 3 else "en", None, None, "d", 1, "g", 0.5) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame([*rows, rows[-1]], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def run(spark, name):
    return queries.QUERIES[name](spark, FOLDER).toArrow().to_pylist()


def pairs(rows=DOCS):
    return [(r["doc_id"], r["text"]) for r in rows]


# --- words and hashes

@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_words_and_shingles(limit):
    texts = [t for t in odd_texts() if t is None or len(t) < 6000] + [r["text"] for r in DOCS[:30]]
    for table, words_of in ((tokens.NOT_SPACE, brute.spaced_words), (tokens.ALNUM, brute.alnum_words)):
        want, got = [words_of(t) for t in texts], []
        for w in tokens.words_of(pa.array(texts), table, limit=limit):
            got += [w.hashes[a:b].tolist() for a, b in zip(w.at[:-1], w.at[1:])]
        assert got == [[tokens.hash_one(x) for x in t] for t in want]
    sizes = []
    for w in tokens.words_of(pa.array(texts), tokens.NOT_SPACE, limit=limit):
        _, at, _ = ngram_join.ngram_sets(w, 5)
        sizes += np.diff(at).tolist()
    assert sizes == [len({tuple(t[k:k + 5]) for k in range(max(1, len(t) - 4))}) if t else 0 for t in map(brute.spaced_words, texts)]


# --- 1 personal data

def test_surrogates(spark, odd, none):
    texts = ["Mail Bob.Lee@mail1.example.com or +1 (456) 555-2186.", "bob.lee@mail1.example.com; 456-555-2186, Mr. John Smith, Mrs. Smith", None, "", "no data 12 34",
             "4111 1111 1111 1111 and 4041894974608795", "IBAN DE89 3704 0044 0532 0130 00", "ip 42.144.35.254", "ip 42.144.35.254"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, surface string")
    got = {r["doc_id"]: r for r in pii.replace_pii(df, "k").collect()}
    assert len(got) == len(texts) and got[2]["text"] is None and got[3]["text"] == "" and got[4]["text"] == texts[4] and got[0]["surface"] == "x"
    mail = [re.search(r"\S+@[\w.]+\w", got[i]["text"])[0] for i in (0, 1)]
    assert mail[0] == mail[1] and mail[0] != "bob.lee@mail1.example.com" and mail[0].endswith(".com")
    phones = [re.sub(r"\D", "", re.search(r"[+(\d][\d ()+-]{9,}\d", got[i]["text"])[0])[-10:] for i in (0, 1)]
    assert phones[0] == phones[1] != "4565552186" and got[0]["text"][-18:-13] == "+1 (" + got[0]["text"][-14]
    first, second = re.findall(r"Mrs?\. ([\w ]+)", got[1]["text"])
    assert first.split()[1] == second != "Smith" and first.split()[0] in pii.GIVEN["latin", "m"]
    card = re.sub(r"\D", "", got[5]["text"][:19])
    assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(card))) % 10 == 0 and card[0] == "4"
    iban = got[6]["text"][5:].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert got[7]["text"] == got[8]["text"] != texts[7]
    assert pii.replace_pii(odd, "k").count() == odd.count() and pii.replace_pii(none, "k").count() == 0
    # Few forms: all differ, and none is a real one.
    many = spark.createDataFrame([("given", f"name{i}", "n") for i in range(200)], "kind string, canon string, gender string")
    names = [r["surrogate"] for r in pii.surrogate_table(many, "k").collect()]
    assert len(set(names)) == 200


def test_surrogates_never_run_out(spark):
    """More values than names in the lists, and more than one-letter addresses at hosts of one letter."""
    few = "авекмнорст"
    names = [("given", f"имя{few[i // 1000]}{few[i // 100 % 10]}{few[i // 10 % 10]}{few[i % 10]}", "n") for i in range(2000)]
    mails = [("email", f"{a}@{b}.com", "n") for a in "_ab" for b in "abcdefghijklmnopqrstuvwxyz"]
    got = pii.surrogate_table(spark.createDataFrame(names + mails, "kind string, canon string, gender string"), "k").collect()
    assert {(r["kind"], r["canon"]) for r in got} == {x[:2] for x in names + mails}
    assert len({(r["kind"], r["surrogate"]) for r in got}) == len(got) == len(names + mails)
    assert not {(r["kind"], r["surrogate"]) for r in got} & {x[:2] for x in names + mails}


def test_surrogate_query(spark):
    got = {r["doc_id"]: r for r in run(spark, "op1_surrogates")}
    known = re.compile(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<!\d)\d{16}(?!\d)|(?<![\d.])\d+\.\d+\.\d+\.\d+(?![\d.])")
    found = collections.defaultdict(set)
    for r in DOCS:
        said = known.findall(r["text"] or "")
        assert not [x for x in said if x in got[r["doc_id"]]["text"]]
        assert said or got[r["doc_id"]]["pii_kinds"] or got[r["doc_id"]]["text"] == r["text"]
        for x in said:
            found[x].add(r["doc_id"])
    assert found and len(got) == len(DOCS)


# --- 2 decontamination

def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "alpha0 alpha1 alpha2 Alpha3 alpha4 alpha5 alpha6 alpha7 alpha8 alpha9 alpha10"), (2, "X1 word2"), (3, None), (4, ""), (3, "b"), (3, "b"), (None, "五")],
                                  "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(odd, items).collect()}
    want = brute.contaminated(list(enumerate(odd_texts())), [("" if r["item_id"] is None else r["item_id"], r["text"]) for r in items.collect()])
    assert {i: (r["n_words"], r["n_hit"], r["items"]) for i, r in got.items()} == want
    assert decontaminate.contamination(odd, items).count() == odd.count()
    assert decontaminate.contamination(none, items).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(odd, items.where("false")).collect())
    kept = decontaminate.decontaminate(odd, items)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {i for i, v in want.items() if not v[1]}


def test_proximity_and_passes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two x three four"), (2, "four three two one"), (3, "one two three four")], "doc_id bigint, text string")
    index = decontaminate.build_index(docs)
    items = spark.createDataFrame([("p", "one two three four"), ("q", "two three")], "item_id string, text string")
    phrases = decontaminate.phrases_of(items, 4)
    named = {r["doc"]: r["doc_id"] for r in decontaminate.documents_of(index).collect()}
    find = lambda slack: {(named[r["doc"]], x) for r in decontaminate.find_phrases(index, phrases, slack).collect() for x in r["items"]}
    assert find(None) == {(3, "p"), (3, "q")}
    assert find(1) == {(3, "p"), (3, "q"), (1, "p"), (1, "q")}
    monkeypatch.setattr(decontaminate, "PHRASES_PER_PASS", 1)
    assert find(None) == {(3, "p"), (3, "q")}


def test_decontamination_in_many_tasks(spark):
    docs = spark.range(0, 520, 1, 520).selectExpr("id AS doc_id", "CASE WHEN id % 100 = 19 THEN concat('x', id, ' one two three') ELSE concat('two ', id) END AS text")
    items = spark.createDataFrame([("p", "one two three")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {i: (4, 3) if i % 100 == 19 else (2, 0) for i in range(520)}


# --- 3 exact copies

def test_exact_dedup(spark, odd, none):
    got = exact_dedup.exact_groups(odd, exact_dedup.scratch_index(spark)).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], bytes(r["digest"]).hex()) for r in got) == brute.exact(rows)
    assert sum(r["kept"] for r in got) == len({bytes(r["digest"]) for r in got})
    kept = exact_dedup.exact_dedup(odd, exact_dedup.scratch_index(spark))
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({r["keep_id"] for r in got})
    assert exact_dedup.exact_groups(none, exact_dedup.scratch_index(spark)).count() == 0


def test_index_outlives_batches(spark, odd):
    index = exact_dedup.scratch_index(spark)
    exact_dedup.exact_dedup(odd.where("doc_id < 7"), index).count()
    again = exact_dedup.DigestIndex(spark, index.path)
    assert sorted(r["doc_id"] for r in exact_dedup.exact_dedup(odd, again).collect()) == [7, 9, 10, 11, 12, 13, 14]
    assert "SortMergeJoin" in again.unseen(odd.selectExpr("unhex(sha2(text, 256)) AS digest"))._jdf.queryExecution().toString()


def test_a_batch_may_come_again(spark, odd):
    index = exact_dedup.scratch_index(spark)
    first, second = odd.where("doc_id < 7"), odd.where("doc_id >= 4")
    rows = lambda docs, batch, at=index: sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_groups(docs, at, batch=batch).collect())
    one, two = rows(first, "monday"), rows(second, "tuesday")
    # As after a job that failed when only part of its digests were in: the rest is added, the rows are the same.
    assert rows(first, "monday") == one and rows(second, "tuesday") == two and sum(k for _, _, k in one) > 0
    assert not any(k for _, _, k in rows(first, "wednesday"))
    digests = index.plain().groupBy("digest").count()
    assert digests.where("count > 1").isEmpty()
    grown = index.compact(index.path + "-grown", 128)
    assert grown.plain().count() == digests.count() and rows(second, "tuesday", grown) == two
    assert exact_dedup.DigestIndex(spark, grown.path).buckets == 128
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, index.path, 128)


# --- 4 pages

def test_pages(spark, none):
    page = ('<html><head><title>t</title><script>var x = "</p>";</script></head><body class="has-sidebar"><div class="header">Site</div><ul class="menu"><li><a href=x>Home</a><li><a>News</a></ul>'
            '<div class=content><h1>A  title</h1><p>First &amp; long paragraph, with\n marks; it goes on, and on.</p><p>Short.<ul><li>One<li>Two</ul><p>Last long paragraph, with marks; it ends here.</div>'
            '<div class="sidebar"><p>Read more, always more, from us.</p></div><div id="comments"><p>I think this is great, really, I do.</p></div><form><p>Sign up, now.</p></form><footer>c</footer></body></html>')
    want = "A title\nFirst & long paragraph, with marks; it goes on, and on.\nShort.\nOne\nTwo\nLast long paragraph, with marks; it ends here."
    texts = [page, None, "", "plain", "<p>a<p>b", "<nav>x</nav>", "<p" * 3000, "<!-- open", page]
    df = spark.createDataFrame([(i, "u", t, "z") for i, t in enumerate(texts)], "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 5, 7, 8)] == [want, "", "", "plain", "a\nb", "", "", want]
    assert html_text.extract(df.where("false")).count() == 0


def test_page_query(spark):
    import html as entities
    got = {r["page_id"]: r for r in run(spark, "op4_tag_path_ratio")}
    for r in rows_of("pages"):
        body = re.search(r"(?s)<article>(.*?)(?:</article>|<footer|$)", r["html"])[1]
        want = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", body)]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in want if b) and got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


# --- 5 toxicity

def test_toxicity(spark, odd, none):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(60)]
        if i % 5 == 0:
            text[rng.randrange(60)] = "vile" + rng.choice(words)
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 5 == 0)))
    docs, labels = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels.where("doc_id < 300"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 5 == 0) for i in range(300, 400)]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, model).collect()) and toxicity.score(none, model).count() == 0
    assert toxicity.keep_ordinary(odd, model).columns == odd.columns
    blank = toxicity.learn(none, labels.where("false"))
    assert all(r["score"] == pytest.approx(0.0099, abs=1e-3) for r in toxicity.score(odd, blank).collect())


def test_spelling_probabilities_sum_to_one():
    w = next(tokens.words_of(pa.array(["abra cadabra abba", "bad idiot bad"]), tokens.ALNUM))
    code, _ = toxicity.spelled(w)
    keys, n = np.unique(code, return_counts=True)
    model = toxicity.ratio_model(keys, n, np.zeros(len(n)))
    # Against a class of no counts at all the ratio is P / shared; it must average to one under the shared model's own weight.
    assert np.isfinite(model.values).all() and np.isfinite(model.fallback).all()


# --- 6 near copies

def test_prefix_tree():
    rng = random.Random(5)
    pool = list(range(1, 60))
    sets = [sorted(rng.sample(pool, rng.randint(1, 20))) for _ in range(300)]
    sets += [s[:k] + s[k + 1:] for s in sets[:60] for k in (0, len(s) // 2) if len(s) > 1]
    for probe in sets[:80]:
        tree = ngram_join.PrefixTree(sorted(((s, i) for i, s in enumerate(sets)), key=lambda x: x[0]))
        got = dict(tree.matches({g: k for k, g in enumerate(probe)}, len(probe), 75))
        want = {i: len(set(s) & set(probe)) for i, s in enumerate(sets) if 100 * len(set(s) & set(probe)) >= 75 * len(set(s) | set(probe))}
        assert got == want


def test_near_copies(spark, odd, none, monkeypatch):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(80)]
    texts = odd_texts()
    for i in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = f"z{rng.randrange(9)}"
        texts.append(" ".join(t))
    passage = " ".join(f"p{i}" for i in range(20))
    texts += [passage + " " + " ".join(f"q{k}_{i}" for i in range(40)) for k in range(20)] + ["Alpha0 one two", "alpha0 one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute.components(list(enumerate(texts)))
    for grams, hot in ((ngram_join.BLOCK_GRAMS, ngram_join.HOT_COUNT), (500, 1)):  # clusters in one block, and in many
        monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", grams)
        monkeypatch.setattr(ngram_join, "HOT_COUNT", hot)
        groups, _ = ngram_join.similar_sets(docs)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in groups.collect()} == want
    assert ngram_join.similar_sets(none)[0].count() == 0 and ngram_join.similar_sets(odd)[0].count() == odd.count()
    kept = ngram_join.near_dedup(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_number_of_links(spark, monkeypatch):
    """Every similar pair of different sets is counted, also within a family and with rows that come twice."""
    rng = random.Random(8)
    texts = []
    for k in range(2):
        base = [f"v{k}_{i}" for i in range(90)]
        for _ in range(30):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"z{rng.randrange(9)}"
            texts.append(" ".join(t))
    rows = list(enumerate(texts))
    sets = {" ".join(t): frozenset(tuple(t[k:k + 5]) for k in range(len(t) - 4)) for t in map(brute.spaced_words, texts)}
    kinds = set(sets.values())
    alike = lambda x, y: 100 * len(x & y) >= ngram_join.PERCENT * len(x | y)
    want = {i: sum(alike(sets[t], y) for y in kinds) - 1 for i, t in rows}
    assert max(want.values()) > 5
    for grams in (ngram_join.BLOCK_GRAMS, 500):
        monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", grams)
        groups, _ = ngram_join.similar_sets(spark.createDataFrame(rows + rows[:9], "doc_id bigint, text string"))
        assert {r["doc_id"]: r["n_links"] for r in groups.collect()} == want


def test_null_id_before_an_equal_text(spark):
    base = [f"u{i}" for i in range(60)]
    rows = [(None, " ".join(base)), (1, " ".join(base)), (2, " ".join(base + ["tail"]))]
    groups, _ = ngram_join.similar_sets(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1))
    assert {r["doc_id"]: (r["component_id"], r["n_links"]) for r in groups.collect()} == {None: (None, None), 1: (1, 1), 2: (1, 1)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    up = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: c for x, c in up.items() if any(x in e and e[0] != e[1] for e in edges)}


# --- 7 languages

def test_languages(spark, odd, none):
    got = run(spark, "op7_hyperdimensional")
    lang = {r["doc_id"]: r["lang"] for r in DOCS}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]) > 0.95
    assert all(r["held_out"] == brute.held(r["doc_id"], 3, 1) and 0 <= r["score"] <= 1 for r in got)
    seen = {r["doc_id"]: r for r in langid.predict(odd, langid.learn(odd)).collect()}
    assert [seen[i]["lang_pred"] for i in (0, 1, 2, 3)] == ["und"] * 4 and seen[4]["lang_pred"] == "en"
    assert langid.learn(none) == {} and {r["lang_pred"] for r in langid.predict(odd, {}).collect()} == {"und"}


def test_bundles_bind_and_rotate():
    buf = np.frombuffer("Ab c".encode(), np.uint8)
    got, letters = langid.bundle(buf, np.array([0, 4]), 64)
    v = {c: langid._letter_vectors(np.array([ord(c)]), 64)[0] for c in " abc"}
    want = sum(np.roll(v[x], 2) * np.roll(v[y], 1) * v[z] for x, y, z in (" ab", "ab ", "b c", " c "))
    assert (got[0] == want).all() and letters.tolist() == [3]


# --- 8 Katz

def test_katz(spark, odd, none):
    want, (uni, start, q) = brute.katz(pairs(), lambda n: katz.good_turing(np.array(n)), katz.LEVEL, katz.EPSILON)
    for r in run(spark, "op8_katz_backoff"):
        n, known, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, sum(uni.values()), brute.held(r["doc_id"], 7, 2))
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)
    for v in list(start)[:3]:
        assert sum(q(v, w) for w in [*uni, "never seen"]) == pytest.approx(1, abs=1e-9)


def test_katz_splits_a_large_pair(spark, monkeypatch):
    """A third of the rows empty, a third one short copy: no bucket has most of a pair, and the model stays the same."""
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 100)
    texts = [(i, ("", "the same copy", f"w{i} the w{i % 7} x")[i % 3]) for i in range(1200)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(40)
    learned = ~queries.fold(7, 2)
    want, _ = brute.katz(texts, lambda n: katz.good_turing(np.array(n)), katz.LEVEL, katz.EPSILON)
    scores, tables = katz.katz_scores(docs, learned)
    for r in scores.collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]][3], rel=1e-9)
    found = [x for r in tables["bigrams"].collect() for x in zip(np.repeat(np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.uint32)).tolist(), katz._from_six(r["c"]).tolist())]
    assert len(found) == len(set(found))
    rows = docs.select("doc_id", learned.cast("int").alias("learned"), "text")
    words = rows.select("learned", "text").mapInArrow(katz._count_words(12), katz._ROW).groupBy("bucket").applyInArrow(katz._sum_words(50), katz._ROW).localCheckpoint()
    pairs = katz._large_pairs(rows, words, 50)
    assert max(x[3] for x in pairs) == 400  # (START, END)
    dealt = rows.mapInArrow(katz._deal_tokens(60, katz._large_words(words), pairs, 100), katz._ROW).where("kind = 'tokens'")
    held = collections.Counter()
    for r in dealt.collect():
        held[r["bucket"]] += len(r["c"]) // 6
    assert max(held.values()) < 400


def test_katz_odd_rows(spark, odd, none, monkeypatch):
    import pyspark.sql.functions as F
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want, _ = brute.katz(rows, lambda n: katz.good_turing(np.array(n)), katz.LEVEL, katz.EPSILON)
    for size in (katz.BUCKET_TOKENS, 500):  # small buckets split frequent words
        monkeypatch.setattr(katz, "BUCKET_TOKENS", size)
        got = katz.katz_scores(odd, ~queries.fold(7, 2))[0].collect()
        assert len(got) == odd.count()
        assert all(r["score"] == pytest.approx(want[r["doc_id"]][3], rel=1e-9) and r["base_score"] == pytest.approx(want[r["doc_id"]][2], rel=1e-9) for r in got)
    assert katz.katz_scores(none, ~queries.fold(7, 2))[0].count() == 0
    assert {r["score"] for r in katz.katz_scores(odd, F.lit(False))[0].collect()} == {0.0}


# --- 9 secrets

def test_secrets(spark, odd, none):
    body = "0123456789abcdefghijklmnopqrst"
    good = "ghp_" + body + secrets.checksum62(body)
    texts = ["password = 'abcdef' PassWord:abc token=token=abcdefgh api_key\"=\"x1y2z3w4", "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 15, "é " + "ab" * 12 + " " + "c" * 23, good, good[:-1] + "!", None, "", "ſecret=abcdefgh toKen: x.y-z_+/="]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["secrets"]] for r in secrets.scan_secrets(df).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s.split(":")[0] in ("assign", "access", "hex")] == brute.base_spans(t)
    assert got[3] == [f"github:0:{len(good)}"] and got[4] == []
    assert secrets.scan_secrets(odd).count() == odd.count() and secrets.scan_secrets(none).count() == 0
    for r in run(spark, "op9_secret_scan"):
        spans = brute.base_spans(next(d["text"] for d in DOCS if d["doc_id"] == r["doc_id"]))
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex"))


# --- 10 packing

def packed_ok(got, rows):
    encoder = packing.Encoder()
    want = {i: [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for i, t in rows}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = np.array(want[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4")
        assert r["length"] > 0 and r["doc_tokens"] == len(want[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(ids.tobytes())
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, ids in want.items():
        copies = sum(d == i for d, _ in rows)
        assert sum(n for _, n in by_doc[i]) == copies * len(ids)
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= packing.LENGTH
    return sum(len(t) for t in want.values()), len(by_sequence)


def test_packing(spark, odd, none):
    total, sequences = packed_ok(run(spark, "op10_pack_bounded"), pairs())
    assert sequences <= -(-total // packing.LENGTH) * 1.05 + 1
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    packed_ok([r.asDict() for r in packing.pack_documents(odd.repartition(5)).collect()], rows)
    assert packing.pack_documents(none).count() == 0
    assert packing.pack_documents(odd, keep_ids=True).where("length(ids) <> 4 * length").count() == 0


def test_encoder_is_the_tokenizer():
    rng = random.Random(1)
    letters = list("abAB '’.,!0129<|>éÉßİſΣσ日本\t\n\r\x0b\x0ć̈{}@-") + ["<|endoftext|>", "<|startoftext|>", " the ", "it's "]
    for special in (letters, letters[:-4]):
        texts = ["".join(rng.choice(special) for _ in range(rng.randrange(60))) for _ in range(400)]
        encoder, got = packing.Encoder(), []
        for _, ids, at in encoder.documents(pa.array(texts)):
            got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        assert got == [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]


# --- pipeline

def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{FOLDER}/labels.parquet").where(~queries.fold(5, 0)))
    low = {r["doc_id"] for r in toxicity.score(docs, model).where("score < 0.5").collect()}
    rows = [(i, t) for i, t in pairs() if i in low]
    keep = {k for _, k, _, _ in brute.exact(rows)}
    rows = [(i, t) for i, t in rows if i in keep]
    groups = brute.components(rows)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    hits = brute.contaminated(rows, [(r["item_id"], r["text"]) for r in rows_of("benchmark")])
    rows = [(i, t) for i, t in rows if not hits[i][1]]
    got = [r.asDict() for r in corpus_pipeline.run(spark, FOLDER).collect()]
    assert {r["doc_id"] for r in got} == {i for i, _ in rows} and len(rows) < len(DOCS)
    packed_ok(got, rows)
