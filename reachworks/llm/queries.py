"""One registered query per operator, with production parameters over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachworks.llm import alignment, decontaminate, dialogue, exact_dedup, html_text, katz, langid, ngram_join, packing, pii, quality, secrets, toxicity
from reachworks.session import freeze, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            tune(spark)
            return fn(spark, lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def fold(n: int, k: int, doc_id: str = "doc_id") -> F.Column:
    """Whether a row belongs to held-out fold k of n; a null id does."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n == k, F.lit(True))


@query("op1_surrogates")
def op1(spark, table):
    return pii.replace_pii(table("documents"), key="corpus-release-1").select("doc_id", "text", F.array_join("pii_kinds", ",").alias("pii_kinds"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op2_positional_index", sql=rf"""
    WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
         win AS (SELECT DISTINCT item_id, w[i:i + least(len(w), 10) - 1] AS win
                 FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
         sizes AS (SELECT DISTINCT len(win) AS n FROM win),
         d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
         dw AS (SELECT doc_id, i, n, w[i:i + n - 1] AS win
                FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
         m AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (win)),
         hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
         it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
                FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op2(spark, table):
    found = decontaminate.contamination(table("documents"), table("benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op3_exact_dedup", sql=r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
         g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""")
def op3(spark, table):
    groups = exact_dedup.exact_groups(table("documents"), exact_dedup.scratch_index(spark))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op4_tag_path_ratio")
def op4(spark, table):
    return html_text.extract(table("pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@query("op5_kneser_ney_toxicity")
def op5(spark, table):
    docs = table("documents")
    model = toxicity.learn(docs, table("labels").where(~fold(5, 0)))
    return toxicity.score(docs, model).select("doc_id", fold(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "whole", "run")


@query("op6_prefix_tree_join")
def op6(spark, table):
    groups, _ = ngram_join.similar_sets(table("documents"))
    return groups.select("doc_id", "n_shingles", "component_id", "n_links")


@query("op7_hyperdimensional")
def op7(spark, table):
    docs = table("documents")
    return langid.predict(docs, langid.learn(docs.where(~fold(3, 1)))).select(
        "doc_id", fold(3, 1).alias("held_out"), "lang_pred", "score")


@query("op8_katz_backoff")
def op8(spark, table):
    scores, _ = katz.katz_scores(table("documents"), ~fold(7, 2))
    return scores


def _count(kind: str) -> F.Column:
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


@query("op9_secret_scan")
def op9(spark, table):
    return secrets.scan_secrets(table("documents")).select(
        "doc_id", *[_count(k) for k in secrets.KINDS[:secrets.BASE]], F.sha2(secrets.digest_of("secrets", True), 256).alias("base_sha256"),
        secrets.digest_of("secrets", False).alias("spans"))


@query("op10_pack_bounded")
def op10(spark, table):
    return packing.pack_documents(table("documents"))


def _repair_sql() -> str:
    """The least (cost, edits) of each of the four states, turn by turn; the lines that stay travel along."""
    def best(*options: str) -> str:
        return f"list_min(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))"

    def go(state: str, edit: str, cost: str, line: str | None = None, when: str = "true") -> str:
        lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
        return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {lines}}} END"

    own, stays, late = "role || ':' || text", "fault NOT IN ('blank', 'duplicate')", "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    keep = lambda state, initial: go(state, "K", late, own, f"{stays} AND initial = '{initial}'")
    recast = lambda state, role: go(state, "R", f"1 + {late}", f"'{role}:' || text", stays)
    put = lambda state, role: go(state, "I", "5", f"'{role}:'")
    gone = lambda state: go(state, "D", "2")
    after = {"s0": gone("s0"), "s1": best(gone("s1"), keep("s0", "s")),
             "s2": best(gone("s2"), *[f(s, n) for s in ("s0", "s1", "s3") for f, n in ((keep, "u"), (recast, "user"))]),
             "s3": best(gone("s3"), keep("s2", "a"), recast("s2", "assistant"))}
    used = best("s2", *[put(s, "user") for s in ("s0", "s1", "s3")])
    return rf"""
    WITH RECURSIVE bits AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
    k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                     lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, bits),
    hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
    num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, {dialogue.HEAD}), md5(text)) AS seq FROM hurt),
    rows_ AS (SELECT conv_id, turn, role, text, seq, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY seq) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
                     substr(lag(role) OVER (PARTITION BY conv_id ORDER BY seq), 1, 1) || substr(role, 1, 1) AS pair FROM num),
    nothing AS (SELECT {{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}} AS s0),
    walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS seq, s0, CASE WHEN false THEN s0 END AS s1, {put("s0", "user")} AS s2, {put("x", "assistant")} AS s3
             FROM (SELECT DISTINCT conv_id FROM rows_), nothing, (SELECT {put("s0", "user")} AS x FROM nothing)
      UNION ALL SELECT conv_id, seq, s0, s1, s2, {best("s3", put("s2", "assistant"))} FROM (SELECT conv_id, seq, s0, s1, {used} AS s2, s3 FROM (
             SELECT w.conv_id, r.seq, {after["s0"]} AS s0, {after["s1"]} AS s1, {after["s2"]} AS s2, {after["s3"]} AS s3
             FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.seq = w.seq + 1))),
    ends AS (SELECT conv_id, {best("s0", "s3")} AS e FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) = 1),
    stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                     count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id)
    SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(array_to_string(e.t, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ends n ON n.conv_id IS NOT DISTINCT FROM i.conv_id"""


@query("op11_checkpointed_repair", sql=_repair_sql())
def op11(spark, table):
    talks = table("conversations")
    return dialogue.repair_report(dialogue.damage(talks), talks)


@query("op12_pointer_alignment")
def op12(spark, table):
    return alignment.align(table("documents")).drop("groups")


# The rules of `quality` over sketches as tables of bucket counts.
_RATES = {"word_length": "word_chars / n_words", "symbol_share": "n_symbols / n_words", "repeat_share": "n_repeat_words / n_words",
          "dup_line_share": "n_dup_lines / nullif(n_lines, 0)", "capital_share": "n_capitals / word_chars"}


def _sketch_sql(keys: str) -> str:
    at = ", ".join(f"""CASE WHEN min(b) FILTER (upto >= ceil({q} * rows)) = {quality._ZERO} THEN 0.0
        ELSE 2 * power({quality.GAMMA}, min(b) FILTER (upto >= ceil({q} * rows))) / {quality.GAMMA + 1} END AS q{i}""" for i, q in enumerate((0.25, 0.5, 0.75)))
    by = ", ".join(filter(None, (keys, "rule")))
    return f"""SELECT {by}, max(rows) AS rows, {at} FROM (
        SELECT {by}, b, sum(sum(n)) OVER (PARTITION BY {by} ORDER BY b) AS upto, sum(sum(n)) OVER (PARTITION BY {by}) AS rows FROM sk GROUP BY {by}, b) GROUP BY {by}"""


@query("op13_adaptive_quality", sql=rf"""
    WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM documents),
         win AS (SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
         twice AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
         rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN twice USING (doc_id, g)) GROUP BY doc_id),
         m AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                      CAST(length(t) - length(regexp_replace(t, '{quality.SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
                      CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ln) AS n_lines,
                      length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_capitals
               FROM w LEFT JOIN rep USING (doc_id)),
         v AS ({" UNION ALL ".join(f"SELECT doc_id, lang, source, '{r}' AS rule, {e} AS v FROM m WHERE n_words > 0" for r, e in _RATES.items())}),
         sk AS (SELECT lang, source, rule, CASE WHEN v > 0 THEN CAST(ceil(ln(v) / {math.log(quality.GAMMA)!r}) AS INT) ELSE {quality._ZERO} END AS b, count(*) AS n
                FROM v WHERE v IS NOT NULL GROUP BY ALL),
         own AS ({_sketch_sql("lang, source")}), wide AS ({_sketch_sql("lang")}), every AS ({_sketch_sql("")}),
         rules(rule, slack, low) AS (VALUES {", ".join(f"('{r}', {s}, {low})" for r, (s, low) in quality.RULES.items())}),
         lim AS (SELECT o.lang, o.source, rule, slack, low, CASE WHEN o.rows >= {quality.MIN_ROWS} THEN [o.q0, o.q1, o.q2]
                        WHEN l.rows >= {quality.MIN_ROWS} THEN [l.q0, l.q1, l.q2] ELSE [e.q0, e.q1, e.q2] END AS q
                 FROM own o JOIN wide l USING (rule) JOIN every e USING (rule) JOIN rules USING (rule) WHERE o.lang IS NOT DISTINCT FROM l.lang),
         bad AS (SELECT doc_id, string_agg(v.rule, ',' ORDER BY list_position([{", ".join(f"'{r}'" for r in quality.RULES)}], v.rule)) AS broken
                 FROM v JOIN lim ON v.rule = lim.rule AND v.lang IS NOT DISTINCT FROM lim.lang AND v.source IS NOT DISTINCT FROM lim.source
                 WHERE v > q[2] + greatest(slack, {quality.REACH} * abs(q[3] - q[2])) OR low AND v < q[2] - greatest(slack, {quality.REACH} * abs(q[1] - q[2]))
                 GROUP BY doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
           NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND broken IS NULL AS kept, coalesce(broken, '') AS broken
    FROM m LEFT JOIN bad USING (doc_id)""")
def op13(spark, table):
    measured = freeze(quality.measure(table("documents")).select("doc_id", "lang", "source", *quality.COUNTS, "base_failed", "rates"))
    return quality.judge(measured).select("doc_id", *quality.COUNTS, "base_failed", "kept", F.array_join("broken", ",").alias("broken"))
