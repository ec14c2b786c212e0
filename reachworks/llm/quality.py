"""Quality rules whose limits come from the documents themselves.

Five measures of every text are summed up per language and source in mergeable quantile sketches: a positive value v
falls in bucket ceil(log v / log GAMMA), zero in a bucket of its own, and a sketch is the table of bucket counts. Two
sketches merge by adding counts, in any order and with the same result, and a quantile read from one is wrong by at
most half of GAMMA - 1 of its value. A rule's limits lie REACH times the distance from the median to a quartile away
from the median, and never nearer than the rule's slack, so a source of even style does not lose its odd but clean
documents. Groups of fewer than MIN_ROWS documents take the limits of their language, small languages those of all
documents: sums of the same sketches. The limits are joined to the documents by language and source.

Everything is a DataFrame expression; there is no Python in the tasks.

Defined results: a null text has no words and counts as empty; a text without words has no rates and takes no part in
sketches; null languages and sources form groups of their own; repeated rows are judged each; an empty table gives an
empty table. Columns named like an output are replaced. Eight-word windows are compared by 64-bit hashes within one
text, so two different windows of a text of n words are taken for equal with a chance of about n*n / 2**65.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachworks.session import freeze

GAMMA = 1.02
MIN_ROWS = 200
REACH = 6.0
MIN_WORDS = 20
WINDOW = 8
SPACE = r"\x20\x09-\x0D"
SYMBOLS = "[#*$%&|<>]"

# Rule: (least distance of a limit from the median, whether small values fail too).
RULES = {
    "word_length": (2.5, True),  # code points a word
    "symbol_share": (0.1, False),  # symbols a word
    "repeat_share": (0.2, False),  # words in repeated windows, of all words
    "dup_line_share": (0.5, False),  # lines seen before, of lines with a word
    "capital_share": (0.25, False),  # capital letters, of code points in words
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ZERO = -(1 << 30)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(starts: Column) -> Column:
    """Words inside windows that begin at these sorted places."""
    steps = F.transform(starts, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - at, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + step)


def _repeated(windows: Column) -> Column:
    """Places of the windows that occur more than once, in order: equal hashes are neighbours once sorted."""
    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(ranked, lambda r: F.array_sort(F.transform(
        F.filter(r, lambda e, j: F.coalesce((F.get(r, j + 1)["h"] == e["h"]) | (F.get(r, j - 1)["h"] == e["h"]),
                                            F.get(r, j + 1)["h"] == e["h"], F.get(r, j - 1)["h"] == e["h"], F.lit(False))),
        lambda e: e["i"])))


def repeat_words(words: Column) -> Column:
    """Words in windows of eight that the text holds twice or more, the first ones included."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
    # Few texts repeat a window, and only those are sorted.
    repeats = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), let(_repeated(w), _covered)).otherwise(F.lit(0).cast("bigint"))
    return F.when(F.size(words) > WINDOW, let(hashes, lambda h: let(windows(h), repeats))).otherwise(F.lit(0).cast("bigint"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the five counts, a verdict on the two fixed rules and the rates that the sketches take."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(f"[^{SPACE}]+"), F.lit(0))
    lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))
    long = lambda c: c.cast("bigint")
    counts = let(words, lambda w: let(lines, lambda n: F.struct(
        long(F.size(w)).alias("n_words"), long(F.length(F.array_join(w, ""))).alias("word_chars"),
        long(F.regexp_count(t, F.lit(SYMBOLS))).alias("n_symbols"), long(F.size(n) - F.size(F.array_distinct(n))).alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words"), long(F.size(n)).alias("n_lines"), long(F.regexp_count(t, F.lit(r"\p{Lu}"))).alias("n_capitals"))))
    out = docs.drop(*COUNTS, "base_failed", "rates").withColumn("rates", counts)
    c = F.col("rates")
    per = lambda a, b: F.try_divide(c[a], c[b])
    rates = {"word_length": per("word_chars", "n_words"), "symbol_share": per("n_symbols", "n_words"), "repeat_share": per("n_repeat_words", "n_words"),
             "dup_line_share": per("n_dup_lines", "n_lines"), "capital_share": per("n_capitals", "word_chars")}
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
    return out.select(*[x for x in out.columns if x != "rates"], *[c[x].alias(x) for x in COUNTS], failed.alias("base_failed"),
                      F.struct(*[rates[r].alias(r) for r in RULES]).alias("rates"))


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): the sketch of every rule in every group; sketches of more rows merge with `merge`."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col("rates")[r].alias("v")) for r in RULES])).alias("p")
    rows = measured.select("lang", "source", pairs).select("lang", "source", "p.rule", "p.v").where("v is not null")
    bucket = F.when(F.col("v") > 0, F.ceil(F.ln("v") / math.log(GAMMA)).cast("int")).otherwise(F.lit(_ZERO))
    return rows.groupBy("lang", "source", "rule", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    """One sketch of all rows that went into several."""
    out = sketches[0]
    for more in sketches[1:]:
        out = out.unionByName(more)
    return out.groupBy("lang", "source", "rule", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: tuple[str, ...], shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(keys, rule, rows, q) of sketches merged over everything but the keys; q has one value a share.

    A merged sketch has at most some thousand buckets, whatever went into it, so a window over it stays small.
    """
    merged = sketches.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "rule")
    ranked = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "rows": F.sum("n").over(w)})
    middle = lambda b: F.when(b == _ZERO, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), b) / (GAMMA + 1))
    at = [middle(F.min(F.when(F.col("upto") >= F.ceil(F.lit(s) * F.col("rows")), F.col("bucket")))) for s in shares]
    return ranked.groupBy(*keys, "rule").agg(F.max("rows").alias("rows"), F.array(*at).alias("q"))


def limits(sketches: DataFrame) -> DataFrame:
    """(lang, source, limits): for each group a map from rule to its lowest and highest good value."""
    named = lambda keys, tag: (lambda q: q.select(*[F.col(c).alias(f"{tag}_{c}") for c in q.columns]))(quantiles(sketches, keys))
    own, wide, every = quantiles(sketches, ("lang", "source")), named(("lang",), "lang"), named((), "all")
    both = own.join(wide, F.col("lang").eqNullSafe(F.col("lang_lang")) & (F.col("rule") == F.col("lang_rule"))).join(
        F.broadcast(every), F.col("rule") == F.col("all_rule"))  # one row a rule
    q = F.when(F.col("rows") >= MIN_ROWS, F.col("q")).when(F.col("lang_rows") >= MIN_ROWS, F.col("lang_q")).otherwise(F.col("all_q"))
    slack = F.create_map(*[F.lit(x) for r, (s, _) in RULES.items() for x in (r, s)])[F.col("rule")]
    both_ways = F.col("rule").isin([r for r, (_, low) in RULES.items() if low])
    rows = both.select("lang", "source", "rule", q.alias("q"), slack.alias("slack"), both_ways.alias("both_ways"))
    away = lambda quartile: F.greatest(F.col("slack"), F.lit(REACH) * F.abs(F.col("q")[quartile] - F.col("q")[1]))
    bound = F.struct(F.when(F.col("both_ways"), F.col("q")[1] - away(0)).alias("low"), (F.col("q")[1] + away(2)).alias("high"))
    return rows.select("lang", "source", "rule", bound.alias("b")).groupBy("lang", "source").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "b"))).alias("limits"))


def judge(measured: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """The measured documents with `kept` and `broken`, the rules that a document breaks; `measured` is read twice."""
    found = limits(sketch(measured) if sketches is None else sketches).select(
        F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col("limits").alias("__limits"))
    rows = measured.drop("kept", "broken")
    rows = rows.join(found, rows["lang"].eqNullSafe(found["__lang"]) & rows["source"].eqNullSafe(found["__source"]), "left")
    checks = []
    for rule in RULES:
        b, v = F.col("__limits")[rule], F.col("rates")[rule]
        checks.append(F.when((v > b["high"]) | F.coalesce(v < b["low"], F.lit(False)), F.lit(rule)))
    broken = F.array_compact(F.array(*checks))
    out = rows.withColumn("broken", broken).drop("__lang", "__source", "__limits")
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents, with their own columns, that break neither a fixed nor an adaptive rule."""
    return judge(freeze(measure(docs))).where("kept").select(docs.columns)
