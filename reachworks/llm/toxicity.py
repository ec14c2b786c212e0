"""Toxicity by two class-conditional Kneser-Ney models of words' spelling.

A word is a run of bytes between boundaries; each byte is predicted from up to five before it. The top order is counted
for toxic and for ordinary text apart; where a class has not seen a continuation it backs off, by absolute
discounting, to continuation counts that both classes share, so a rare expression weighs only as far as its spelling
has told the classes apart. A text is judged by log-likelihood ratios divided by the length they are summed over: of
the whole text, and of its most telling run of words. A logistic curve, fitted on documents kept out of the counts,
turns the two into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachworks.llm import tokens
from reachworks.session import freeze

ORDER = 6  # bytes, the predicted one included
DISCOUNT = 0.75
RUN_WORDS = 4
SAMPLE = 6000  # labelled documents of each class, at most, that the models are fitted on
COUNTED = 2 / 3  # of these are counted; the others fit the curve

_BOUNDARY = 32


def spelled(w: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """(code of each predicted byte with those before it, offset of each word's codes).

    A word of k bytes has k + 1 codes, the last for its end. A code packs up to ORDER bytes, the predicted one lowest;
    bytes before the word's start are 0.
    """
    size = w.ends - w.starts
    at = np.concatenate([[0], np.cumsum(size + 2)])
    flat = np.full(at[-1], _BOUNDARY, np.int64)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(at[:-1] + 1, size) + step] = tokens.LOWER[w.buf[np.repeat(w.starts, size) + step]]
    inside = np.arange(at[-1]) - np.repeat(at[:-1], size + 2)
    code = flat.copy()
    for k in range(1, ORDER):
        before = np.zeros_like(flat)
        before[k:] = flat[:-k] if k else flat
        code |= np.where(inside >= k, before, 0) << (8 * k)
    return code[inside > 0], at - np.arange(len(at))


def _length(code: np.ndarray) -> np.ndarray:
    n = np.zeros(len(code), np.int64)
    for k in range(ORDER):
        n += code >> (8 * k) > 0
    return n


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float = 0.0) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[spot] == wanted, values[spot], missing)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return (unique, *[np.bincount(inverse, v, len(unique)) for v in values])


@dataclass
class Ratio:
    """log P(byte | before, toxic) - log P(byte | before, ordinary), by code, and by what stands before for codes unseen."""

    codes: np.ndarray
    values: np.ndarray
    contexts: np.ndarray
    fallback: np.ndarray
    weights: np.ndarray | None = None  # of the curve: constant, whole text, most telling run

    def of(self, code: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(code))
        spot = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[spot] == code, self.values[spot], _at(self.contexts, self.fallback, code >> 8))

    def features(self, w: tokens.Words) -> np.ndarray:
        """(documents x 2): the ratio per byte of the whole text, and the largest over runs of RUN_WORDS words; 0 without words."""
        out = np.zeros((len(w.at) - 1, 2))
        if not len(w.starts):
            return out
        _, one, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        some = tokens.Words(0, w.buf, w.bounds, w.starts[one], w.ends[one], np.array([0, len(one)]))
        code, at = spelled(some)
        word = np.add.reduceat(self.of(code), at[:-1])[inverse]
        size = (w.ends - w.starts + 1).astype(float)
        total, length = np.concatenate([[0], np.cumsum(word)]), np.concatenate([[0], np.cumsum(size)])
        live = np.flatnonzero(w.n > 0)
        a, b = w.at[live], w.at[live + 1]
        out[live, 0] = (total[b] - total[a]) / (length[b] - length[a])
        end = np.minimum(np.arange(len(word)) + RUN_WORDS, np.repeat(w.at[1:], w.n))
        start = np.maximum(end - RUN_WORDS, np.repeat(w.at[:-1], w.n))
        out[live, 1] = np.maximum.reduceat((total[end] - total[start]) / (length[end] - length[start]), a)
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.weights[0] + features @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def ratio_model(code: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Ratio:
    """Kneser-Ney models from counts by code."""
    order = np.argsort(code)
    code, toxic, ordinary = code[order].astype(np.int64), toxic[order].astype(float), ordinary[order].astype(float)
    size = _length(code)
    # Counts of each length, longest first: raw for what begins a word, else the number of different bytes before.
    levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    above = code[size == ORDER]
    for k in range(ORDER - 1, 0, -1):
        begins = size == k
        shorter, n = _sums(above & ((1 << (8 * k)) - 1), np.ones(len(above)))
        keys, counts = _sums(np.concatenate([code[begins], shorter]), np.concatenate([(toxic + ordinary)[begins], n]))
        levels[k], above = (keys, counts), keys
    # Shared probabilities, shortest first.
    known: dict[int, np.ndarray] = {}
    for k in range(1, ORDER):
        keys, counts = levels[k]
        context, total, kinds = _sums(keys >> 8, counts, np.ones(len(keys)))
        a, t = _at(context, total, keys >> 8), _at(context, kinds, keys >> 8)
        lower = np.full(len(keys), 1 / 256) if k == 1 else _at(levels[k - 1][0], known[k - 1], keys & ((1 << (8 * (k - 1))) - 1), 1e-9)
        known[k] = (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * t * lower) / a
    shared = np.full(len(code), 1 / 256)
    for k in range(2, ORDER + 1):
        own = size == k
        shared[own] = _at(levels[k - 1][0], known[k - 1], code[own] & ((1 << (8 * (k - 1))) - 1), 1e-9)
    logs, rests = [], []
    contexts = np.unique(code >> 8)
    for counts in (toxic, ordinary):
        context, total, kinds = _sums(code >> 8, counts, (counts > 0).astype(float))
        rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        share = _at(context, total, code >> 8)
        top = np.where(share > 0, np.maximum(counts - DISCOUNT, 0) / np.maximum(share, 1), 0)
        logs.append(np.log(top + _at(context, rest, code >> 8) * shared))
        rests.append(np.log(rest))
    return Ratio(code, logs[0] - logs[1], contexts, rests[0] - rests[1])


def fit_curve(features: np.ndarray, toxic: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps; a constant of the class share alone where one class is missing."""
    if not len(toxic) or toxic.min() == toxic.max():
        share = float(toxic.mean()) if len(toxic) else 0.0
        return np.array([np.log((share + 0.01) / (1.01 - share)), 0.0, 0.0])
    x, beta = np.column_stack([np.ones(len(features)), features]), np.zeros(3)
    weight = weight / weight.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (toxic - p)) - ridge * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(curve, slope)
        beta = beta + step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        toxic = part.column(1).to_numpy(False).astype(bool)
        for w in tokens.words_of(part.column(0), tokens.ALNUM):
            code, at = spelled(w)
            mark = np.repeat(np.repeat(toxic[w.first:w.first + len(w.n)], w.n), np.diff(at))
            keys, t, o = _sums(code, mark.astype(float), 1.0 - mark)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(t), pa.array(o)], ["code", "toxic", "ordinary"])


def _features(model: Ratio):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for w in tokens.words_of(part.column(1), tokens.ALNUM):
                f = model.features(w)
                own = part.column(0)[w.first:w.first + len(f)]
                yield pa.RecordBatch.from_arrays([own, pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(model.score(f) if model.weights is not None else f[:, 0])],
                                                 ["doc_id", "whole", "run", "score"])
    return run


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Ratio:
    """Fit on at most `sample` labelled documents of each class, chosen by a hash of their ids; null labels are left out."""
    named = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("bigint").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__toxic"))
    texts = docs.select(F.col(doc_id).cast("bigint").alias("__id"), F.col(text).cast("string").alias("__text")).where("__id is not null")
    named = freeze(named)
    totals = {r["__toxic"]: r["n"] for r in named.groupBy("__toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for value in (0, 1):
        some = named.where(F.col("__toxic") == value).orderBy(F.xxhash64("__id"), "__id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    # At most twice `sample` ids are broadcast.
    picked = freeze(texts.join(F.broadcast(chosen), "__id").withColumn("__counted", F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(1000)) < int(1000 * COUNTED)))
    counts = (picked.where("__counted").select("__text", "__toxic").mapInArrow(_counts, "code bigint, toxic double, ordinary double")
              .groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toArrow())
    model = ratio_model(*[counts.column(k).to_numpy() for k in range(3)])
    rest = picked.where("not __counted")
    seen = rest.select("__id", "__text").mapInArrow(tokens.tidy(_features(model)), "doc_id bigint, whole double, run double, score double")
    seen = seen.join(F.broadcast(chosen), seen["doc_id"] == chosen["__id"]).select("whole", "run", "__toxic").toArrow()
    toxic = seen.column(2).to_numpy().astype(float)
    share = np.array([totals.get(0, 0), totals.get(1, 0)], float) / np.maximum(1, np.array([(toxic == 0).sum(), (toxic == 1).sum()]))
    model.weights = fit_curve(np.column_stack([seen.column(0).to_numpy(), seen.column(1).to_numpy()]), toxic, share[toxic.astype(int)] if len(toxic) else toxic)
    return model


def score(docs: DataFrame, model: Ratio, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, whole, run (ratios per byte) and score.

    Null and empty texts and texts without words have ratios of 0 and the score of that; repeated rows are each scored.
    """
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        _features(model), "doc_id bigint, whole double, run double, score double")


def keep_ordinary(docs: DataFrame, model: Ratio, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns; nothing is shuffled."""
    place = docs.columns.index(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            low = [model.score(model.features(w)) < threshold for w in tokens.words_of(part.column(place), tokens.ALNUM)]
            if low:
                yield part.filter(pa.array(np.concatenate(low)))

    return docs.mapInArrow(tokens.tidy(run), docs.schema)
