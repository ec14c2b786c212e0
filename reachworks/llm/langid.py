"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, each rotated
by its place; a document bundles (adds) the vectors of its n-grams; a language bundles its documents, scaled to unit
length. A text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachworks.llm import tokens
from reachworks.session import freeze

DIMENSIONS = 1024
NGRAM = 3
SEED = 7
CHUNK_BYTES = 1 << 18
CHUNK_DOCS = 256
COLUMNS = 4096  # n-grams whose vectors are held at once
UNKNOWN = "und"

_letters: list[np.ndarray] = []
_vectors: dict[tuple[int, int], np.ndarray] = {}


def _fold_table() -> np.ndarray:
    """Code point -> lower-case letter, or a space for everything that is no letter."""
    if not _letters:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                table[c] = ord(ch.lower()[0])
        _letters.append(table)
    return _letters[0]


def _letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    out = np.empty((len(points), dimensions), np.int8)
    for i, c in enumerate(points.tolist()):
        vector = _vectors.get((c, dimensions))
        if vector is None:
            vector = _vectors[c, dimensions] = (np.random.Generator(np.random.PCG64([SEED, c])).integers(0, 2, dimensions) * 2 - 1).astype(np.int8)
        out[i] = vector
    return out


def _ngrams(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(alphabet, n-grams as rows of letter indexes, document of each, letters in each document)."""
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[bounds]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(starts))
    c = _fold_table()[points]
    letters = np.bincount(doc[c != 32], minlength=len(bounds) - 1)
    # One space between words and at both ends of each document: ends go in before the next document's start.
    at, own = np.append(starts[1:], starts[:-1]), np.tile(np.arange(len(bounds) - 1), 2)
    c, doc = np.insert(c, at, 32), np.insert(doc, at, own)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (doc[1:] != doc[:-1])
    c, doc = c[keep], doc[keep]
    present = np.bincount(c, minlength=1) > 0
    alphabet = np.flatnonzero(present)
    index = (np.cumsum(present) - 1)[c]
    n = max(0, len(c) - NGRAM + 1)
    whole = doc[:n] == doc[NGRAM - 1:]
    return alphabet, np.stack([index[k:n + k][whole] for k in range(NGRAM)], axis=1), doc[:n][whole], letters


def bundle(buf: np.ndarray, bounds: np.ndarray, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(documents x dimensions sums of n-gram vectors, letters in each document)."""
    out = np.zeros((len(bounds) - 1, dimensions), np.float32)
    alphabet, grams, doc, letters = _ngrams(buf, bounds)
    if not len(grams):
        return out, letters
    base = len(alphabet)
    code = grams[:, 0].astype(np.int64)
    for k in range(1, NGRAM):
        code = code * base + grams[:, k]
    if base ** NGRAM <= 1 << 22:
        used = np.bincount(code, minlength=base ** NGRAM) > 0
        unique, inverse = np.flatnonzero(used), (np.cumsum(used) - 1)[code]
    else:
        unique, inverse = np.unique(code, return_inverse=True)
    vectors = _letter_vectors(alphabet, dimensions)
    turned = [np.roll(vectors, NGRAM - 1 - k, axis=1) for k in range(NGRAM)]
    for low in range(0, len(unique), COLUMNS):
        some = unique[low:low + COLUMNS]
        bound = np.ones((len(some), dimensions), np.int8)
        rest = some
        for k in reversed(range(NGRAM)):
            bound *= turned[k][rest % base]
            rest = rest // base
        if len(unique) <= COLUMNS:
            cells = doc * len(some) + inverse
        else:
            own = (inverse >= low) & (inverse < low + len(some))
            cells = doc[own] * len(some) + inverse[own] - low
        counts = np.bincount(cells, minlength=len(out) * len(some)).reshape(len(out), len(some))
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out, letters


def _chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for k in range(0, len(column), CHUNK_DOCS):
        for first, buf, bounds in tokens.byte_chunks(column.slice(k, CHUNK_DOCS), CHUNK_BYTES):
            yield k + first, buf, bounds


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit prototypes by language, over all rows with a language; rows without letters add nothing."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            langs = part.column(1).to_pylist()
            for first, buf, bounds in _chunks(part.column(0)):
                vectors, _ = bundle(buf, bounds, dimensions)
                size = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)
                own = langs[first:first + len(vectors)]
                for name in set(own):
                    sums[name] = sums.get(name, 0) + vectors[[x == name for x in own]].sum(axis=0, dtype=np.float64)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[x].tolist() for x in names], pa.list_(pa.float64()))], ["lang", "sums"])

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).cast("string"), F.col(lang).cast("string")).mapInArrow(run, "lang string, sums array<double>")
    # One number a language, dimension and task reaches the shuffle; the result is languages x dimensions.
    total = freeze(rows.select("lang", F.posexplode("sums").alias("d", "v")).groupBy("lang", "d").agg(F.sum("v").alias("v")))
    out: dict[str, np.ndarray] = {}
    for r in total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("s")).collect():
        vector = np.array([x["v"] for x in r["s"]])
        out[r["lang"]] = vector / (np.linalg.norm(vector) or 1.0)
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (cosine, negative ones as 0).

    Null and empty texts, texts without a letter, and all texts when nothing was learned, are `und` with score 0; equal
    cosines go to the language that sorts first. Repeated rows are each scored.
    """
    names = sorted(prototypes)
    table = np.stack([prototypes[x] for x in names], axis=1).astype(np.float32) if names else np.zeros((dimensions, 0), np.float32)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, buf, bounds in _chunks(part.column(1)):
                vectors, letters = bundle(buf, bounds, dimensions)
                k = len(vectors)
                pred, score = np.full(k, UNKNOWN, object), np.zeros(k)
                if names:
                    size = np.linalg.norm(vectors, axis=1)
                    cosine = (vectors @ table) / np.where(size > 0, size, 1)[:, None]
                    best = cosine.argmax(axis=1)
                    live = letters > 0
                    pred[live] = np.array(names, object)[best[live]]
                    score[live] = np.clip(cosine[np.arange(k), best], 0, 1)[live]
                yield pa.RecordBatch.from_arrays([part.column(0)[first:first + k], pa.array(pred.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")
