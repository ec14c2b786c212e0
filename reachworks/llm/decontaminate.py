"""Benchmark decontamination by a positional inverted index.

The index is a Parquet table of blocks, each a bounded run of whole documents: sorted term hashes, and for every term
the ascending positions at which it stands in the block. It is partitioned by document, so a phrase is matched inside
its block without a shuffle: take the positions of the phrase's rarest term, shift them to where the phrase would
begin, and intersect with the lists of the other terms, again shifted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachworks.llm import tokens
from reachworks.session import freeze

BLOCK_BYTES = 1 << 20
WIDTH = 10
PHRASES_PER_PASS = 100_000  # phrases sent to the executors at once; more take further passes over the index
CANDIDATES_AT_ONCE = 1 << 20

INDEX_SCHEMA = "block bigint, doc_ids array<bigint>, doc_at binary, terms binary, at binary, positions binary"
_INDEX = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *[(n, pa.binary()) for n in ("doc_at", "terms", "at", "positions")]])


def _planes(values: np.ndarray) -> bytes:
    """32-bit steps between neighbours, byte plane by byte plane: sorted lists compress well so."""
    return np.ascontiguousarray(np.diff(values.astype(np.int32), prepend=np.int32(0)).view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.int32).ravel(), dtype=np.int32).astype(np.int64)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Index every word of every document; written to `path`, or to the shared folder. Null or empty texts have no words."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 30
        for part in parts:
            names = part.column(0).to_pylist()
            for w in tokens.words_of(part.column(1), tokens.ALNUM, limit=BLOCK_BYTES):
                order = np.argsort(w.hashes, kind="stable")
                terms, at = np.unique(w.hashes[order], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((
                    [block], [names[w.first:w.first + len(w.at) - 1]], [_planes(w.at)], [terms.tobytes()],
                    [_planes(np.append(at, len(order)))], [_planes(order)]), _INDEX)], schema=_INDEX)
                block += 1

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tokens.tidy(run), INDEX_SCHEMA)
    if path is None:
        return freeze(rows)
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(path)


class Block:
    """One block of the index in memory."""

    def __init__(self, row: dict) -> None:
        self.doc_ids, self.doc_at = row["doc_ids"], _from_planes(row["doc_at"])
        self.terms, self.at = np.frombuffer(row["terms"], np.uint64), _from_planes(row["at"])
        self.positions = _from_planes(row["positions"])
        # Ascending (term, position) keys: a list is a slice, membership is one binary search.
        self.size = max(1, len(self.positions))
        self.keys = np.repeat(np.arange(len(self.terms)), np.diff(self.at)) * self.size + self.positions

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each term in this block, -1 if it does not occur."""
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        spot = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[spot] == hashes, spot, -1)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_at, position, "right") - 1

    def _rarest(self, hashes: np.ndarray, length: np.ndarray):
        """Candidates (phrase, position of its rarest term, index of that term) in bounded portions."""
        inside = np.arange(hashes.shape[1]) < length[:, None]
        rank = np.where(inside, self.ranks(hashes), -1)
        live = np.flatnonzero(((rank >= 0) | ~inside).all(axis=1) & (length > 0))
        rank = rank[live]
        count = np.where(inside[live], np.diff(self.at)[rank] if len(self.terms) else 0, np.iinfo(np.int64).max)
        rare = count.argmin(axis=1)
        few = count[np.arange(len(live)), rare]
        total, a = np.cumsum(few), 0
        while a < len(live):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CANDIDATES_AT_ONCE, "right")))
            row = np.repeat(np.arange(a, b), few[a:b])
            first = self.at[rank[np.arange(a, b), rare[a:b]]]
            step = np.arange(len(row)) - np.repeat(np.cumsum(few[a:b]) - few[a:b], few[a:b])
            yield live[row], rank[row], rare[row], self.positions[np.repeat(first, few[a:b]) + step]
            a = b

    def exact(self, hashes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of each exact occurrence within one document."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for phrase, rank, rare, position in self._rarest(hashes, length):
            start, n = position - rare, length[phrase]
            keep = (start >= 0) & (start + n <= self.size)
            for k in range(hashes.shape[1]):
                phrase, rank, rare, start, n = phrase[keep], rank[keep], rare[keep], start[keep], n[keep]
                if not len(phrase):
                    break
                want = rank[:, k] * self.size + start + k
                spot = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
                keep = (k >= n) | (self.keys[spot] == want)
            if len(phrase):
                keep &= self.document(start) == self.document(start + n - 1)
                found.append((phrase[keep], start[keep]))
        return tuple(np.concatenate(c) for c in zip(*found))

    def near(self, hashes: np.ndarray, length: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position of its rarest term) where every other term stands within `slack` words of its place."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for phrase, rank, rare, position in self._rarest(hashes, length):
            doc = self.document(position)
            low, high = self.doc_at[doc], self.doc_at[doc + 1] - 1
            keep = np.ones(len(phrase), bool)
            for k in range(hashes.shape[1]):
                place = position + k - rare
                a, b = np.maximum(place - slack, low), np.minimum(place + slack, high)
                base = rank[:, k] * self.size
                keep &= (k >= length[phrase]) | ((a <= b) & (np.searchsorted(self.keys, base + a) < np.searchsorted(self.keys, base + b, "right")))
            found.append((phrase[keep], position[keep]))
        return tuple(np.concatenate(c) for c in zip(*found))


def phrases_of(items: DataFrame, width: int = WIDTH, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of `width` words (terms, items): an item of fewer words, but not none, is one window."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            names = part.column(0).to_pylist()
            for w in tokens.words_of(part.column(1), tokens.ALNUM):
                ids, runs = [], []
                for d, (a, b) in enumerate(zip(w.at[:-1].tolist(), w.at[1:].tolist())):
                    windows = {w.hashes[i:min(i + width, b)].tobytes() for i in range(a, max(a + 1, b - width + 1))} if b > a else ()
                    ids += [names[w.first + d]] * len(windows)
                    runs += windows
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(runs, pa.binary())], ["item", "terms"])

    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text")).mapInArrow(run, "item string, terms binary")
    return rows.groupBy("terms").agg(F.collect_set(F.coalesce("item", F.lit(""))).alias("items"))


# A document is its block and its row there, two numbers side by side: no task number or block size can make them meet.
DOC = "struct<block: bigint, row: bigint>"
HITS_SCHEMA = f"doc {DOC}, spans array<struct<start: bigint, end: bigint>>, items array<string>"


def _docs(block: int, rows: list[int] | np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(np.full(len(rows), block, np.int64)), pa.array(rows, pa.int64())], ["block", "row"])


def find_phrases(index: DataFrame, phrases: DataFrame, slack: int | None = None) -> DataFrame:
    """Matches by document (doc = block and row in it, spans in word positions, items); only documents with any.

    `slack` None asks for exact phrases; a number for proximity, each term at most so many words from its place, with
    the span of one position. Phrases are sent in passes of bounded size, so any number of them can be searched.
    """
    spark: SparkSession = index.sparkSession
    phrases = freeze(phrases)
    n = phrases.count()
    passes = -(-n // PHRASES_PER_PASS)
    out = None
    for k in range(passes):
        some = phrases if passes == 1 else phrases.where(F.pmod(F.xxhash64("terms"), F.lit(passes)) == k)
        rows = some.collect()
        width = max((len(r["terms"]) // 8 for r in rows), default=1)
        hashes, length = np.zeros((len(rows), width), np.uint64), np.array([len(r["terms"]) // 8 for r in rows], np.int64)
        for i, r in enumerate(rows):
            hashes[i, :length[i]] = np.frombuffer(r["terms"], np.uint64)
        sent = spark.sparkContext.broadcast((hashes, length, [r["items"] for r in rows]))
        hits = index.mapInArrow(tokens.tidy(_search(sent, slack)), HITS_SCHEMA)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], HITS_SCHEMA)
    return out if passes == 1 else out.groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _search(sent, slack: int | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, length, items = sent.value
        for part in parts:
            for i in range(part.num_rows):
                row = {name: part.column(k)[i].as_py() for k, name in enumerate(part.schema.names)}
                block = Block(row)
                phrase, start = block.exact(hashes, length) if slack is None else block.near(hashes, length, slack)
                doc = block.document(start)
                size = length[phrase] if slack is None else np.ones(len(phrase), np.int64)
                order = np.lexsort((start, doc))
                docs, spans, named = [], [], []
                for d, at in zip(*_runs(doc[order])):
                    own = order[at[0]:at[1]]
                    base = int(block.doc_at[d])
                    docs.append(d)
                    spans.append(_merged((start[own] - base).tolist(), size[own].tolist()))
                    named.append(sorted({x for p in np.unique(phrase[own]).tolist() for x in items[p]}))
                yield pa.RecordBatch.from_arrays([_docs(row["block"], docs), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                                                  pa.array(named, pa.list_(pa.string()))], ["doc", "spans", "items"])
    return run


def _runs(values: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    if not len(values):
        return [], []
    at = np.flatnonzero(np.diff(values, prepend=values[0] - 1))
    return values[at].tolist(), list(zip(at.tolist(), [*at[1:].tolist(), len(values)]))


def _merged(starts: list[int], sizes: list[int]) -> list[dict]:
    out: list[dict] = []
    for s, n in zip(starts, sizes):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s + n)
        else:
            out.append({"start": s, "end": s + n})
    return out


def documents_of(index: DataFrame) -> DataFrame:
    """doc, doc_id, n_words of every indexed document."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for block, ids, at in zip(*(part.column(k).to_pylist() for k in range(3))):
                n = len(ids)
                yield pa.RecordBatch.from_arrays([_docs(block, np.arange(n)), pa.array(ids, pa.int64()), pa.array(np.diff(_from_planes(at)))],
                                                 ["doc", "doc_id", "n_words"])

    return index.select("block", "doc_ids", "doc_at").mapInArrow(run, f"doc {DOC}, doc_id bigint, n_words bigint")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any occurrence of a window), spans, items, contaminated.

    Null and empty texts have no words. Repeated rows are scanned each for itself. Item ids are strings, a null one is ''.
    """
    index = build_index(docs, doc_id, text)
    hits = find_phrases(index, phrases_of(items, width))
    # Word counts and hits meet in one aggregate by document; a document is in one block, so no key is hot.
    rows = documents_of(index).select("doc", "doc_id", "n_words", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    rows = rows.unionByName(hits.select("doc", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("n_words"), "spans", "items"))
    best = rows.groupBy("doc").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
                                   F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    words = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1))))
    return best.withColumn("n_hit", F.size(words).cast("bigint")).withColumn("contaminated", F.col("n_hit") > 0).drop("doc")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that share no window with any item, with all their columns; a document of null id stays."""
    bad = freeze(contamination(docs, items, width, doc_id, text).where("contaminated").select(F.col("doc_id").alias("__bad")).distinct())
    return docs.join(bad, F.col(doc_id).cast("bigint") == F.col("__bad"), "left_anti")
