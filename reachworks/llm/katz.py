"""Katz backoff bigram scores over a whole corpus.

Tokens are the words of a text and one end mark; the first follows a start mark. Counts r up to LEVEL are discounted
by Good-Turing, larger ones by EPSILON alone, and what a history gives up is shared by the words never seen after it in
proportion to their unigram probability, so every distribution sums to one. Unknown words are one more unigram.

    p(w | v) = d(r) r / c(v)      with r = c(v, w) > 0
             = a(v) p(w)          else, a(v) = freed(v) / (1 - sum of p over the words seen after v)
             = p(w)               if v itself was never seen

Tables are Parquet, partitioned by hash: words by word, bigrams by following word, backoff weights by history. Rows of
the tables and of the shuffles are arrays of many entries, so that volumes stay near eight bytes a token. The bucket of
a word has all its occurrences, hence c(w) and c(v, w) for each; what is missing there, a(v), is asked of the history's
bucket, and only for tokens that back off. A word that fills more than a bucket is split by its history, and
a pair (history, word) that does is split by chunk as well: its count is summed before, and one bucket puts it into the
bigram table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachworks.llm import tokens
from reachworks.session import freeze

LEVEL = 5
EPSILON = 1e-6
CHUNK_BYTES = 6 << 20
BUCKET_TOKENS = 700_000
ROW_ENTRIES = 100_000
PAIR_BITS = 20  # of the counts in which pairs that could fill a bucket are looked for
MASK_BITS = 26  # of the histories that are asked for
START, END = np.uint64(0x51A27), np.uint64(0xE9D)

_ROW = "kind string, bucket bigint, chunk bigint, doc_ids array<bigint>, a binary, b binary, c binary, d binary, e binary"
_ARROW = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *[(x, pa.binary()) for x in "abcde"]])


class _Out:
    """Rows of packed arrays."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def put(self, kind: str, bucket: int, chunk: int | None, *arrays: np.ndarray | bytes, ids: list | None = None) -> None:
        packed = [x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in arrays]
        self.rows.append((kind, bucket, chunk, ids, *packed, *[None] * (5 - len(packed))))

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _rows(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, so that a batch is not held twice."""
    for part in parts:
        for i in range(part.num_rows):
            yield part.slice(i, 1).to_pylist()[0]


def _six(values: np.ndarray) -> np.ndarray:
    """Six bytes of each 64-bit hash: within one word's histories that is enough to tell them apart."""
    return np.ascontiguousarray((values >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6])


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _pair_keys(word: np.ndarray, history: np.ndarray) -> np.ndarray:
    """One number a pair; of the history the 48 bits that `_from_six` gives back are compared."""
    return tokens.mix(word) ^ tokens.mix(history * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def _pair_bins(key: np.ndarray) -> np.ndarray:
    return (tokens.mix(key) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _planes(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def _groups(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def stream(w: tokens.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, its history, document) of a run of documents; each ends with END and begins after START."""
    token = np.insert(w.hashes, w.at[1:], END)
    doc = np.repeat(np.arange(len(w.n)), w.n + 1)
    history = np.concatenate([[START], token[:-1]])
    history[w.at[:-1] + np.arange(len(w.n))] = START
    return token, history, doc


def good_turing(counts: np.ndarray, level: int = LEVEL) -> np.ndarray:
    """Discounts d(0..level) from counts of counts (index r); d(0) is unused.

    Katz's form where the counts of counts allow it, at the highest level up to `level` at which every discount lies
    between 0 and 1; beyond that level, and where none does, 1 - EPSILON, or half a count off where nothing is freed.
    """
    out = np.full(level + 1, 1 - EPSILON)
    for k in range(level, 0, -1):
        n = counts[:k + 2].astype(float)
        if (n[1:] <= 0).any():
            continue
        r = np.arange(1, k + 1)
        cut = (k + 1) * n[k + 1] / n[1]
        if cut >= 1:
            continue
        d = ((r + 1) * n[2:k + 2] / n[1:k + 1] / r - cut) / (1 - cut)
        if (d > 0).all() and (d < 1).all():
            out[1:k + 1] = d
            return out
    out[1:] = 1 - 0.5 / np.arange(1, level + 1)
    return out


def _discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(count < len(d), d[np.minimum(count, len(d) - 1)], 1 - EPSILON) * count


def _count_words(buckets: int):
    """Words of each chunk with their counts, learned from and in all; at the end of a task all pairs counted in bins."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, bins = _Out(), np.zeros(1 << PAIR_BITS, np.int64)
        for part in parts:
            learned = part.column(0).to_numpy(False).astype(np.int64)
            for w in tokens.words_of(part.column(1), tokens.NOT_SPACE, limit=CHUNK_BYTES):
                token, history, doc = stream(w)
                bins += np.bincount(_pair_bins(_pair_keys(token, history >> np.uint64(16))), minlength=len(bins))
                word, of = np.unique(token, return_inverse=True)
                n, every = np.bincount(of, learned[w.first:w.first + len(w.n)][doc]), np.bincount(of)
                bucket = (word % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                at = _groups(bucket[order])
                for a, b in zip(at, [*at[1:], len(order)]):
                    own = order[a:b]
                    out.put("words", int(bucket[own[0]]), None, word[own], n[own].astype(np.uint32), every[own].astype(np.uint32))
                yield out.batch()
        for i, piece in enumerate(bins.reshape(16, -1)):
            out.put("pairs", -1 - i, None, zlib.compress(piece.tobytes(), 1))
        yield out.batch()
    return run


def _sum_words(size: int):
    """The word table's rows of one bucket, their counts of counts, the words of half a bucket or more; or a piece of the bins."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, n, every, bucket, bins, out = [], [], [], 0, 0, _Out()
        for r in _rows(parts):
            bucket = r["bucket"]
            if r["kind"] == "pairs":
                bins = bins + np.frombuffer(zlib.decompress(r["a"]), np.int64)
                continue
            for x, raw, t in ((word, r["a"], np.uint64), (n, r["b"], np.uint32), (every, r["c"], np.uint32)):
                x.append(np.frombuffer(raw, t))
        if bucket < 0:
            hot = np.flatnonzero(bins >= size) + (-1 - bucket) * len(bins)
            if len(hot):
                out.put("pairs", bucket, None, hot)
        else:
            unique, of = np.unique(np.concatenate(word), return_inverse=True)
            total, every = np.bincount(of, np.concatenate(n)).astype(np.int64), np.bincount(of, np.concatenate(every)).astype(np.int64)
            out.put("words", bucket, None, unique[total > 0], total[total > 0])
            out.put("stats", bucket, None, _stats(total))
            big = every >= size
            if big.any():
                out.put("large", bucket, None, unique[big], total[big], every[big])
        yield out.batch()
    return run


def _stats(count: np.ndarray) -> np.ndarray:
    """(sum, entries, entries of count 1 .. LEVEL + 1)."""
    small = np.bincount(np.minimum(count, LEVEL + 2), minlength=LEVEL + 3)
    return np.concatenate([[count.sum(), (count > 0).sum()], small[1:LEVEL + 2]]).astype(np.int64)


def _total_stats(table: DataFrame) -> np.ndarray:
    """Sum of the stats rows, summed by Spark; a few numbers reach the driver."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for raw in part.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVEL + 3)), pa.array(np.frombuffer(raw, np.int64))], ["i", "n"])

    out = np.zeros(LEVEL + 3, np.int64)
    for r in table.where("kind = 'stats'").select("a").mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out


def _large_words(table: DataFrame) -> dict[int, tuple[int, int]]:
    """(occurrences learned from, all) of the words of half a bucket or more: no more than twice the corpus' buckets."""
    out = {}
    for r in table.where("kind = 'large'").select("a", "b", "c").collect():
        out |= {x: (n, m) for x, n, m in zip(np.frombuffer(r["a"], np.uint64).tolist(), np.frombuffer(r["b"], np.int64).tolist(), np.frombuffer(r["c"], np.int64).tolist())}
    return out


def _large_pairs(rows: DataFrame, table: DataFrame, size: int) -> list[tuple[int, int, int, int]]:
    """(word, history, occurrences learned from, all) of the pairs that stand `size` times or more, exactly.

    Only pairs of bins that count as much can; those are counted for themselves, which most corpora need not do.
    """
    found = [np.frombuffer(r["a"], np.int64) for r in table.where("kind = 'pairs'").select("a").collect()]
    if not found:
        return []
    hot = np.zeros(1 << PAIR_BITS, bool)
    hot[np.concatenate(found)] = True
    sent = rows.sparkSession.sparkContext.broadcast(np.packbits(hot).tobytes())  # of fixed size

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        for part in parts:
            learned = part.column(0).to_numpy(False).astype(np.int64)
            for w in tokens.words_of(part.column(1), tokens.NOT_SPACE, limit=CHUNK_BYTES):
                token, history, doc = stream(w)
                history >>= np.uint64(16)
                key = _pair_keys(token, history)
                some = np.flatnonzero(hot[_pair_bins(key)])
                _, one, of = np.unique(key[some], return_index=True, return_inverse=True)
                n = np.bincount(of, learned[w.first:w.first + len(w.n)][doc[some]], len(one)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token[some[one]].view(np.int64), history[some[one]].view(np.int64), n, np.bincount(of, minlength=len(one)))],
                                                 ["word", "history", "n", "every"])

    counted = rows.select("learned", "text").mapInArrow(run, "word bigint, history bigint, n bigint, every bigint")
    large = counted.groupBy("word", "history").agg(F.sum("n").alias("n"), F.sum("every").alias("every")).where(F.col("every") >= size)
    return sorted((r["word"] & 0xFFFFFFFFFFFFFFFF, r["history"] & 0xFFFFFFFFFFFFFFFF, r["n"], r["every"]) for r in large.collect())


def _deal_tokens(buckets: int, large: dict[int, tuple[int, int]], pairs: list[tuple[int, int, int, int]], size: int):
    """Occurrences of every token, dealt by word; a document row keeps ids, training marks and lengths."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chunk = _Out(), TaskContext.get().partitionId() << 30
        names, pieces = np.array(sorted(large), np.uint64), np.array([-(-large[x][1] // size) + 1 for x in sorted(large)], np.uint64)
        both = _pair_keys(np.array([x[0] for x in pairs], np.uint64), np.array([x[1] for x in pairs], np.uint64))
        turns = np.array([-(-x[3] // size) + 1 for x in pairs], np.uint64)[np.argsort(both)]
        both.sort()
        for part in parts:
            ids, learned = part.column(0).to_pylist(), part.column(1).to_numpy(False).astype(np.int64)
            for w in tokens.words_of(part.column(2), tokens.NOT_SPACE, limit=CHUNK_BYTES):
                token, history, doc = stream(w)
                train = learned[w.first:w.first + len(w.n)]
                out.put("docs", chunk % buckets, chunk, train.astype(np.uint8), (w.n + 1).astype(np.int64), ids=ids[w.first:w.first + len(w.n)])
                key = token.copy()
                if len(names):
                    spot = np.minimum(np.searchsorted(names, token), len(names) - 1)
                    split = names[spot] == token
                    key[split] = tokens.mix(token[split] ^ tokens.mix(tokens.mix(history[split]) % pieces[spot[split]]))
                if len(both):
                    mine = _pair_keys(token, history >> np.uint64(16))
                    spot = np.minimum(np.searchsorted(both, mine), len(both) - 1)
                    split = both[spot] == mine
                    key[split] = tokens.mix(mine[split]) + tokens.mix(np.array([chunk], np.uint64)) % turns[spot[split]]
                bucket = (tokens.mix(key) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((history, token))
                order = order[np.argsort(bucket[order].astype(np.uint16 if buckets < 1 << 16 else np.uint32), kind="stable")]
                at = _groups(bucket[order])
                for a, b in zip(at, [*at[1:], len(order)]):
                    own = order[a:b]
                    first = _groups(token[own])
                    # A word's histories stand together, so each is sent once with its number.
                    pair = _groups(history[own] >> np.uint64(16))
                    pair = np.union1d(pair, first)
                    out.put("tokens", int(bucket[own[0]]), chunk, token[own[first]], np.diff(np.append(first, len(own))).astype(np.uint32),
                            _six(history[own[pair]]), _planes(doc[own] * 2 + train[doc[own]]), _planes(np.diff(np.append(pair, len(own)))))
                yield out.batch()
                chunk += 1
    return run


def _score_words(stats: np.ndarray, d: np.ndarray, large: dict[int, tuple[int, int]], pairs: list[tuple[int, int, int, int]], buckets: int, targets: int):
    """All a word's bucket knows: parts of the documents' sums, tokens that back off, the bigram table, its counts of counts."""
    total, kinds = float(stats[0]), float(stats[1])
    unknown = 1.0 if not total else float((stats[2:2 + LEVEL] * np.arange(1, LEVEL + 1) * (1 - d[1:])).sum() + EPSILON * (total - (stats[2:2 + LEVEL] * np.arange(1, LEVEL + 1)).sum())) / total

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, history, code, chunks, sizes, bucket, out = [], [], [], [], [], 0, _Out()
        for r in _rows(parts):
            bucket = r["bucket"]
            if r["kind"] == "pairs":
                # No bucket has all of a large pair; this one enters its share of them in the bigram table.
                whole = [x for x in pairs[bucket::buckets] if x[2]]
                for x in whole:
                    out.put("bigrams", bucket, None, np.array([x[0]], np.uint64), np.ones(1, np.uint32), _six(np.array([x[1]], np.uint64) << np.uint64(16)),
                            _planes(np.array([x[2]])), _discounted(np.array([large[x[0]][0]]), d) / total)
                out.put("stats", bucket, None, _stats(np.array([x[2] for x in whole], np.int64)))
                continue
            if r["kind"] == "docs":
                out.rows.append(tuple(r[f.name] for f in _ARROW))
                continue
            n = np.frombuffer(r["b"], np.uint32)
            word.append(np.repeat(np.frombuffer(r["a"], np.uint64), n))
            history.append(np.repeat(_from_six(r["c"]), _from_planes(r["e"])))
            code.append(_from_planes(r["d"]))
            chunks.append(r["chunk"])
            sizes.append(len(word[-1]))
        if not word:
            yield out.batch()
            return
        word, history, code = np.concatenate(word), np.concatenate(history), np.concatenate(code)
        train = (code & 1).astype(np.int8)
        key, one, inverse = np.unique(_pair_keys(word, history), return_index=True, return_inverse=True)
        pair, elsewhere = np.bincount(inverse, train).astype(np.int64), np.zeros(len(one), bool)
        if pairs:
            both = _pair_keys(np.array([x[0] for x in pairs], np.uint64), np.array([x[1] for x in pairs], np.uint64))
            spot = np.minimum(np.searchsorted(key, both), len(key) - 1)
            here = key[spot] == both
            pair[spot[here]], elsewhere[spot[here]] = np.array([x[2] for x in pairs])[here], True
        del key
        names, of = np.unique(word, return_inverse=True)
        del word
        count = np.bincount(of, train).astype(np.int64)
        for i, x in enumerate(names.tolist()) if large else ():
            count[i] = large.get(x, (count[i],))[0]
        with np.errstate(divide="ignore"):
            p = np.where(count > 0, _discounted(count, d) / max(total, 1), unknown)
            base = np.log10((count + 1) / (total + kinds + 1))
            own = np.where((count > 0) & (names != END), -np.log10(np.maximum(count, 1)), 0.0)
            r = pair[inverse]
            del inverse
            s = own[of] + np.where(r == 0, np.log10(p)[of], np.where(r > LEVEL, np.log10(np.maximum(r, 1) * (1 - EPSILON)), 0.0))
        at = 0
        for chunk, size in zip(chunks, sizes):
            some = slice(at, at + size)
            at += size
            docs, local = np.unique(code[some] >> 1, return_inverse=True)
            k = len(docs)
            classes = np.bincount(local * (LEVEL + 1) + np.where(r[some] > LEVEL, 0, r[some]), minlength=k * (LEVEL + 1)).reshape(k, LEVEL + 1)[:, 1:]
            known = np.bincount(local, count[of[some]] > 0, k)
            out.put("sums", bucket, chunk, _planes(docs), np.bincount(local, base[of[some]], k), np.bincount(local, s[some], k), _planes(known), _planes(classes.T.ravel()))
            if len(out.rows) > 64:
                yield out.batch()
        # Tokens that back off, one row for each bucket of histories: which history, which document of which chunk.
        back = np.flatnonzero(r == 0)
        target = (history[back] % np.uint64(targets)).astype(np.int64)
        order = np.argsort(target, kind="stable")
        cuts = _groups(target[order])
        starts = np.cumsum(sizes) - sizes
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            mine = back[order[a:b]]
            within = np.searchsorted(starts, mine, "right") - 1
            out.put("asked", int(target[order[a]]), None, _six(history[mine] << np.uint64(16)), _planes(code[mine] >> 1), _planes(within), np.array(chunks, np.int64))
        pair[elsewhere] = 0
        seen = np.flatnonzero(pair > 0)
        seen = seen[np.argsort(of[one[seen]], kind="stable")]
        mine = of[one[seen]]
        first = np.append(_groups(mine), len(mine))
        # Rows of some ROW_ENTRIES bigrams, cut between words.
        cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(mine), ROW_ENTRIES)), len(first) - 1))
        for i, j in zip(cuts[:-1], cuts[1:]):
            own, word = seen[first[i]:first[j]], mine[first[i:j]]
            out.put("bigrams", bucket, None, names[word], np.diff(first[i:j + 1]).astype(np.uint32), _six(history[one[own]] << np.uint64(16)), _planes(pair[own]), p[word])
            yield out.batch()
        out.put("stats", bucket, None, _stats(pair))
        yield out.batch()
    return run


def _mask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of the histories that are asked for, in sixteen pieces."""
    bits = np.zeros(1 << MASK_BITS, bool)
    for part in parts:
        for raw in part.column(0).to_pylist():
            bits[(_from_six(raw) & np.uint64((1 << MASK_BITS) - 1)).astype(np.int64)] = True
    packed = np.packbits(bits).reshape(16, -1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(16)), pa.array([x.tobytes() for x in packed], pa.binary())], ["piece", "bits"])


def _join_masks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    piece, bits = 0, None
    for r in _rows(parts):
        piece, more = r["piece"], np.frombuffer(r["bits"], np.uint8)
        bits = more if bits is None else bits | more
    yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([bits.tobytes()], pa.binary())], ["piece", "bits"])


def _history_parts(d: np.ndarray, sent, targets: int):
    """What each row of the bigram table adds to its histories: mass freed, unigram mass seen, count."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, out = np.frombuffer(sent.value, np.uint8), _Out()
        for part in parts:
            for i in range(part.num_rows):
                r = part.slice(i, 1).to_pylist()[0]
                history = _from_six(r["c"])
                spot = (history & np.uint64((1 << MASK_BITS) - 1)).astype(np.uint32)
                keep = np.flatnonzero(bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1)
                history, count = history[keep], _from_planes(r["d"])[keep]
                word = np.searchsorted(np.cumsum(np.frombuffer(r["b"], np.uint32)), keep, "right")
                p = np.frombuffer(r["e"], np.float64)[word]
                names, of = np.unique(history, return_inverse=True)
                freed, seen, n = np.bincount(of, count - _discounted(count, d)), np.bincount(of, p), np.bincount(of, count)
                target = (names % np.uint64(targets)).astype(np.int64)
                order = np.argsort(target, kind="stable")
                at = _groups(target[order])
                for a, b in zip(at, [*at[1:], len(order)]):
                    own = order[a:b]
                    out.put("history", int(target[own[0]]), None, _six(names[own] << np.uint64(16)), freed[own], seen[own], n[own].astype(np.int64))
                yield out.batch()
    return run


def _back_off(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Backoff weights of one bucket of histories, and what they add to the documents that asked."""
    names, freed, seen, count, asked, bucket = [], [], [], [], [], 0
    for r in _rows(parts):
        bucket = r["bucket"]
        if r["kind"] == "history":
            names.append(_from_six(r["a"]))
            for x, raw, t in ((freed, r["b"], np.float64), (seen, r["c"], np.float64), (count, r["d"], np.int64)):
                x.append(np.frombuffer(raw, t))
        else:
            asked.append((_from_six(r["a"]), _from_planes(r["b"]), np.frombuffer(r["d"], np.int64)[_from_planes(r["c"])]))
    out, value = _Out(), np.zeros(0)
    if names:
        names, of = np.unique(np.concatenate(names), return_inverse=True)
        freed, seen, count = (np.bincount(of, np.concatenate(x)) for x in (freed, seen, count))
        weight = freed / count / np.maximum(1 - seen, 1e-12)
        out.put("weights", bucket, None, _six(names << np.uint64(16)), weight)
        # The sums hold -log c(v) for every token; one that backs off takes it back.
        value = np.log10(weight) + np.log10(count)
    if asked and len(value):
        history, doc, chunk = (np.concatenate(x) for x in zip(*asked))
        spot = np.minimum(np.searchsorted(names, history), len(names) - 1)
        add = np.where(names[spot] == history, value[spot], 0.0)
        order = np.lexsort((doc, chunk))
        doc, chunk, add = doc[order], chunk[order], add[order]
        cuts = _groups(chunk)
        for a, b in zip(cuts, [*cuts[1:], len(chunk)]):
            first = _groups(doc[a:b])
            out.put("backed", bucket, int(chunk[a]), _planes(doc[a:b][first]), np.add.reduceat(add[a:b], first))
    yield out.batch()


def _finish(total: int, starts: int, d: np.ndarray):
    """Sums of one chunk of documents; `starts` is the count of the start mark, the documents learned from."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, train, n, rows = [], None, None, []
        for r in _rows(parts):
            if r["kind"] == "docs":
                ids, train, n = r["doc_ids"], np.frombuffer(r["a"], np.uint8), np.frombuffer(r["b"], np.int64)
            else:
                rows.append(r)
        k = len(ids)
        base, score, known = np.zeros(k), np.zeros(k), np.zeros(k, np.int64)
        gain = np.log10(d[1:] * np.arange(1, LEVEL + 1))
        for r in rows:
            docs = _from_planes(r["a"])
            if r["kind"] == "sums":
                base[docs] += np.frombuffer(r["b"], np.float64)
                score[docs] += np.frombuffer(r["c"], np.float64) + gain @ _from_planes(r["e"]).reshape(LEVEL, -1)
                known[docs] += _from_planes(r["d"])
            else:
                score[docs] += np.frombuffer(r["b"], np.float64)
        if starts:
            score -= np.log10(starts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(train == 0), pa.array(n), pa.array(known), pa.array(np.full(k, total)), pa.array(base), pa.array(score)],
                                         ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def katz_scores(docs: DataFrame, learned: F.Column, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[str, DataFrame]]:
    """(one row per document, tables): scores of all texts by a model of those for which `learned` holds.

    Rows: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (log10 of the model).
    A null or empty text is its end mark alone; repeated rows each count. Without training documents all words are
    unknown and every score is 0. Tables: words, bigrams, weights, as packed rows by bucket; weights are kept for the
    histories after which some text backs off.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(learned, F.lit(False)).cast("int").alias("learned"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 6).alias("bytes"), F.sum("learned").alias("docs")).first()
    buckets = max(12, -(-(size["bytes"] or 0) // 6 // BUCKET_TOKENS))
    least = max(1, BUCKET_TOKENS // 2)
    words = freeze(rows.select("learned", "text").mapInArrow(tokens.tidy(_count_words(buckets)), _ROW).groupBy("bucket").applyInArrow(tokens.tidy(_sum_words(least)), _ROW))
    stats = _total_stats(words)
    large, pairs = _large_words(words), _large_pairs(rows, words, least)
    d_words = good_turing(np.concatenate([[0], stats[2:]]))

    dealt = rows.mapInArrow(tokens.tidy(_deal_tokens(buckets, large, pairs, BUCKET_TOKENS)), _ROW)
    if pairs:
        empty = [F.lit(None).cast(t).alias(x) for x, t in (("chunk", "bigint"), ("doc_ids", "array<bigint>"), *[(x, "binary") for x in "abcde"])]
        dealt = dealt.unionByName(spark.range(min(buckets, len(pairs))).select(F.lit("pairs").alias("kind"), F.col("id").alias("bucket"), *empty))
    # Histories are asked for by few tokens, so they need fewer buckets.
    targets = max(12, buckets // 2)
    scored = freeze(dealt.groupBy("bucket").applyInArrow(tokens.tidy(_score_words(stats, d_words, large, pairs, buckets, targets)), _ROW))
    d_pairs = good_turing(np.concatenate([[0], _total_stats(scored)[2:]]))

    asked = scored.where("kind = 'asked'")
    masks = asked.select("a").mapInArrow(_mask, "piece bigint, bits binary").groupBy("piece").applyInArrow(_join_masks, "piece bigint, bits binary").orderBy("piece").collect()
    sent = spark.sparkContext.broadcast(b"".join(r["bits"] for r in masks) or bytes((1 << MASK_BITS) // 8))  # of fixed size
    bigrams = scored.where("kind = 'bigrams'")
    histories = bigrams.select("b", "c", "d", "e").mapInArrow(_history_parts(d_pairs, sent, targets), _ROW)
    backed = freeze(histories.unionByName(asked).groupBy("bucket").applyInArrow(tokens.tidy(_back_off), _ROW))
    parts = scored.where("kind in ('docs', 'sums')").unionByName(backed.where("kind = 'backed'"))
    out = parts.groupBy("chunk").applyInArrow(
        _finish(int(stats[0]), size["docs"] or 0, d_pairs), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out, {"words": words.where("kind = 'words'"), "bigrams": bigrams, "weights": backed.where("kind = 'weights'")}
