"""Bounded-space online packing of tokenised documents into sequences of a fixed length.

Each partition keeps a fixed number of open windows. A document's full windows go out alone; its rest goes into the
open window that it fills best. When none has room the fullest is completed with the head of the rest (documents may
be cut), or, if it lacks fewer tokens than a cut is worth, goes out padded. What is still open at a partition's end
is merged: groups of partitions pack their leftovers the same way, until one group is left.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachworks.llm import tokens
from reachworks.session import freeze

LENGTH = 4096
OPEN_WINDOWS = 32  # per partition
MIN_CUT = 64  # tokens; smaller gaps are padded rather than filled with a cut piece
FAN_IN = 64  # partitions whose leftovers one merging task takes
END_ID = 2
TOKENIZER = "word_bpe_49k.json"  # a name among the public vocabularies; a path of your own may be given instead
CACHED_WORDS = 250_000  # per task; beyond that the cache starts anew
ROWS_OUT = 4096

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, left_in bigint, ids binary")
_ARROW = pa.schema([(n, pa.binary() if t == "binary" else pa.int64()) for n, t in (x.split() for x in SCHEMA.split(", "))])

# White space at which a text may be cut without changing its tokens.
_CUT = np.ones(256, bool)
_CUT[[9, 10, 13, 32]] = False
_SEPARATOR = "<|startoftext|>"
_BYTE = np.arange(256)
_LETTER = ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_MARK = (_BYTE > 32) & (_BYTE < 127) & ~_LETTER & ~((_BYTE >= 48) & (_BYTE <= 57))


def _plain(buf: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of the letters U+00C0 to U+00FF."""
    letter = _LETTER[buf]
    if len(buf) > 1:
        second = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        letter[1:] |= second
        letter[:-1] |= second
    return letter


class Encoder:
    """Token ids of whole documents; every distinct word of a task is tokenised once."""

    def __init__(self, path: str | None = None) -> None:
        # Spark gives a task its cores; threads of the tokeniser would only take memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokens.vocabulary(TOKENIZER))
        self.separator = self.tokenizer.token_to_id(_SEPARATOR)
        size = self.tokenizer.get_vocab_size()
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self._reset()

    def _reset(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, words: list[bytes], plain: np.ndarray) -> None:
        """Tokenise words new to the cache.

        A word of letters alone, or of marks alone, ends at its first token that closes a word, so many are encoded in
        one call; any other word is set apart by a special token, or goes alone if it might hold that token itself.
        """
        simple, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        flat, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        if len(simple):
            groups = [b" ".join([words[i] for i in simple[k:k + 64]]).decode() for k in range(0, len(simple), 64)]
            ids = np.concatenate([np.array(x.ids, np.uint32) for k in range(0, len(groups), 64)
                                  for x in self.tokenizer.encode_batch_fast(groups[k:k + 64], add_special_tokens=False)])
            ends = np.flatnonzero(self.last[ids]) + 1
            flat.append(ids)
            size.append(np.diff(ends, prepend=0))
        risky = [i for i in other if b"<|" in words[i]]
        other = [i for i in other if b"<|" not in words[i]]
        for some in (other[k:k + 1024] for k in range(0, len(other), 1024)):
            text = _SEPARATOR.join(words[i].decode("utf-8", "replace") for i in some)
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(ids == self.separator)
            flat.append(ids[ids != self.separator])
            size.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
        for i in risky:
            ids = np.array(self.tokenizer.encode(words[i].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            flat.append(ids)
            size.append(np.array([len(ids)]))
        ids, size = np.concatenate(flat), np.concatenate(size)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
        self.ids[self.used:self.used + len(ids)] = ids
        at = self.used + np.cumsum(size) - size
        self.used += len(ids)
        keys = np.concatenate([self.keys, keys[np.concatenate([simple, other, risky]).astype(np.int64)]])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size = keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def documents(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of a run of rows, row offsets into them); every row ends with END_ID."""
        for first, buf, bounds in tokens.byte_chunks(column):
            w = tokens.split_words(first, buf, bounds, _CUT)
            whole = buf.tobytes()
            safe = b"<|" not in whole  # no special token is spelled out
            if len(buf) and safe:
                # Lower-casing commutes with the tokeniser's own steps unless a combining mark follows.
                fold = _UPPER[buf]
                fold[:-1] &= buf[1:] < 0x80
                w.buf = buf + (fold.view(np.uint8) << 5)
                whole = w.buf.tobytes()
            letter = _plain(w.buf)
            mark = _MARK[w.buf]
            # Marks that end a word after a letter are tokens of their own: cut there.
            body = np.maximum.accumulate(np.where(mark, 0, np.arange(1, len(w.buf) + 1)))[w.ends - 1]
            split = (body < w.ends) & (body > w.starts) & letter[body - 1] & safe
            again = np.repeat(np.arange(len(split)), 1 + split)
            tail = np.zeros(len(again), bool)
            tail[1:] = again[1:] == again[:-1]
            head = np.zeros(len(again), bool)
            head[:-1] = tail[1:]
            w.starts = np.where(tail, body[again], w.starts[again])
            w.ends = np.where(head, body[again], w.ends[again])
            w.at = np.concatenate([[0], np.cumsum(1 + split)])[w.at]
            w.hashes = tokens.hash_words(w, fold=False)
            if len(self.keys) > CACHED_WORDS:
                self._reset()
            unique, one, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
            spot = np.searchsorted(self.keys, unique)
            known = self.keys[np.minimum(spot, len(self.keys) - 1)] == unique if len(self.keys) else np.zeros(len(unique), bool)
            if not known.all():
                new = np.flatnonzero(~known)
                s, e = w.starts[one[new]], w.ends[one[new]]
                plain = np.zeros(len(new), bool)
                for kind in (letter, mark):
                    before = np.concatenate([[0], np.cumsum(kind)])
                    plain |= before[e] - before[s] == e - s
                self._learn(unique[new], [whole[a:b] for a, b in zip(s.tolist(), e.tolist())], plain)
                spot = np.searchsorted(self.keys, unique)
            size, at = self.size[spot][inverse], self.at[spot][inverse]
            ends = np.cumsum(size)
            flat = self.ids[np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
            bounds = np.concatenate([[0], ends])[w.at]
            yield w.first, np.insert(flat, bounds[1:], END_ID), bounds + np.arange(len(bounds))


class Packer:
    """Open windows of one task; `out` collects finished pieces as rows."""

    def __init__(self, prefix: int, length: int, windows: int, min_cut: int, keep_ids: bool) -> None:
        self.prefix, self.length, self.windows, self.min_cut, self.keep_ids = prefix, length, windows, min_cut, keep_ids
        self.open: list[list] = []  # [room, [(doc_id, start, ids, doc_tokens), ...]]
        self.sequence, self.out = 0, []

    def emit(self, pieces: list[tuple]) -> None:
        offset, name = 0, self.prefix + self.sequence
        self.sequence += 1
        for doc, start, ids, total in pieces:
            raw = ids.astype("<u4", copy=False).tobytes()
            self.out.append((doc, start, len(ids), zlib.crc32(raw), total, name, offset, None, raw if self.keep_ids else None))
            offset += len(ids)

    def add(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.length:
            self.emit([(doc, start, ids[:self.length], total)])
            start, ids = start + self.length, ids[self.length:]
        while len(ids):
            fits = [w for w in self.open if w[0] >= len(ids)]
            if fits:
                self._put(min(fits, key=lambda w: w[0]), doc, start, ids, total)
                return
            if len(self.open) < self.windows:
                self.open.append([self.length - len(ids), [(doc, start, ids, total)]])
                return
            fullest = min(self.open, key=lambda w: w[0])
            cut = fullest[0]
            if cut < self.min_cut:
                self.open.remove(fullest)
                self.emit(fullest[1])
                continue
            self._put(fullest, doc, start, ids[:cut], total)
            start, ids = start + cut, ids[cut:]

    def _put(self, window: list, *piece) -> None:
        window[1].append(piece)
        window[0] -= len(piece[2])
        if window[0] == 0:
            self.open = [w for w in self.open if w is not window]
            self.emit(window[1])

    def leave(self, group: int) -> None:
        """Hand what is still open to the merging task of a group."""
        for _, pieces in self.open:
            for doc, start, ids, total in pieces:
                self.out.append((doc, start, len(ids), None, total, None, None, group, ids.astype("<u4", copy=False).tobytes()))
        self.open = []

    def close(self) -> None:
        """Join the last windows, cutting wherever one is full; only the very last is padded."""
        rest = sorted(self.open, key=lambda w: w[0])
        self.open, now, room = [], [], self.length
        for piece in (p for _, pieces in rest for p in pieces):
            doc, start, ids, total = piece
            while len(ids):
                now.append((doc, start, ids[:room], total))
                start, ids, room = start + len(now[-1][2]), ids[room:], room - len(now[-1][2])
                if not room:
                    self.emit(now)
                    now, room = [], self.length
        if now:
            self.emit(now)

    def rows(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) or [()] * len(_ARROW)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _name(level: int, group: int) -> int:
    """Room for 2**33 sequences of each of 2**26 tasks of 8 levels."""
    return (level << 59) | (group << 33)


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, windows: int = OPEN_WINDOWS,
                   min_cut: int = MIN_CUT, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked).

    A null or empty text is its end token alone. Repeated rows are packed each for itself; a null id stays null. An
    empty table gives no rows. Documents are never shuffled; only leftovers, at most `windows` windows a partition, are.
    """
    def first(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer, encoder = Packer(_name(0, task), length, windows, min_cut, keep_ids), Encoder(tokenizer)
        for part in parts:
            names = part.column(0).to_pylist()
            for row, ids, bounds in encoder.documents(part.column(1)):  # a run of documents at a time
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    # A piece must not keep the ids of its whole run alive.
                    packer.add(names[row + k], 0, ids[a:b].copy(), b - a)
                if len(packer.out) >= ROWS_OUT:
                    yield packer.rows()
        packer.leave(task)
        yield packer.rows()

    def merging(level: int, final: bool):
        def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = [r for part in parts for r in part.to_pylist()]
            if not pieces:
                return
            group = pieces[0]["left_in"]
            pieces.sort(key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["doc_tokens"], r["ids"]))
            packer = Packer(_name(level, group), length, windows, min_cut, keep_ids)
            for r in pieces:
                packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
            packer.close() if final else packer.leave(group)
            yield packer.rows()
        return merge

    rows = freeze(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tokens.tidy(first), SCHEMA))
    done, left = [rows.where("left_in is null")], rows.where("left_in is not null")
    top, level = left.agg(F.max("left_in")).first()[0], 0
    while top is not None:
        top, level = top // FAN_IN, level + 1
        merged = left.withColumn("left_in", F.floor(F.col("left_in") / FAN_IN)).groupBy("left_in").applyInArrow(merging(level, top == 0), SCHEMA)
        rows = freeze(merged)
        done.append(rows.where("left_in is null"))
        left, top = rows.where("left_in is not null"), top or None
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("left_in") if keep_ids else out.drop("left_in", "ids")
