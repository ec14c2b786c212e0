"""Alignment of two tokenisations of the same bytes by pointer jumping, and corpus-wide counts of linked ids.

Every token points to the farthest-right token of the other tokeniser that it overlaps, or to itself when none ends
farther; doubling the successors of all tokens at once leads each to the last token of its component, which names the
group. Groups are the shortest runs of both token rows that cover the same bytes.

Texts are cut ahead of single spaces between printable characters. Neither tokeniser has a token across such a place,
so what is tokenised and aligned is each distinct piece of text, once a task, and a document is a list of pieces. A
chunk of documents passes on its pieces, the pieces of each document and the distinct id pairs with the number of its
documents that hold them; pairs are summed over all chunks and every chunk gets back the totals of its own pairs.
Nothing is sent once an occurrence. The highest count of every first id is a table of the size of a vocabulary.

Defined results: a text that is null, empty or not given back byte for byte by both tokenisers has no tokens, zeros and
empty groups; repeated rows and null ids are rows like all others; an empty table has an empty result; only the id and
text columns are read. Pieces of a task are told apart by 64-bit hashes: two of a million pieces share one with a
chance of 3e-8.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachworks.llm import tokens
from reachworks.session import freeze

CHUNK_BYTES = 2 << 20  # of text that is handled at once; a longer text is a chunk of its own
CACHED_BYTES = 3 << 20  # of pieces kept by a task; beyond that its cache starts anew
JOINED = 256  # pieces given to a tokeniser as one string
SHIFT = 20  # a pair of ids is first << SHIFT | second

_PRINTABLE = (tokens._BYTES > 32) & (tokens._BYTES < 127)
_LEAD = (tokens._BYTES >= 0xC3) & (tokens._BYTES <= 0xDF)  # of two-byte characters, none of them a space
_TAIL = (tokens._BYTES >= 0x80) & (tokens._BYTES < 0xC0)


class ByteLevel:
    """Byte-level BPE of `tokenizers`, given a text behind one space."""

    def __init__(self, path: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokens.vocabulary("byte_bpe_50k.json"))
        self.tokenizer.encode_special_tokens = True
        # The usual names of bytes: printable characters stand for themselves, the others follow from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in shown)}
        names = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        self.pieces = [bytes(byte[c] for c in name) for name in names]

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


class Pieces:
    """BPE of `sentencepiece` with byte fallback; it puts the leading space itself."""

    def __init__(self, path: str | None = None) -> None:
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_file=path or tokens.vocabulary("piece_bpe_32k.model"))
        self.pieces = [self._bytes(i) for i in range(self.processor.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.processor.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.processor.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        return self.processor.encode([t[1:].decode() for t in texts], num_threads=1)


def link(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of every A token, of every B token, A token and B token of every overlap) of two rows over the same bytes."""
    n = len(end_a)
    far_b = np.searchsorted(start_b, end_a, "left") - 1
    far_a = np.searchsorted(start_a, end_b, "left") - 1
    # A tokens come first; of two tokens that end together B's is the terminal one.
    to = np.concatenate([n + far_b, np.where(end_a[far_a] > end_b, far_a, n + np.arange(len(end_b)))]) if n else np.zeros(0, np.int64)
    while True:
        jump = to[to]
        if np.array_equal(jump, to):
            break
        to = jump
    first = np.searchsorted(end_b, start_a, "right")
    size = far_b - first + 1
    at = np.cumsum(size) - size
    of_a = np.repeat(np.arange(n), size)
    of_b = np.arange(len(of_a)) - np.repeat(at, size) + np.repeat(first, size)
    return to[:n], to[n:], of_a, of_b


def _spans(ids: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(width[ids])
    return ends - width[ids], ends


class Aligner:
    """Aligned pieces of one task."""

    def __init__(self, a=None, b=None) -> None:
        self.a, self.b = a or ByteLevel(), b or Pieces()
        self.width = [np.array([len(p) for p in x.pieces], np.int64) for x in (self.a, self.b)]
        if max(map(len, self.width)) > 1 << SHIFT:
            raise ValueError("ids do not fit a pair")
        # Ids in decimal with what may follow them: the next id of the row, the other row, the next group.
        self.text = [np.array([f"{i}{mark}".encode() for i in range(len(w)) for mark in marks], object).reshape(-1, 2)
                     for w, marks in zip(self.width, (",|", ",;"))]
        self._reset()

    def _reset(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.good, self.groups, self.bytes = np.zeros(0, bool), [], 0
        self.pairs, self.at = [np.zeros(0, np.int64)], np.zeros(1, np.int64)  # of every piece, one run after another

    def _encode(self, coder, pieces: list[bytes], simple: list[bool]) -> tuple[list[list[int]], np.ndarray]:
        """Ids of every piece; those with printable ends go through the tokeniser together and are told apart by width."""
        together, alone = [i for i, s in enumerate(simple) if s], [i for i, s in enumerate(simple) if not s]
        out: list = [None] * len(pieces)
        width = self.width[0 if coder is self.a else 1]
        runs = [together[k:k + JOINED] for k in range(0, len(together), JOINED)]
        for run, ids in zip(runs, coder.encode([b"".join([pieces[i] for i in run]) for run in runs])):
            flat = np.array(ids, np.int64)
            upto, ends = np.cumsum(width[flat]), np.cumsum([len(pieces[i]) for i in run])
            cuts = np.searchsorted(upto, ends, "left") + 1
            if not np.isin(ends, upto).all() or b"".join([coder.pieces[i] for i in ids]) != b"".join([pieces[i] for i in run]):
                alone += run
                continue
            for i, x, y in zip(run, [0, *cuts[:-1].tolist()], cuts.tolist()):
                out[i] = ids[x:y]
        for i, ids in zip(alone, coder.encode([pieces[i] for i in alone])):
            out[i] = ids
        good = np.ones(len(pieces), bool)
        good[alone] = [b"".join([coder.pieces[x] for x in out[i]]) == pieces[i] for i in alone]
        return out, good

    def learn(self, keys: np.ndarray, pieces: list[bytes], simple: list[bool]) -> None:
        """Align new distinct pieces. One that a tokeniser changes has no tokens and is marked."""
        ids_a, good = self._encode(self.a, pieces, simple)
        ids_b, good_b = self._encode(self.b, pieces, simple)
        good &= good_b
        for i in np.flatnonzero(~good).tolist():
            ids_a[i], ids_b[i] = [], []
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.array([t for x in ids for t in x], np.int64) for ids in (ids_a, ids_b))
        of_a, of_b = np.repeat(np.arange(len(pieces)), n_a), np.repeat(np.arange(len(pieces)), n_b)
        group_a, group_b, link_a, link_b = link(*_spans(flat_a, self.width[0]), *_spans(flat_b, self.width[1]))
        # Decimal groups: the tokens in order of group, then row; each with the mark that follows it.
        more_a = np.append(group_a[1:] == group_a[:-1], False) if len(group_a) else np.zeros(0, bool)
        more_b = np.append(group_b[1:] == group_b[:-1], False) if len(group_b) else np.zeros(0, bool)
        shown = np.concatenate([self.text[0][flat_a, np.where(more_a, 0, 1)], self.text[1][flat_b, np.where(more_b, 0, 1)]])
        order = np.lexsort((np.repeat([0, 1], [len(flat_a), len(flat_b)]), np.concatenate([group_a, group_b])))
        shown, ends = shown[order].tolist(), np.cumsum(n_a + n_b).tolist()
        self.groups += [b"".join(shown[x:y]) for x, y in zip([0, *ends[:-1]], ends)]
        n_groups = np.bincount(of_b[~more_b], minlength=len(pieces))
        n_links = np.bincount(of_a[link_a], minlength=len(pieces))
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, n_groups, n_links], 1)])
        self.good = np.concatenate([self.good, good])
        self.pairs.append(flat_a[link_a] << SHIFT | flat_b[link_b])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n_links)])
        keys, slot = np.concatenate([self.keys, keys]), np.concatenate([self.slot, len(self.slot) + np.arange(len(pieces))])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slot = keys[order], slot[order]
        self.bytes += sum(map(len, pieces))

    def find(self, words: tokens.Words) -> np.ndarray:
        """The slot of every piece, new ones learned first."""
        unique, one, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        new = np.flatnonzero(~np.isin(unique, self.keys))
        if len(new):
            whole = words.buf.tobytes()
            s, e = words.starts[one[new]], words.ends[one[new]]
            buf = words.buf
            simple = (e - s > 1) & _opens(buf[np.minimum(s + 1, len(buf) - 1)]) & _closes(buf, e - 1)
            self.learn(unique[new], [whole[x:y] for x, y in zip(s.tolist(), e.tolist())], simple.tolist())
        return self.slot[np.searchsorted(self.keys, unique)][inverse]

    def chunk(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(slots of the pieces of all documents, document offsets into them, groups of every document)."""
        if self.bytes > CACHED_BYTES:
            self._reset()
        words = cut(buf, bounds)
        slots = self.find(words)
        wrong = np.unique(words.doc_of_word()[~self.good[slots]])
        at = words.at
        if len(wrong):
            # A piece that is not given back: the whole text as one piece, which is kept if it is.
            keep = ~np.isin(words.doc_of_word(), wrong)
            whole = tokens.Words(0, words.buf, words.bounds, words.bounds[wrong], words.bounds[wrong + 1], np.arange(len(wrong) + 1))
            whole.hashes = tokens.hash_words(whole, fold=False)
            again = self.find(whole)
            doc = np.concatenate([words.doc_of_word()[keep], wrong[self.good[again]]])
            slots = np.concatenate([slots[keep], again[self.good[again]]])
            order = np.argsort(doc, kind="stable")
            slots, at = slots[order], np.searchsorted(doc[order], np.arange(len(bounds)))
        groups = self.groups
        listed = slots.tolist()
        return slots, at, [b"".join([groups[s] for s in listed[x:y]])[:-1] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]

    def links(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pairs of some slots, one after another; number of each)."""
        if len(self.pairs) > 1:
            self.pairs = [np.concatenate(self.pairs)]
        n = self.at[slots + 1] - self.at[slots]
        at = np.cumsum(n) - n
        return self.pairs[0][np.arange(int(n.sum())) + np.repeat(self.at[slots] - at, n)], n


def _opens(byte: np.ndarray) -> np.ndarray:
    return _PRINTABLE[byte] | _LEAD[byte]


def _closes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _PRINTABLE[buf[at]] | _TAIL[buf[at]] & _LEAD[buf[np.maximum(at - 1, 0)]] & (at > 0)


def cut(buf: np.ndarray, bounds: np.ndarray) -> tokens.Words:
    """Pieces of texts, each text behind one space of its own; an empty text has none."""
    full = np.diff(bounds) > 0
    out = np.insert(buf, bounds[:-1][full], 32)
    bounds = bounds + np.concatenate([[0], np.cumsum(full)])
    space = np.flatnonzero(out == 32)
    space = space[(space > 0) & (space + 1 < len(out))]
    space = space[_opens(out[space + 1]) & _closes(out, space - 1)]
    starts = np.union1d(space, bounds[:-1][full])
    words = tokens.Words(0, out, bounds, starts, np.append(starts[1:], len(out)) if len(starts) else starts, np.searchsorted(starts, bounds))
    words.hashes = tokens.hash_words(words, fold=False)
    return words


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values, np.int32).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.int32).astype(np.int64)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_HELD = ("docs", "pieces", "times", "sizes", "pairs")  # int32 arrays packed in a chunk's row
_TYPES = {"chunk": pa.int64(), "ids": None, **{c: pa.list_(pa.int64()) for c in _COUNTS}, "groups_sha256": pa.list_(pa.string()),
          "groups": pa.list_(pa.string()), "lengths": pa.list_(pa.int64()), **{c: pa.binary() for c in _HELD},
          "keys": pa.list_(pa.int64()), "holders": pa.list_(pa.int32())}


def _read(chunk_bytes: int, keep_groups: bool, coders: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, n = Aligner(*coders()), 0
        for batch in batches:
            ids = batch.column(0)
            for first, buf, bounds in tokens.byte_chunks(batch.column(1), chunk_bytes):
                slots, at, groups = aligner.chunk(buf, bounds)
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
                before = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(aligner.sizes[slots], 0)])
                sums = before[at[1:]] - before[at[:-1]]
                # The distinct pieces of every document with the number of times it has them.
                unique, local = np.unique(slots, return_inverse=True)
                own, times = np.unique(doc * max(len(unique), 1) + local, return_counts=True)
                own_doc, own_piece = np.divmod(own, max(len(unique), 1))
                pairs, size = aligner.links(unique)
                keys, where = np.unique(pairs, return_inverse=True)
                # How many of these documents hold a pair: every (document, pair) once.
                n_of = size[own_piece]
                start = (np.cumsum(size) - size)[own_piece]
                flat = where[np.arange(int(n_of.sum())) + np.repeat(start - (np.cumsum(n_of) - n_of), n_of)]
                held = np.unique(np.repeat(own_doc, n_of) * max(len(keys), 1) + flat) % max(len(keys), 1)
                holders = np.bincount(held, minlength=len(keys)).astype(np.int32)
                shas = ["" if not g else hashlib.sha256(g).hexdigest() for g in groups]
                packed = {"docs": np.bincount(own_doc, minlength=len(at) - 1),
                          "pieces": np.diff(own_piece, prepend=0), "times": times, "sizes": size, "pairs": where}
                chunk = TaskContext.get().partitionId() << 32 | n
                n += 1
                row = {"chunk": [chunk], "ids": [ids.slice(first, len(at) - 1)], **{c: [sums[:, i]] for i, c in enumerate(_COUNTS)},
                       "groups_sha256": [shas], "groups": [[g.decode() for g in groups] if keep_groups else None],
                       "lengths": [[len(packed[c]) for c in _HELD]], **{c: [_pack(packed[c])] for c in _HELD}, "keys": [keys], "holders": [holders]}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.to_pylist() if isinstance(x, pa.Array) else x for x in v], _TYPES[k] or pa.list_(ids.type)) for k, v in row.items()], names=list(row))
    return tokens.tidy(run)


def _answer(id_type: pa.DataType) -> Callable:
    def run(chunks: pa.Table, counts: pa.Table) -> pa.Table:
        """The documents of one chunk with the totals of their links."""
        row = chunks.to_pylist()[0] if chunks.num_rows else None
        order = np.argsort(counts.column("key").to_numpy())
        total, best = counts.column("total").to_numpy()[order], counts.column("best").to_numpy()[order].astype(np.int64)
        docs, pieces, times, sizes, pairs = (_unpack(row[c], n) for c, n in zip(_HELD, row["lengths"]))
        sums = []
        for value in (best, total):
            upto = np.concatenate([[0], np.cumsum(value[pairs])])
            ends = np.cumsum(sizes)
            of_piece = upto[ends] - upto[ends - sizes]
            upto = np.concatenate([[0], np.cumsum(of_piece[np.cumsum(pieces)] * times)])
            ends = np.cumsum(docs)
            sums.append(upto[ends] - upto[ends - docs])
        groups = row["groups"] or [None] * len(docs)
        out = {"doc_id": pa.array(row["ids"], id_type), **{c: pa.array(row[c], pa.int64()) for c in _COUNTS},
               "n_best": pa.array(sums[0], pa.int64()), "count_sum": pa.array(sums[1], pa.int64()),
               "groups_sha256": pa.array(row["groups_sha256"], pa.string()), "groups": pa.array(groups, pa.string())}
        return pa.table(out)
    return run


def _public() -> tuple:
    return ByteLevel(), Pieces()


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_groups: bool = False, chunk_bytes: int = CHUNK_BYTES,
          coders: Callable[[], tuple] = _public) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups) of every row.

    `coders` makes the two tokenisers in a task; each has `pieces`, the bytes of every id, and `encode` for texts behind
    one space. `groups` is null unless asked for.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    id_type = rows.select("doc_id").limit(0).toArrow().schema.field(0).type
    shape = ", ".join([f"chunk bigint, ids array<{kind}>", *[f"{c} array<bigint>" for c in _COUNTS], "groups_sha256 array<string>, groups array<string>",
                       "lengths array<bigint>", *[f"{c} binary" for c in _HELD], "keys array<bigint>, holders array<int>"])
    chunks = freeze(rows.mapInArrow(_read(chunk_bytes, keep_groups, coders), shape))
    asked = chunks.select("chunk", F.explode(F.arrays_zip("keys", "holders")).alias("p")).select("chunk", F.col("p.keys").alias("key"), F.col("p.holders").alias("n"))
    totals = freeze(asked.groupBy("key").agg(F.sum("n").alias("total")))
    first = F.shiftright("key", SHIFT)
    top = totals.groupBy(first.alias("a")).agg(F.max("total").alias("top"))
    ranked = totals.join(F.broadcast(top), first == F.col("a")).select("key", "total", (F.col("total") == F.col("top")).alias("best"))  # one row an id of A
    answers = asked.select("chunk", "key").join(ranked, "key").select(F.col("chunk").alias("of"), "key", "total", "best")
    bodies = chunks.drop("keys", "holders")
    out = ", ".join([f"doc_id {kind}", *[f"{c} bigint" for c in (*_COUNTS, "n_best", "count_sum")], "groups_sha256 string, groups string"])
    return bodies.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(_answer(id_type), out)
