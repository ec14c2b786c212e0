"""Secret scan: an Aho-Corasick pass finds keywords, regular expressions run anchored at the hits only, and tokens
that carry a checksum of their own must pass it.

Kinds, in the order used to break ties of position:
  assign  keyword = value, six characters or more
  access  access key ids, twenty characters or more
  hex     runs of 24 or more hexadecimal digits (no keyword announces these: one bounded scan per text)
  github, npm   prefixed tokens of 36 characters whose last six are the base-62 CRC-32 of the first thirty
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = 3  # the first three kinds are the base spans

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED = re.compile(r"(?:gh[pousr]_|npm_)([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")

# Keyword (as the lower-cased text has it) -> kind.
KEYWORDS = {"password": 0, "passwd": 0, "secret": 0, "token": 0, "apikey": 0, "api_key": 0, "akia": 1,
            "ghp_": 3, "gho_": 3, "ghu_": 3, "ghs_": 3, "ghr_": 3, "npm_": 4}

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: str) -> str:
    """CRC-32 of the body in six base-62 digits."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _DIGITS[digit] + out
    return out


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def _fold(text: str) -> str:
    """Lower-case A-Z alone, so that positions stay what they were."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def spans(text: str | None, keywords) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret, leftmost and non-overlapping within its kind, in order; none in null or ''."""
    if not text:
        return []
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    free = [0] * len(KINDS)  # where the next match of a kind may begin
    for last, (size, kind) in keywords.iter(_fold(text)):
        start = last - size + 1
        if start < free[kind]:
            continue
        match = (ASSIGN if kind == 0 else ACCESS if kind == 1 else CHECKED).match(text, start)
        if match is None:
            continue
        free[kind] = match.end()
        if kind == 0 and match.end(2) - match.start(2) < 6 or kind > 1 and checksum62(match[1]) != match[2]:
            continue
        out.append((start, kind, match.end()))
    out.sort()
    return out


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and secrets, an array of (kind, start, end) in code points, end exclusive."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for part in parts:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(t.as_py(), keywords)] for t in part.column(1)]
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kinds)], ["doc_id", "secrets"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, secrets array<struct<kind: string, start: bigint, end: bigint>>")


def redact(text: str, found: list[tuple[int, int, int]], mask: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones merged, replaced by a mask."""
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def digest_of(rows: str, base: bool) -> F.Column:
    """Spans of an array column as kind:start:end, comma-joined; only the base kinds if asked."""
    kept = F.filter(rows, lambda s: s["kind"].isin(*KINDS[:BASE])) if base else F.col(rows)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
