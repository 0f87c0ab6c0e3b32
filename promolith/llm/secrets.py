"""Secret scan: keyword automaton, anchored patterns at its hits, checksums last.

1. One Aho-Corasick automaton holds the keywords of every rule.  For long hex
   runs the keywords are all four-digit hex strings: each run of 32 holds some.
2. A rule's pattern is only tried anchored at a hit, on the original text.
3. Kinds that embed a checksum (CRC-32 in base 62) are kept if it agrees.

Per kind the spans are those of a leftmost non-overlapping search.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

# Kinds in the order of the result, and the words that start each.
BASE_KINDS = ("assign", "access", "hex")
KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS_WORD = "akia"
GITHUB_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
NPM_WORD = "npm_"
HEX_DIGITS = "0123456789abcdef"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")

MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _build() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in ASSIGN_WORDS:
        a.add_word(w, (0, len(w)))
    a.add_word(ACCESS_WORD, (1, len(ACCESS_WORD)))
    for w in map("".join, product(HEX_DIGITS, repeat=4)):
        a.add_word(w, (2, 4))
    for w in GITHUB_WORDS:
        a.add_word(w, (3, len(w)))
    a.add_word(NPM_WORD, (4, len(NPM_WORD)))
    a.make_automaton()
    return a


_AUTOMATON: ahocorasick.Automaton | None = None


def _base62(n: int, width: int) -> str:
    out = ""
    for _ in range(width):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def checksum_ok(body: str, tail: str) -> bool:
    """Whether the six base-62 digits are the CRC-32 of the thirty before."""
    return _base62(zlib.crc32(body.encode("ascii")), 6) == tail


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of every secret, by start, then kind."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = _build()
    # the one character whose lower case is longer would shift positions
    low = text.replace("İ", "i").lower()
    done = [0] * len(KINDS)
    found = []
    for last, (kind, n) in _AUTOMATON.iter(low):
        s = last - n + 1
        if s < done[kind]:
            continue
        if kind == 2:
            m = HEX.match(text, s)
            if m is None:
                continue
            done[2] = m.end()
            if m.end() - s >= MIN_HEX:
                found.append((s, m.end(), 2))
        elif kind == 0:
            m = ASSIGN.match(text, s)
            if m is not None:
                done[0] = m.end()
                if m.end(2) - m.start(2) >= MIN_ASSIGN:
                    found.append((s, m.end(), 0))
        elif kind == 1:
            m = ACCESS.match(text, s)
            if m is not None:
                done[1] = m.end()
                if m.end() - s >= MIN_ACCESS:
                    found.append((s, m.end(), 1))
        else:
            m = CHECKED.match(text, s)
            if m is not None:
                done[kind] = m.end()
                if checksum_ok(m[1], m[2]):
                    found.append((s, m.end(), kind))
    found.sort(key=lambda x: (x[0], x[2]))
    return found


def joined(spans: list[tuple[int, int, int]], names: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{names[k]}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlaps merged) replaced by [SECRET]."""
    if not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for s, e, _ in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], "[SECRET]"]
        at = e
    return "".join([*out, text[at:]])


def _scan(batches):
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
    for ids, texts in common.columns(batches):
        out = []
        for i, text in zip(ids, texts):
            spans = find(text)
            base = [x for x in spans if x[2] < 3]
            n = [0, 0, 0]
            for x in base:
                n[x[2]] += 1
            out.append((i, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def scan_secrets(df: DataFrame, id_col: str = common.ID, text_col: str = common.TEXT) -> DataFrame:
    """One row per row of `df` with the secrets of its whole text.

    Spans are code points, end exclusive.  No secret: zero counts, an empty
    `spans`, and the digest of the empty string.  Nulls, empty and long texts,
    repeated rows, empty tables and clashing columns: see `common`.
    """
    common.ship(df.sparkSession)
    return common.id_text(df, id_col, text_col).mapInArrow(_scan, RESULT)


def _redact(batches, at: int):
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            texts = [None if t is None else redact(t, find(t)) for t in part.column(at).to_pylist()]
            yield part.set_column(at, part.schema.field(at), pa.array(texts, pa.string()))


def redact_secrets(df: DataFrame, text_col: str = common.TEXT) -> DataFrame:
    """`df` with every secret in `text_col` replaced; null texts stay null."""
    common.ship(df.sparkSession)
    at = df.columns.index(text_col)
    return df.mapInArrow(lambda batches: _redact(batches, at), df.schema)
