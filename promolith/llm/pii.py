"""Personal data: labelers vote, EM weighs them, a span classifier decides.

1. Candidate spans come from patterns (base kinds and a few more) and from a
   gazetteer of given names.
2. Labelers (strict pattern, gazetteer, context for, context against, edges,
   variety) vote for, against, or abstain.
3. Votes of the whole table are counted by pattern - a bounded number - and
   expectation-maximisation on these counts estimates how reliable each labeler
   is, without any labels.
4. The posteriors train a logistic span classifier on span features.

Base spans (email, ip, card, phone by rule) always stay; a further candidate is
added if the classifier gives it `threshold` or more and it meets no base span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.5
CONTEXT = 48  # code points looked at on the left
EM_STEPS = 200

# Kinds in the order of the result, lists of the labelers.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "person")
BASE = 4
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co eu uk de fr es it nl be at ch se no dk fi pl pt cz ie us ca mx br ar cl au nz jp cn in kr ru ua za tr".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
GIVEN_NAMES = "James Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Andrew Joshua Kenneth Kevin Brian George Edward Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Kimberly Emily Michelle Amanda Melissa Deborah Stephanie Rebecca Laura Pierre François Jürgen Wolfgang Hans Javier Carlos María".split()
FOR_WORDS = {
    "email": frozenset("email mail e-mail contact write address correo courriel".split()), "ip": frozenset("ip host server address login from addr".split()),
    "card": frozenset("card visa mastercard amex credit pay payment karte carte tarjeta".split()), "phone": frozenset("phone tel call mobile fax cell telefon téléphone teléfono contact".split()),
    "ssn": frozenset("ssn social security".split()), "iban": frozenset("iban account bank konto compte cuenta".split()), "person": frozenset("mr mrs ms dr prof name sincerely regards dear herr frau monsieur madame señor señora".split()),
}
AGAINST_WORDS = frozenset("version v order invoice isbn issn part serial item sku ticket build release chapter section".split())

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SURNAME = re.compile(r"\x20[A-ZÀ-Þ][a-zß-ÿ]{2,}(?:-[A-ZÀ-Þ][a-zß-ÿ]+)?(?![\w])")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")

RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_names: ahocorasick.Automaton | None = None


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def strict(kind: int, span: str) -> bool:
    """Whether a match meets the rule of its kind."""
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in span.split("."))
    if kind == 2:
        d = _digits(span)
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == 3:
        return 10 <= len(_digits(span)) <= 15
    if kind == 4:
        a, b, c = span.split("-")
        return a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000"
    if kind == 5:
        s = span.replace(" ", "")
        return IBAN_LENGTHS.get(s[:2]) == len(s) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    return True


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind number, rule met) of every match, by kind and start."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:
        if at >= done:
            s = at
            while s > done and text[s - 1] in LOCAL:
                s -= 1
            m = DOMAIN.match(text, at) if s < at else None
            if m is not None:
                out.append((s, m.end(), 0, True))
                done = m.end()
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        for kind, pattern in ((1, IP), (2, CARD), (3, PHONE), (4, SSN), (5, IBAN)):
            if kind == 3 and "+" not in text:
                continue
            out += [(m.start(), m.end(), kind, strict(kind, m[0])) for m in pattern.finditer(text)]
    global _names
    if _names is None:
        _names = ahocorasick.Automaton()
        for n in GIVEN_NAMES:
            _names.add_word(n, len(n))
        _names.make_automaton()
    for last, n in _names.iter(text):
        s = last - n + 1
        if s and text[s - 1].isalnum():
            continue
        m = SURNAME.match(text, last + 1)
        if m is not None:
            out.append((s, m.end(), 6, True))
    return out


def votes(text: str, s: int, e: int, kind: int, met: bool) -> tuple[int, ...]:
    """The labelers' votes (1, 0, -1), then two span features."""
    name, span = KINDS[kind], text[s:e]
    left = [w.lower() for w in WORD.findall(text[max(0, s - CONTEXT) : s])][-5:]
    if kind == 0:
        known = 1 if span.rsplit(".", 1)[1].lower() in TOP_DOMAINS else -1
    elif kind == 1:
        known = -1 if span.split(".")[0].lstrip("0") in ("", "255") else 1 if met else 0
    elif kind == 2:
        known = (1 if span[0] in "3456" else -1) if met else 0
    elif kind == 3:
        d = _digits(span)
        known = 1 if any(d[:k] in CALLING_CODES for k in (1, 2)) else 0
    elif kind == 5:
        known = 1 if span[:2] in IBAN_LENGTHS else -1
    else:
        known = 1 if kind == 6 else 0
    near = any(w in FOR_WORDS[name] for w in left)
    against = any(w in AGAINST_WORDS for w in left[-2:])
    edge = not ((s and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum()))
    variety = len(set(_digits(span))) if kind not in (0, 6) else 9
    return (1 if met else -1, known, 1 if near else 0, -1 if against else 0, 1 if edge else -1, -1 if variety <= 2 else 0, min(len(span) // 8, 4), min(sum(span.count(c) for c in " -.()"), 3))


LABELERS = 6


class Model:
    """Weights of the span classifier over `inputs`."""

    def __init__(self, weights: list[float], reliability: dict[str, list[float]] | None = None) -> None:
        self.weights, self.reliability = weights, reliability or {}

    def probability(self, kind: int, v: tuple[int, ...]) -> float:
        z = float(np.dot(inputs(kind, v), self.weights))
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))


def inputs(kind: int, v: tuple[int, ...]) -> np.ndarray:
    """Span features: kind, each labeler for and against, length and marks."""
    x = np.zeros(len(KINDS) + 2 * LABELERS + 2)
    x[kind] = 1
    for k in range(LABELERS):
        if v[k]:
            x[len(KINDS) + 2 * k + (v[k] < 0)] = 1
    x[-2:] = v[LABELERS] / 4, v[LABELERS + 1] / 3
    return x


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, steps: int = EM_STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each vote pattern, P(vote | class) and the prior.

    Votes are taken to be independent given the class; the start trusts each
    labeler alike, which also fixes which class is which.
    """
    onehot = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)  # pattern, labeler, vote
    total = patterns.sum(axis=1)
    p = 1 / (1 + np.exp(-total.astype(float)))
    table, prior = np.zeros((2, patterns.shape[1], 3)), 0.5
    for _ in range(steps):
        before = p
        weight = np.stack([(1 - p) * counts, p * counts])
        table = np.einsum("yn,nlv->ylv", weight, onehot) + 1.0
        table /= table.sum(axis=2, keepdims=True)
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        log = np.einsum("nlv,ylv->yn", onehot, np.log(table)) + np.log([1 - prior, prior])[:, None]
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
        if np.abs(p - before).max() < 1e-9:
            break
    return p, table, prior


def train(rows: list[tuple[int, tuple[int, ...], int]]) -> Model:
    """The classifier from (kind, votes and features, count) of a whole table."""
    if not rows:
        return Model([0.0] * (len(KINDS) + 2 * LABELERS + 2))
    rows = sorted(rows)
    counts = np.array([n for _, _, n in rows], float)
    p, table, prior = expectation_maximisation(np.array([v[:LABELERS] for _, v, _ in rows]), counts)
    x = np.array([inputs(k, v) for k, v, _ in rows])
    share = counts / counts.sum() * min(counts.sum(), 1e4)  # keeps the ridge's weight alike at every size
    w = np.zeros(x.shape[1])
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (share * q * (1 - q))[:, None]).T @ x + np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (share * (p - q)) - w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return Model(w.tolist(), {"prior": [prior], **{f"labeler {k}": table[:, k].reshape(-1).tolist() for k in range(LABELERS)}})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for (texts,) in common.columns(batches):
        for text in texts:
            counts.update((kind, votes(text, s, e, kind, met)) for s, e, kind, met in candidates(text))
    keys = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([list(v) for _, v in keys], pa.list_(pa.int32())), pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "votes", "n"])


def fit(df: DataFrame, text_col: str = common.TEXT) -> Model:
    """Count the votes of every candidate in the table and train on the counts."""
    common.ship(df.sparkSession)
    text = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = text.mapInArrow(_count, "kind int, votes array<int>, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    return train([(r.kind, tuple(r.votes), r.n) for r in counted.collect()])


def find(text: str, model: Model, threshold: float = THRESHOLD) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind number, is base) of all spans, by start, then kind."""
    found = candidates(text)
    base = sorted((s, e, k, True) for s, e, k, met in found if k < BASE and met)
    starts, ends = [x[0] for x in base], np.maximum.accumulate([x[1] for x in base]) if base else []
    out = list(base)
    for s, e, k, met in found:
        if k < BASE and met:
            continue
        if not met or model.probability(k, votes(text, s, e, k, met)) < threshold:
            continue  # a span that breaks its kind's rule is never added
        before = bisect_left(starts, e)
        if before and ends[before - 1] > s:
            continue
        out.append((s, e, k, False))
    out.sort(key=lambda x: (x[0], x[2]))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k, _ in spans)


def _scan(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:BASE]), ("base_sha256", pa.string()), ("spans", pa.string())])
    for ids, texts in common.columns(batches):
        rows = []
        for i, text in zip(ids, texts):
            spans = find(text, model, threshold)
            base = [x for x in spans if x[3]]
            rows.append((i, *(sum(x[2] == k for x in base) for k in range(BASE)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def scan_pii(df: DataFrame, threshold: float = THRESHOLD, id_col: str = common.ID, text_col: str = common.TEXT) -> DataFrame:
    """One row per row of `df` with the personal data of its whole text.

    Spans are code points, end exclusive.  None found: zero counts, an empty
    `spans` and the digest of the empty string.  A table without candidates
    trains a model that adds nothing.  Other cases: see `common`.
    """
    model = fit(df, text_col)
    return common.id_text(df, id_col, text_col).mapInArrow(lambda b: _scan(b, model, threshold), RESULT)
