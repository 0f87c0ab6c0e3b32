"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Words are cut into runs of word and of other characters; unigrams and bigrams
of these pieces are hashed into two ranges of buckets.  Two multinomials are
counted: the trusted target over all labelled good documents, the raw corpus
over every document.  A document's score is the mean of log p_target - log p_raw over
its n-grams; it is kept if the score reaches a fixed threshold.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 14  # of unigrams, and as many of bigrams
THRESHOLD = -0.5
MEMO_WORDS = 200_000

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_PIECE = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff]+")

RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


class Words:
    """Numbers words and keeps the hashes of their pieces; one per worker."""

    def __init__(self, limit: int = MEMO_WORDS) -> None:
        self.limit = limit
        self.reset()

    def reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 18, np.uint32)
        self.at = np.zeros(1 << 18, np.int64)
        self.used = 0

    def add(self, word: bytes) -> int:
        k = len(self.number)
        self.number[word] = k
        pieces = [zlib.crc32(p) for p in _PIECE.findall(word)]
        if k + 1 >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while self.used + len(pieces) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(pieces)] = pieces
        self.used += len(pieces)
        self.at[k + 1] = self.used
        return k

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > self.limit:
            self.reset()
        get, add = self.number.get, self.add
        return np.fromiter([k if (k := get(w)) is not None else add(w) for w in words], np.int64, len(words))

    def buckets(self, which: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
        """Bucket of each unigram, then of each bigram."""
        if not len(which):
            return np.zeros(0, np.int64)
        lo = self.at[which]
        n = self.at[which + 1] - lo
        ends = np.cumsum(n)
        h = self.flat[np.repeat(lo - (ends - n), n) + np.arange(int(ends[-1]))].astype(np.uint64)
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
        return np.concatenate([h % np.uint64(buckets), pair % np.uint64(buckets) + np.uint64(buckets)]).astype(np.int64)


_WORDS = Words()


def window_keys(which: np.ndarray) -> np.ndarray:
    """A number for each 3-word window, equal for equal windows only."""
    if which.max() < 1 << 21:
        return (which[:-2] << 42) | (which[1:-1] << 21) | which[2:]
    # more words than 21 bits can tell: number the pairs first
    _, pair = np.unique((which[:-1] << 32) | which[1:], return_inverse=True)
    return (pair[:-1].astype(np.int64) << 32) | which[2:]


def repeated(which: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(which) < 4:
        return 0
    key = window_keys(which)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(which), bool)
    covered[:-2] = again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def base_counts(text: str, raw: bytes, which: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    white = sum(raw.count(c) for c in b" \t\n\x0b\x0c\r")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(which), len(text) - white, sum(raw.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated(which)


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    raw_n, good_n = np.zeros(2 * buckets, np.int64), np.zeros(2 * buckets, np.int64)
    for texts, good in common.columns(batches):
        for text, g in zip(texts, good):
            b = _WORDS.buckets(_WORDS.of(text.encode("utf-8").split()), buckets)
            n = np.bincount(b, minlength=2 * buckets)
            raw_n += n
            if g:
                good_n += n
    some = np.flatnonzero(raw_n)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw_n[some]), pa.array(good_n[some])], names=["bucket", "raw", "good"])


def trusted_labels(labels: DataFrame) -> DataFrame:
    """doc_id of every row labelled good (every label of the id is 1)."""
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1")
    return good.select(F.col("doc_id").alias("trusted_id"))


def ratio_table(df: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, id_col: str = common.ID, text_col: str = common.TEXT) -> np.ndarray:
    """log p_target - log p_raw per bucket, each half with add-one smoothing.

    Counts cover every document and come as one row per bucket.  Without any
    trusted document all ratios are zero, so the base rules alone decide.
    """
    common.ship(df.sparkSession)
    marked = common.id_text(df, id_col, text_col).join(trusted.hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left")
    counted = marked.select("text", F.col("trusted_id").isNotNull().alias("good")).mapInArrow(lambda b: _count(b, buckets), "bucket int, raw long, good long")
    rows = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw_n, good_n = np.zeros((2, buckets)), np.zeros((2, buckets))
    for r in rows:
        raw_n.flat[r.bucket], good_n.flat[r.bucket] = r.raw, r.good
    if not good_n.any():
        return np.zeros(2 * buckets)
    log_p = lambda n: np.log((n + 1) / (n.sum(axis=1, keepdims=True) + buckets))
    return (log_p(good_n) - log_p(raw_n)).reshape(-1)


def score(words: Words, which: np.ndarray, table: np.ndarray) -> float:
    """Mean ratio over the n-grams; 0 without any."""
    b = words.buckets(which, len(table) // 2)
    return float(table[b].sum() / len(b)) if len(b) else 0.0


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def _judge(batches: Iterator[pa.RecordBatch], table, threshold: float) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("llr", pa.float64()), ("kept", pa.bool_())])
    for ids, texts in common.columns(batches):
        rows = []
        for i, text in zip(ids, texts):
            raw = text.encode("utf-8")
            which = _WORDS.of(raw.split())
            counts = base_counts(text, raw, which)
            failed = base_failed(counts[0], counts[4])
            llr = score(_WORDS, which, table.value)
            rows.append((i, *counts, failed, llr, not failed and llr >= threshold))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def judge_quality(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = common.ID, text_col: str = common.TEXT) -> DataFrame:
    """One row per row of `df`: the base counts, the ratio `llr`, and `kept`.

    An empty or null text has no words and fails the base rules.  Labels with
    null ids or nulls are ignored; other cases: see `common`.
    """
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(ratio_table(df, trusted_labels(labels), id_col=id_col, text_col=text_col))
    return common.id_text(df, id_col, text_col).mapInArrow(lambda b: _judge(b, table, threshold), RESULT)


def _keep(batches: Iterator[pa.RecordBatch], table, threshold: float, at: int) -> Iterator[pa.RecordBatch]:
    """The rows whose text (column `at`) is kept.  One numbering for words and scores: this module's."""
    for batch in batches:
        kept = []
        for text in batch.column(at):
            which = _WORDS.of((text.as_py() or "").encode("utf-8").split())
            kept.append(not base_failed(len(which), repeated(which)) and score(_WORDS, which, table.value) >= threshold)
        yield batch.filter(pa.array(kept, pa.bool_()))


def keep_good(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = common.TEXT, id_col: str = common.ID) -> DataFrame:
    """The rows of `df` that `judge_quality` keeps, whole and without a join.

    Null and empty texts go, as they fail the base rules; rows with a null id
    and repeated rows are each judged by their text.
    """
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(ratio_table(df, trusted_labels(labels), id_col=id_col, text_col=text_col))
    at = df.columns.index(text_col)
    return df.mapInArrow(lambda b: _keep(b, table, threshold, at), df.schema)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
