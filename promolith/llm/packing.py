"""Order-preserving packing of documents into sequences of bounded length.

The documents of a partition, in their order, form one stream of ids (each
document followed by an end id).  Dynamic programming chooses where to cut the
stream into windows of at most `size` ids.  A cut may stand at a document's end
(free), at a sentence's end (`sentence_cost`) or, where sentences are long, on
a grid (`inner_cost`); the total of padding and cut costs is minimal.

With f[j] the best cost of a stream cut at point j, the padding of a window is
size - (p[j] - p[i]), so f[j] = cost[j] + size - p[j] + min(f[i] + p[i]) over the
points i at most `size` back: a sliding-window minimum, kept in a monotone
queue, O(1) a point.  A window whose length is a power of two needs no padding;
these extra transitions are tried by position.  Every window also costs
`window_cost`, so that no tiny ones are made inside a stream: there 512 and 256
are tried, shorter windows only in the last block, where they spare the padding
of what is left over.

The stream is solved in blocks of about `block` ids; all but the last window of
a block are final and the last one's ids start the next block.  So memory does
not grow with the partition; of a document only its ids and cuts are held.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe, common

SIZE, BLOCK, GRID = 1024, 1 << 17, 16
SENTENCE_COST, INNER_COST, WINDOW_COST = 1.0, 2.0, 16.0
END_ID = 0
_FREE_LENGTHS = (512, 256)
_LAST_LENGTHS = tuple(1 << k for k in range(9, -1, -1))

RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(n.split()[0], pa.int64()) for n in RESULT.split(", ")])


def windows(points: list[int], costs: list[float], size: int = SIZE, window_cost: float = WINDOW_COST, free: tuple[int, ...] = _FREE_LENGTHS) -> list[int]:
    """Indices of the chosen points, first (0) and last included.

    `points` ascend from the stream's start to its end, none further than
    `size` from the one before.
    """
    n = len(points)
    place = np.array(points)
    exact: list = [None] * n  # the points that lie a free length back
    for length in free:
        k = np.searchsorted(place, place - length)
        for j in np.flatnonzero(place[k] == place - length).tolist():
            if exact[j] is None:
                exact[j] = [int(k[j])]
            else:
                exact[j].append(int(k[j]))
    best, back = [0.0] * n, [0] * n
    # the queue: points not out of reach yet whose best + place ascends; `head` is its first
    index, value_at, place_at, head = [0], [float(points[0])], [points[0]], 0
    for j, (p, cost, free_points) in enumerate(zip(points, costs, exact)):
        if not j:
            continue
        while place_at[head] < p - size:
            head += 1
        i, value = index[head], value_at[head] + size - p
        if free_points is not None:
            for k in free_points:
                if best[k] < value:
                    value, i = best[k], k
        value += cost + window_cost
        best[j], back[j] = value, i
        value += p
        while len(index) > head and value_at[-1] >= value:
            index.pop()
            value_at.pop()
            place_at.pop()
        index.append(j)
        value_at.append(value)
        place_at.append(p)
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


class _Ids:
    """Ids of texts under a vocabulary, and where sentences end in them."""

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        self.vocabulary = v = bpe.vocabulary_at(vocabulary)
        ranks = {b: i for i, b in v.bytes_of.items() if i not in v.special.values()}
        self.encoding = tiktoken.Encoding("packing", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
        # tokens that end a line, that may end a sentence, and that start a new word
        flags = lambda test: np.array([test(v.bytes_of.get(i, b"")) for i in range(max(v.bytes_of) + 1)], bool)
        self.lines, self.marks, self.spaced = flags(lambda b: b"\n" in b), flags(lambda b: b[-1:] in (b".", b"!", b"?")), flags(lambda b: b[:1].isspace())

    def many(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All ids of each text, and the sentence ends in them."""
        for text in texts:
            parts = [
                np.array([self.vocabulary.special[part]], np.uint32) if special else self.encoding.encode_to_numpy(part, disallowed_special=())
                for special, part in bpe.segments(text, self.vocabulary)
            ]
            ids = np.concatenate(parts).astype("<u4", copy=False) if parts else np.zeros(0, "<u4")
            yield ids, self._sentence_ends(ids)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return next(self.many([text]))

    def _sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        # a mark ends a sentence only before white space: not inside a number or an address
        ends = self.lines[ids]
        ends[:-1] |= self.marks[ids[:-1]] & self.spaced[ids[1:]]
        return np.flatnonzero(ends) + 1


@functools.lru_cache(1)
def _ids_at(vocabulary: str) -> _Ids:
    return _Ids(vocabulary)


def cut_points(length: int, ends: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Points inside one document of `length` ids and its end, with costs."""
    bounds = np.append(ends[(ends > 0) & (ends < length)], length).astype(np.int64)
    gaps = np.diff(bounds, prepend=0)
    n = (gaps - 1) // grid + 1  # of each bound: grid points before it, and itself
    last = np.cumsum(n) - 1
    step = np.arange(int(last[-1]) + 1) - np.repeat(last - n, n)  # 1 to n for each bound
    points = np.repeat(bounds - gaps, n) + step * grid
    costs = np.full(len(points), INNER_COST)
    points[last], costs[last], costs[-1] = bounds, SENTENCE_COST, 0.0
    return points, costs


def pack_stream(docs: Iterator[tuple[int | None, np.ndarray, np.ndarray]], first_sequence: int = 0, size: int = SIZE, block: int = BLOCK) -> Iterator[tuple]:
    """Rows of RESULT for documents given as (id, ids with the end id, cuts)."""
    held: list[list] = []  # [doc id, ids not yet placed, ids placed before, tokens of the document]
    points, costs, total = [0], [0.0], 0  # positions in the whole stream
    sequence = first_sequence

    def place(left: int) -> Iterator[tuple]:
        """Take the next `left` ids as one sequence."""
        nonlocal sequence
        offset = 0
        while left:
            doc = held[0]
            take = min(left, len(doc[1]))
            piece = doc[1][:take]
            yield doc[0], doc[2], take, zlib.crc32(piece.astype("<u4").tobytes()), doc[3], sequence, offset
            offset += take
            left -= take
            if take == len(doc[1]):
                held.pop(0)
            else:
                doc[1], doc[2] = doc[1][take:], doc[2] + take
        sequence += 1

    def solve(final: bool) -> Iterator[tuple]:
        nonlocal points, costs
        if final:  # what is left over may be cut anywhere
            price_of = dict(zip(points, costs))
            points = sorted({*points, *range(max(points[0], points[-1] - size), points[-1])})
            costs = [price_of.get(p, INNER_COST) for p in points]
        chosen = windows(points, costs, size, free=_LAST_LENGTHS if final else _FREE_LENGTHS)
        if not final and len(chosen) > 2:
            chosen.pop()
        for i, j in zip(chosen, chosen[1:]):
            yield from place(points[j] - points[i])
        points, costs = points[chosen[-1] :], costs[chosen[-1] :]

    for doc_id, ids, cuts in docs:
        held.append([doc_id, ids, 0, len(ids)])
        more, price = cut_points(len(ids), cuts)
        for at in range(0, len(more), 4096):  # a long document is solved in blocks as well
            points += (more[at : at + 4096] + total).tolist()
            costs += price[at : at + 4096].tolist()
            if points[-1] - points[0] >= block:
                yield from solve(False)
        total += len(ids)
    if total > points[0]:
        yield from solve(True)


def _pack(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    table = _ids_at(vocabulary)
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40

    def docs():
        for ids, texts in common.columns(batches):
            for i, (tokens, cuts) in zip(ids, table.many(texts)):
                yield i, np.append(tokens, np.uint32(END_ID)), cuts

    rows = []
    for row in pack_stream(docs(), first):
        rows.append(row)
        if len(rows) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_SCHEMA)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_SCHEMA)


def pack(df: DataFrame, vocabulary: str | None = None, id_col: str = common.ID, text_col: str = common.TEXT) -> DataFrame:
    """One row per piece: where it stands in its document and its sequence.

    No shuffle: each partition packs its own stream, in its order; sequence ids
    start at the partition's number times 2^40.  An empty or null text is the
    end id alone.  Repeated rows are packed each; other cases: see `common`.
    """
    common.ship(df.sparkSession)
    vocabulary = vocabulary or bpe.default_vocabulary()
    return common.id_text(df, id_col, text_col).mapInArrow(lambda b: _pack(b, vocabulary), RESULT)
