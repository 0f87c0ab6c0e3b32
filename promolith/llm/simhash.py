"""SimHash near-duplicates with sharded BK-trees.

Fingerprint: word 4-shingles of the ASCII-lower-cased text, XXH64 (seed 42) of
each, bit by bit majority.  Two fingerprints link at `radius` differing bits or
fewer; a class is a connected component.

Every pair within the radius agrees on some `blocks - radius` of `blocks` bit
blocks, so a fingerprint is sent to one shard for each choice of those blocks
and a pair meets in at least one shard.  A shard's fingerprints form a BK-tree
(children keyed by the Hamming distance to their parent) and a lookup follows
only the edges within the radius.  Only connectivity is asked for, so a shard
emits a spanning star for each of its classes, never all of its pairs, and a
lookup is left out once everything not yet looked up is in one class.

Copies with equal fingerprints are folded by a map-side aggregate first.  With
more fingerprints there are more blocks, so that shards stay small.  A shard of
more than `tree_size` fingerprints is dealt again by the bits that are left: cut
into radius + 1 more blocks, a pair agrees on one of them.  What is still too
large is cut into salted parts, each pair of parts a shard of its own, so no
task holds an unbounded group.  Trees are built in the tasks that search them:
the fingerprints of a shard meet in one task, and no tree has to be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SHINGLE, RADIUS, BLOCKS, TREE_SIZE = 4, 4, 6, 4096
_U64 = np.uint64


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of a whole text; zero without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1))
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())], _U64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in common.columns(batches):
        fps = np.array([fingerprint(t) for t in texts], _U64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps)], names=["doc_id", "fp"])


def fingerprints(df: DataFrame, id_col: str = common.ID, text_col: str = common.TEXT) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""
    common.ship(df.sparkSession)
    return common.id_text(df, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """One 64-bit mask per choice of the blocks that a pair agrees on."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


class BKTree:
    """Metric tree on Hamming distance; equal values are stored once."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return
        at = 0
        while True:
            d = (value ^ self.values[at]).bit_count()
            if d == 0:
                return
            down = self.children[at].get(d)
            if down is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return
            at = down

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the values at distance `radius` or less."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            for edge, down in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(down)
        return found


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(value, root) for each value that shares a class with another root.

    Exact for connectivity: a pair in different classes is missed only if
    neither end was looked up, and lookups stop only when all that are left
    share one class.
    """
    if len(values) == 2:
        a, b = values
        return [(max(a, b), min(a, b))] if (a ^ b).bit_count() <= radius else []
    tree = BKTree()
    for v in values:
        tree.add(v)
    n = len(tree.values)
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left = {x: 1 for x in range(n)}  # class -> members not looked up
    for x in range(n):
        if len(left) <= 1:
            break
        r = top(x)
        left[r] -= 1
        if not left[r]:
            del left[r]
        for y in tree.within(tree.values[x], radius):
            a, b = top(x), top(y)
            if a != b:
                if tree.values[b] < tree.values[a]:
                    a, b = b, a
                root[b] = a
                both = left.pop(a, 0) + left.pop(b, 0)
                if both:
                    left[a] = both
    return [(tree.values[x], tree.values[t]) for x in range(n) if (t := top(x)) != x]


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; only the current shard is held."""
    held_key, held = None, []
    out: list[tuple[int, int]] = []

    def close():
        if len(held) > 1:
            out.extend(shard_links(held, radius))

    def batch():
        a = np.array(out, _U64).reshape(-1, 2).view(np.int64)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    for b in batches:
        t, key, cell = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fps = b.column(3).to_numpy(zero_copy_only=False).view(_U64)
        if not len(t):
            continue
        cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
        starts, ends = [0, *cut.tolist()], [*cut.tolist(), len(t)]
        for i, (lo, hi) in enumerate(zip(starts, ends)):
            if i and hi - lo == 1 and i < len(starts) - 1:
                continue  # alone in its shard; the one before is closed below
            k = (t[lo], key[lo], cell[lo])
            if k != held_key:
                close()
                held_key, held = k, []
            held.extend(fps[lo:hi].tolist())
        if len(out) > 20_000:
            yield batch()
    close()
    if out:
        yield batch()


def blocks_for(n: int, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> int:
    """Blocks that leave a shard of evenly spread fingerprints at an eighth of `tree_size`, 2 * radius at most."""
    for blocks in range(radius + 2, 2 * radius):
        if n * 8 <= tree_size << 64 * (blocks - radius) // blocks:
            return blocks
    return max(radius + 2, 2 * radius)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def sub_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """`mask` with each of radius + 1 parts of the other bits."""
    left = [b for b in range(64) if not mask >> b & 1]
    n = radius + 1
    return [mask | sum(1 << b for b in left[len(left) * k // n : len(left) * (k + 1) // n]) for k in range(n)]


def _too_large(keyed: DataFrame, tree_size: int) -> DataFrame:
    return keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tree_size)


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree_size: int = TREE_SIZE) -> DataFrame:
    """(a, b) fingerprints whose classes are those of all pairs within `radius`.

    `fps` has a column fp without repetitions.
    """
    common.ship(fps.sparkSession)
    chosen = block_masks(blocks, radius)
    array = lambda ms: F.array(*(F.lit(_signed(m)).cast("long") for m in ms))
    keyed = fps.select("fp", F.posexplode(array(chosen)).alias("t", "mask")).select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    large = _too_large(keyed, tree_size).select("t", "key", F.lit(True).alias("large"))
    marked = keyed.join(large, ["t", "key"], "left")
    deeper = F.element_at(F.array(*(array(sub_masks(m, radius)) for m in chosen)), F.col("t") + 1)
    again = marked.filter("large").select("t", "fp", F.posexplode(deeper).alias("j", "mask")).select(((F.col("t") + 1) * 1024 + F.col("j")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    hot = _too_large(again, tree_size).select("t", "key", F.ceil(F.col("n") * 2 / tree_size).cast("int").alias("parts"))
    # a part's cells: one for each other part, numbered low * parts + high
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("part"))
    cells = F.transform(others, lambda j: F.least(j, F.col("part")) * F.col("parts") + F.greatest(j, F.col("part")))
    cut = again.join(hot, ["t", "key"], "left").withColumn("part", part).select("t", "key", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(cells)).alias("cell"), "fp")
    dealt = marked.filter("large is null").select("t", "key", F.lit(-1).alias("cell"), "fp").unionByName(cut).repartition("t", "key", "cell").sortWithinPartitions("t", "key", "cell", "fp")
    return dealt.mapInArrow(lambda batches: _search(batches, radius), "a long, b long").distinct()


def classes(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, tree_size: int = TREE_SIZE) -> tuple[DataFrame, int]:
    """(fp, n, component_id: copies and the smallest id in the class of each
    fingerprint; number of rows of `fps`).

    `fps` has one row (doc_id, fp) per document and is read more than once.
    """
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).checkpoint()
    distinct, total = reps.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    edges = links(reps.select("fp"), radius, blocks or blocks_for(distinct, radius, tree_size), tree_size)
    found = connected_components(edges)  # node -> smallest fingerprint of its class
    named = reps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")).checkpoint()
    ids = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members"))
    return common.join_by_size(named.drop("rep"), ids, "root", "members", distinct).select("fp", "n", "component_id"), total


def near_duplicates(df: DataFrame, radius: int = RADIUS, blocks: int | None = None, tree_size: int = TREE_SIZE, id_col: str = common.ID, text_col: str = common.TEXT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest id in the row's class.  Texts without words
    have fingerprint zero, which links like any other.  Rows with a null id are
    returned, and take part in links, but never name a class (a class of null
    ids only has a null component_id).  Without `blocks` their number follows
    that of the fingerprints.  Other cases: see `common`.
    """
    common.shared_dir(df.sparkSession)
    fps = fingerprints(df, id_col, text_col).checkpoint()
    named, total = classes(fps, radius, blocks, tree_size)
    return common.join_by_size(fps, named, "fp", "n", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(df: DataFrame, id_col: str = common.ID, text_col: str = common.TEXT) -> DataFrame:
    """One row of each class: the smallest id, of its rows any one.

    A row with a null id stays only where its class has no id.  Null texts are
    empty texts, which make one class with all texts without words.
    """
    row = common.unused("row", df.columns)
    rows = common.stored(df.withColumn(row, F.monotonically_increasing_id()))  # stored, so that the keys stay
    fps = fingerprints(rows, row, text_col).withColumnRenamed("doc_id", "row").checkpoint()
    named, total = classes(fps.withColumnRenamed("row", "doc_id"))
    keys = rows.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("id")).join(fps, "row")
    first = common.join_by_size(keys, named, "fp", "n", total).groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    return rows.join(first.select(F.col("first.row").alias(row)), row, "left_semi").select(*df.columns)
