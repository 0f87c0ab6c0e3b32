"""Helpers shared by the training-data operators.

Contract for every operator in this subpackage unless its docstring differs:

* the input is any DataFrame; `id_col` and `text_col` name the two columns read,
  other columns are never touched, so clashing names in them do no harm;
* a null text is an empty text, a null id is carried through as null;
* repeated rows are separate rows and each gets its own result row;
* an empty table gives an empty result with the same schema;
* whole texts are processed, whatever their length.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ID, TEXT = "doc_id", "text"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors (once per application)."""
    sc = spark.sparkContext
    if getattr(sc, "_promolith_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    name = Path(tempfile.mkdtemp(prefix="promolith-")) / "promolith_src.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(name))
    sc._promolith_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.

    Where none is set, a local master (all in one process) gets a local one; on
    a cluster that is an error, as executors do not share their own folders.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = os.path.join(tempfile.gettempdir(), "promolith-checkpoints")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/promolith-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Remove what `stored` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_text(df: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """Just the id and the text (null text: empty), under fixed names."""
    return df.select(F.col(id_col).cast("long").alias(ID), F.coalesce(F.col(text_col), F.lit("")).alias(TEXT))


def columns(batches: Iterator[pa.RecordBatch], step: int = 512, most: int = 1 << 24) -> Iterator[tuple[list, ...]]:
    """Python lists of at most `step` rows and about `most` bytes (a longer row comes alone)."""
    for batch in batches:
        todo = [batch.slice(at, step) for at in range(0, batch.num_rows, step)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > most:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield tuple(c.to_pylist() for c in part.columns)


def unused(name: str, taken: list[str]) -> str:
    """`name`, with underscores before it until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


MOST_HOT = 500_000  # bound on the rows that `join_by_size` broadcasts


def join_by_size(rows: DataFrame, table: DataFrame, key: str, size: str, total: int, least: int = 1024) -> DataFrame:
    """Inner join of `rows` with `table`, whose `key` is unlike and whose `size` tells how many rows have it.

    Keys of more than max(least, total / MOST_HOT) rows are broadcast - there are
    MOST_HOT of them at most, as `total` is the number of all rows - so their rows
    stay where they are; the others are joined in a shuffle, each a small group.
    """
    limit = max(least, total // MOST_HOT)
    told = [c for c in table.columns if c not in (key, size)]
    hot = table.filter(F.col(size) > limit).select(key, F.struct(*told).alias("__told"))
    marked = rows.join(F.broadcast(hot), key, "left")
    there = marked.filter("__told is not null").select(*rows.columns, *(F.col(f"__told.{c}").alias(c) for c in told))
    rest = marked.filter("__told is null").drop("__told").join(table.filter(F.col(size) <= limit).drop(size), key)
    return there.unionByName(rest.select(*rows.columns, *told))


def crc_fold(id_col: str, k: int) -> F.Column:
    """crc32 of the id as text, modulo k (null id: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(k)


def most_frequent(counts: DataFrame, key: str, count: str, most: int, is_stored: bool = False) -> list[tuple[str, int]]:
    """At most `most` rows with the highest counts, highest first, ties by key.

    `counts` is read twice; unless it `is_stored` it is stored first.

    A histogram of the counts (some hundred rows) tells the count from which on
    the rows number `most` or fewer; what lies above comes to the driver without
    a sort in one task.  Rows of the count that would exceed `most` stay out.
    """
    kept = counts.select(key, count) if is_stored else stored(counts.select(key, count))
    fine = F.when(F.col(count) < 256, F.col(count).cast("long")).otherwise(F.floor(F.log2(count) * 32).cast("long"))
    room, least = most, None
    for b, n, low in sorted(kept.groupBy(fine.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(count).alias("low")).collect(), key=lambda r: -r.low):
        if n > room:
            break
        room, least = room - n, low
    rows = kept.filter(F.col(count) >= least).collect() if least is not None else []
    if not is_stored:
        drop_stored(kept)
    return sorted(((r[0], r[1]) for r in rows), key=lambda x: (-x[1], x[0]))
