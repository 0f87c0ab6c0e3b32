"""Structured Streaming: raw products in, normalised events and tables out.

Delivery is at least once; every write is made idempotent by the batch id in
its path, and by the key of the promotions view on reading.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from promolith.operators import identity
from promolith.sources.sink import EVENT, RAW, check_raw, rejected_rows, valid_rows


def kafka_source(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """key, value of a topic from its start; offsets live in the checkpoint."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return stream.select(F.col("key").cast("string"), F.col("value").cast("string"))


def json_source(spark: SparkSession, path: str) -> DataFrame:
    """Files of JSON lines as `value`, for tests and backfills."""
    return spark.readStream.format("text").load(path)


def parse_raw(lines: DataFrame) -> DataFrame:
    """Raw products of JSON lines with the errors of their checks."""
    return check_raw(lines.select(F.from_json("value", RAW).alias("r")).select("r.*"))


def parse_events(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("value", EVENT).alias("r")).select("r.*")


def keyed_json(products: DataFrame) -> DataFrame:
    """key, value for a Kafka writer: shop:source_product_id and the row."""
    return products.select(F.concat_ws(":", "shop", "source_product_id").alias("key"), F.to_json(F.struct(*products.columns)).alias("value"))


def kafka_sink(rows: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def read_state(spark: SparkSession, path: str, before: int) -> identity.State:
    """The newest snapshot that a batch numbered below `before` has left."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    whole = [n for n in names if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_done"))]
    numbers = [int(n.partition("=")[2]) for n in whole]
    newest = max((n for n in numbers if n < before), default=None)
    empty = identity.State.empty(spark)
    if newest is None:
        return empty
    return identity.State(**{k: spark.read.schema(t.schema).parquet(f"{path}/version={newest}/{k}") for k, t in empty.tables().items()})


def write_state(spark: SparkSession, state: identity.State, path: str, number: int) -> None:
    """Write a snapshot; it counts once all of its tables are there."""
    for k, table in state.tables().items():
        table.write.mode("overwrite").parquet(f"{path}/version={number}/{k}")
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={number}/_done")
    done.getFileSystem(spark._jsc.hadoopConfiguration()).create(done, True).close()


def normalize_batch(batch: DataFrame, catalog: DataFrame, out: str, number: int, state: str | None = None) -> None:
    """Resolve one batch and write its events, and the next state if there is one.

    A batch reads the snapshot before its own number and replaces its own
    output, so running it again changes nothing.
    """
    spark = catalog.sparkSession
    good = identity.promoted(batch.filter(F.size("errors") == 0).drop("errors"))
    before = read_state(spark, state, number) if state else None
    resolved = identity.resolve(good, catalog, state=before).persist()
    try:
        identity.events_of(resolved).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if state:
            write_state(spark, identity.next_state(resolved, before), state, number)
    finally:
        resolved.unpersist()


def normalize_stream(raw: DataFrame, catalog: DataFrame, out: str, checkpoint: str, state: str | None = None) -> StreamingQuery:
    """Resolve each micro-batch against the catalog and the state, append events."""
    return raw.writeStream.foreachBatch(lambda batch, number: normalize_batch(batch, catalog, out, number, state)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def normalize_kafka(spark: SparkSession, servers: str, source: str, target: str, catalog: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Raw products of one topic to normalised events of another, each under the key it came with.

    Events of a batch are written before its offsets are committed: at least
    once, and the table's key folds what comes twice.
    """
    stream = kafka_source(spark, servers, source).select("key", F.from_json("value", RAW).alias("r"))

    def run(batch: DataFrame, number: int) -> None:
        keyed_events(batch, catalog, state, number).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", target).save()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def keyed_events(batch: DataFrame, catalog: DataFrame, state: str, number: int) -> DataFrame:
    """key, value of the events of a batch (key, r); also leaves the next state."""
    spark = catalog.sparkSession
    rows = check_raw(batch.select("key", "r.*")).filter(F.size("errors") == 0).drop("errors")
    before = read_state(spark, state, number)
    resolved = identity.resolve(identity.promoted(rows.drop("key")), catalog, state=before).persist()
    write_state(spark, identity.next_state(resolved, before), state, number)
    keys = identity.prepare(rows).select("key", "source_key", "collected_at").dropDuplicates(["source_key", "collected_at"])
    events = resolved.filter("status != 'quarantine'").dropDuplicates(["source_key", "collected_at", "old_kopecks", "current_kopecks"]).join(keys, ["source_key", "collected_at"])
    told = events.select("key", "canonical_product_id", F.col("canonical_name").alias("name"), "shop", F.col("collected_at").alias("date"), F.col("old_kopecks").alias("original_price_kopecks"), F.col("current_kopecks").alias("promotion_price_kopecks"), F.col("status").alias("match_status"))
    return told.select("key", F.to_json(F.struct(*told.columns[1:])).alias("value"))


def sink_stream(events: DataFrame, table: str, rejects: str, checkpoint: str) -> StreamingQuery:
    """Valid rows into the promotions table, the others with their errors apart.

    Rows carry the batch's number as their ingest sequence.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            valid_rows(batch).withColumn("sequence", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{table}/batch={number}")
            rejected_rows(batch).write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exact_events(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Valid rows without repetitions of the key inside the watermark."""
    return valid_rows(events).withWatermark("date", watermark).dropDuplicatesWithinWatermark(["canonical_product_id", "shop", "date", "original_price", "promotion_price"])


PENDING_OUT = "source_key string, product_id string, status string, gtins array<string>, created_at string, updates long"
PENDING_STATE = "product_id string, status string, gtins array<string>, created_at string, updates long"


def _pending(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    product, status, gtins, created, updates = state.get if state.exists else (None, None, [], None, 0)
    rows = pd.concat(list(batches)).sort_values("collected_at", kind="stable")
    gtins = list(gtins)
    for r in rows.itertuples(index=False):
        product, created = product or r.canonical_product_id, created or r.collected_at  # the first id and time stay
        if r.gtin and r.gtin not in gtins:
            gtins.append(r.gtin)
        status = status if status == "quarantine" else r.status  # quarantine is kept
        updates += 1
    state.update((product, status, gtins, created, updates))
    yield pd.DataFrame([(key[0], product, status, gtins, created, updates)], columns=["source_key", "product_id", "status", "gtins", "created_at", "updates"])


def pending_stream(resolved: DataFrame) -> DataFrame:
    """State of each source that is not matched: one card, kept over batches.

    `resolved` is a stream of source_key, canonical_product_id, status, gtin,
    collected_at.  A later GTIN joins the card, whose id and creation stay.
    """
    rows = resolved.filter("status in ('provisional', 'review', 'quarantine')").select("source_key", "canonical_product_id", "status", "gtin", "collected_at")
    return rows.groupBy("source_key").applyInPandasWithState(_pending, PENDING_OUT, PENDING_STATE, "update", GroupStateTimeout.NoTimeout)


def pending_cards(resolved: DataFrame) -> DataFrame:
    """The same for a batch, by aggregates."""
    rows = resolved.filter("status in ('provisional', 'review', 'quarantine')")
    order = F.struct("collected_at", "canonical_product_id")
    return rows.groupBy("source_key").agg(
        F.min_by("canonical_product_id", order).alias("product_id"), F.when(F.bool_or(F.col("status") == "quarantine"), "quarantine").otherwise(F.max_by("status", order)).alias("status"),
        F.array_sort(F.collect_set("gtin")).alias("gtins"), F.min("collected_at").alias("created_at"), F.count(F.lit(1)).alias("updates"),
    )
