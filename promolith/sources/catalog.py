"""The product catalog: reading, validating and replacing it."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolith.functions import identity as text
from promolith.functions.text import gtin14, make_id
from promolith.operators.identity import ATTRIBUTES

# Fields of a catalog line, and their limits.
TEXT_FIELDS = {"brand": 500, "category": 500, "model": 500, "variant": 500, "package": 500}
FIELDS = {"canonical_product_id", "canonical_name", "gtins", "attributes", "aliases", *TEXT_FIELDS}
NAME_LIMIT, SHOP_LIMIT, MOST_GTINS, MOST_ALIASES = 1000, 50, 20, 100
UNITS = ("g", "ml", "pcs", "mm", "gb", "w", "v", "mah", "pct")

ALIAS = T.StructType([T.StructField("shop", T.StringType()), T.StructField("name", T.StringType())])
LINE = T.StructType([
    T.StructField("canonical_product_id", T.StringType()), T.StructField("canonical_name", T.StringType()), T.StructField("attributes", ATTRIBUTES), T.StructField("raw_gtins", T.ArrayType(T.StringType())),
    T.StructField("aliases", T.ArrayType(ALIAS)), T.StructField("error", T.StringType()),
])


def _need(test: bool, message: str) -> None:
    if not test:
        raise ValueError(message)


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _given_attributes(given) -> dict:
    _need(isinstance(given, dict) and set(given) <= {"measurements", "pack_count"}, "attributes must be an object of measurements and pack_count")
    if "measurements" in given:
        sizes = given["measurements"]
        _need(isinstance(sizes, list) and len(sizes) <= text.MOST_MEASUREMENTS, "measurements must be a short list")
        for s in sizes:
            _need(isinstance(s, dict) and set(s) == {"value", "unit"} and _number(s["value"]) and math.isfinite(s["value"]) and s["value"] > 0 and s["unit"] in UNITS, "a measurement needs a positive value and a known unit")
    count = given.get("pack_count")
    _need(count is None or (_number(count) and isinstance(count, int) and count >= 1), "pack_count must be a positive integer or null")
    return given


def _aliases(values, name: str) -> list[dict]:
    _need(isinstance(values, list) and len(values) <= MOST_ALIASES, "aliases must be a list of at most 100")
    out = []
    for a in [*values, name]:
        if isinstance(a, dict):
            _need(set(a) == {"shop", "name"}, "an alias object has shop and name")
        else:
            a = {"shop": "*", "name": a}
        shop, alias = a["shop"], a["name"]
        _need(isinstance(shop, str) and (shop == "*" or re.fullmatch("[a-z0-9_-]+", shop) is not None) and len(shop) <= SHOP_LIMIT, "an alias needs a shop identifier")
        _need(isinstance(alias, str) and 0 < len(alias.strip()) and len(alias) <= NAME_LIMIT and text.normalize_text(alias) != "", "an alias needs a name with searchable characters")
        if a not in out:
            out.append(a)
    return out


def parse_line(line: str) -> dict:
    """One catalog line as a row of LINE; problems are told in `error`."""
    try:
        item = json.loads(line)
        _need(isinstance(item, dict), "a catalog line holds an object")
        _need(set(item) <= FIELDS, "unknown fields: " + ", ".join(sorted(set(item) - FIELDS)))
        name = item.get("canonical_name")
        _need(isinstance(name, str) and name.strip() != "" and len(name) <= NAME_LIMIT, "canonical_name is required, of at most 1000 characters")
        gtins = item.get("gtins", [])
        _need(isinstance(gtins, list) and len(gtins) <= MOST_GTINS and all(isinstance(g, str) for g in gtins), "gtins must be a list of at most 20 strings")
        raw = {f: item.get(f, "") for f in TEXT_FIELDS}
        _need(all(isinstance(v, str) and len(v) <= TEXT_FIELDS[f] for f, v in raw.items()), "product texts must be strings of at most 500 characters")
        attributes = text.extract_attributes(name, raw["brand"], raw["category"], raw["model"], raw["variant"], raw["package"])
        _need(attributes["error"] is None, attributes["error"] or "")
        _need(attributes["name"] != "", "canonical_name has no searchable characters")
        attributes |= _given_attributes(item.get("attributes", {}))
        own = item.get("canonical_product_id") or None
        _need(own is None or (isinstance(own, str) and re.fullmatch("prod_[a-zA-Z0-9_-]{1,95}", own) is not None), "canonical_product_id is malformed")
        return {"canonical_product_id": own, "canonical_name": name.strip(), "attributes": attributes, "raw_gtins": gtins, "aliases": _aliases(item.get("aliases", []), name), "error": None}
    except (ValueError, TypeError) as e:
        return {"canonical_product_id": None, "canonical_name": None, "attributes": None, "raw_gtins": [], "aliases": [], "error": str(e)}


@F.pandas_udf(LINE)
def _parsed(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_line(x) for x in lines], columns=[f.name for f in LINE])


def parse_catalog(lines: DataFrame) -> DataFrame:
    """Lines (column `value`) as products of the catalog, with `error`.

    The id may be left out if there is exactly one GTIN.  Blank lines are no
    lines.  Other columns of `lines` are kept.
    """
    rest = [c for c in lines.columns if c != "value"]
    rows = lines.filter(F.trim("value") != "").select(*rest, _parsed("value").alias("p")).select(*rest, "p.*")
    gtins = F.array_sort(F.array_distinct(F.filter(F.transform("raw_gtins", gtin14), lambda g: g.isNotNull())))
    bad = F.exists("raw_gtins", lambda g: gtin14(g).isNull())
    made = F.when((F.size("gtins") == 1), make_id(F.concat(F.lit("gtin:"), F.get("gtins", F.lit(0)))))
    return (
        rows.withColumn("gtins", gtins).withColumn("canonical_product_id", F.coalesce("canonical_product_id", made))
        .withColumn("error", F.coalesce("error", F.when(bad, "invalid GTIN"), F.when(F.col("canonical_product_id").isNull(), "canonical_product_id or one valid GTIN is required")))
        .select(*rest, "canonical_product_id", "canonical_name", "attributes", "gtins", "aliases", "error")
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _alias_keys(aliases: pd.Series) -> pd.Series:
    return aliases.map(lambda xs: None if xs is None else [None if a["shop"] is None else f"{a['shop']}:{text.normalize_text(a['name'])}" for a in xs])


MOST_AT_ONCE = 10_000  # copies of a bad line that one array tells


def catalog_problems(catalog: DataFrame) -> DataFrame:
    """problem, value: bad lines, repeated ids, aliases or GTINs of two products.

    The catalog is read once: each product tells its id, aliases and GTINs, and
    these are counted by product, then in all.
    """
    none = F.lit(None).cast("string")
    entry = lambda problem, value, id_: F.struct(F.lit(problem).alias("problem"), value.alias("v"), id_.alias("id"))
    own = F.col("canonical_product_id")
    named = lambda problem, values: F.coalesce(F.transform(values, lambda v: entry(problem, v, own)), F.array().cast("array<struct<problem:string,v:string,id:string>>"))
    told = F.when(F.col("error").isNotNull(), F.array(entry("line", F.col("error"), none))).otherwise(
        F.concat(F.array(entry("id", own, none)), named("alias", F.col("__aliases")), named("gtin", F.col("gtins")))
    )
    each = catalog.withColumn("__aliases", _alias_keys("aliases")).select(F.explode(told).alias("e")).select("e.*")
    counted = each.groupBy("problem", "v", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("problem", "v").agg(F.sum("n").alias("n"), F.count("id").alias("products"))
    kept = counted.filter((F.col("problem") == "line") | (F.col("problem") == "id") & (F.col("n") > 1) | (F.col("products") > 1))
    # a bad line is told as often as it comes
    times = F.when(F.col("problem") == "line", F.col("n")).otherwise(F.lit(1))
    heaps = kept.select("problem", "v", times.alias("n")).select("problem", "v", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / MOST_AT_ONCE).cast("long"))).alias("heap"))
    copies = F.sequence(F.lit(1).cast("long"), F.least(F.lit(MOST_AT_ONCE), F.col("n") - F.col("heap") * MOST_AT_ONCE).cast("long"))
    return heaps.select("problem", F.col("v").alias("value"), F.explode(copies).alias("copy")).drop("copy")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalog of a JSON-lines file; ValueError on the first bad line, with its number, or the first problems."""
    parsed = parse_catalog(spark.read.text(path))
    found = catalog_problems(parsed).limit(5).collect()
    if any(r[0] == "line" for r in found):
        # only now are lines numbered, which takes a pass of its own
        numbered = spark.createDataFrame(spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[0][0], x[1] + 1)), "value string, line long")
        first = parse_catalog(numbered).filter("error is not null").agg(F.min_by(F.struct("line", "error"), "line").alias("r")).first().r
        raise ValueError(f"invalid catalog: line {first.line}: {first.error}")
    if found:
        raise ValueError("invalid catalog: " + "; ".join(f"{r[0]}: {r[1]}" for r in found))
    return parsed.drop("error")


def replace_catalog(catalog: DataFrame, runtime: DataFrame, pending: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """New snapshots of products, pending, sources and gtins; the catalog wins.

    `runtime`: canonical_product_id, canonical_name, attributes, gtins, status;
    `pending`: source_key, product_id, status, candidates (array of
    struct<canonical_product_id, score>), created_at; `sources`: source_key,
    canonical_product_id.  Stale confirmed products go, products whose GTIN is
    now in the catalog are merged into it, pending rows without a product go,
    and a review without candidates left becomes provisional.
    """
    ids = catalog.select("canonical_product_id")
    gtins = catalog.select(F.explode("gtins").alias("gtin"))
    merged = runtime.filter("status != 'confirmed'").select("canonical_product_id", F.explode("gtins").alias("gtin")).join(gtins, "gtin", "left_semi").select("canonical_product_id").distinct()
    live = runtime.filter("status in ('provisional', 'review', 'quarantine')").join(ids, "canonical_product_id", "left_anti").join(merged, "canonical_product_id", "left_anti")
    kept = pending.join(live.select(F.col("canonical_product_id").alias("product_id")), "product_id", "left_semi")
    each = kept.select("source_key", F.posexplode("candidates").alias("k", "c")).join(ids.withColumnRenamed("canonical_product_id", "known"), F.col("c.canonical_product_id") == F.col("known"), "left_semi")
    left = each.groupBy("source_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("left"))
    still = kept.join(left, "source_key", "left").withColumn("left", F.coalesce("left", F.array().cast(kept.schema["candidates"].dataType)))
    lost = (F.col("status") == "review") & (F.size("left") == 0) & (F.size("candidates") > 0)
    new_pending = still.withColumn("status", F.when(lost, "provisional").otherwise(F.col("status"))).withColumn("candidates", F.col("left")).select(*pending.columns)
    status = new_pending.groupBy(F.col("product_id").alias("canonical_product_id")).agg(F.min("status").alias("__s"))
    runtime_left = live.join(status, "canonical_product_id").withColumn("status", F.when(F.col("status") == "review", F.col("__s")).otherwise(F.col("status"))).drop("__s")
    products = catalog.select("canonical_product_id", "canonical_name", "attributes", "gtins", F.lit("confirmed").alias("status")).unionByName(runtime_left.select("canonical_product_id", "canonical_name", "attributes", "gtins", "status"))
    owners = products.select(F.explode("gtins").alias("gtin"), "canonical_product_id", (F.col("status") != "confirmed").alias("late")).groupBy("gtin").agg(F.min_by("canonical_product_id", F.struct("late", "canonical_product_id")).alias("canonical_product_id"))
    return {"products": products, "pending": new_pending, "sources": sources.join(ids, "canonical_product_id", "left_semi").select(*sources.columns), "gtins": owners}
