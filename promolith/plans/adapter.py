"""Observations, promotions and raw products from the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolith.functions.text import held

# Product names, one for each number, and the shop of each event type.
NAMES = (
    "Молоко 1 л", "Сыр Российский 200 г", "Мороженое пломбир", "Чипсы картофельные", "Шоколад молочный 75 г", "Пельмени 800 г", "Гель для душа 250 мл", "Шампунь 250 мл", "Сыворотка для лица 30 мл",
    "Тушь для ресниц", "Туалетная вода 50 мл", "Зубная паста 75 мл", "Подарочный набор", "Стиральная машина 6 кг", "Телевизор 55 дюйм", "Шина для мотоциклов 57H", "Погремушка", "Комнатное растение",
    "Игрушечная машина", "Demo Product",
)
SHOPS = {"click": "lenta", "view": "magnit", "error": "podruzhka", "signup": "mvideo", "purchase": "holodilnik"}


ROWS_A_TASK = 8192


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table, dealt by its key over tasks of about ROWS_A_TASK rows.

    The file compresses so well that a million rows are one split, and what is
    made of a row (pages, names, lines) is read in Python by one task then.
    The key is held, as else filters on what is made run before the dealing.
    """
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    tasks = -(-rows.count() // ROWS_A_TASK)  # told by the file's footer
    return rows.repartition(tasks, "p_partkey").withColumn("p_partkey", held(F.col("p_partkey"))) if tasks > 1 else rows


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as price observations, with event_id as sequence."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    pid, k = F.col("user_id") % 20, F.get_json_object("props", "$.k").cast("int")
    shop = F.create_map(*(F.lit(x) for p in SHOPS.items() for x in p))[F.col("event_type")]
    factor = F.when(F.col("value") < 20, 0.8).when(F.col("value") < 60, 0.7).otherwise(0.5)
    original = (200 + 10 * pid + F.when(k >= 90, 40).otherwise(0)).cast("double")
    return events.select(
        F.concat(F.lit("prod_"), F.lpad(pid.cast("string"), 2, "0")).alias("canonical_product_id"), F.element_at(F.array(*map(F.lit, NAMES)), (pid + 1).cast("int")).alias("name"), shop.alias("shop"),
        F.col("ts").cast("timestamp").alias("date"), original.alias("original_price"), F.round(original * factor, 2).alias("promotion_price"),
        F.when(k % 10 < 6, "provisional").when(k % 10 < 8, "confirmed").otherwise("auto_matched").alias("match_status"), F.col("event_id").alias("sequence"),
    )


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with later, corrected copies of every fiftieth row."""
    rows = observations(spark, sf_dir)
    again = rows.filter(F.col("sequence") % 50 == 0).withColumns({"sequence": F.col("sequence") + 1_000_000_000, "match_status": F.lit("confirmed")})
    return rows.unionByName(again)


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table read as raw products; even keys have a GTIN."""
    part = parts(spark, sf_dir)
    key = F.col("p_partkey")
    body = F.lpad((key + 400_000_000_000).cast("string"), 12, "0")
    total = sum(((F.substring(body, i, 1).cast("int") * (3 if i % 2 == 0 else 1)) for i in range(1, 13)), F.lit(0))
    gtin = held(F.concat(body, ((10 - total % 10) % 10).cast("string")))  # else a filter on it makes it anew for each use
    return part.select(
        F.lit("lenta").alias("shop"), F.concat(F.lit("https://shop.example/p/"), key.cast("string")).alias("source_url"), key.cast("string").alias("source_product_id"), F.lit(True).alias("source_id_is_stable"),
        F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.lit("ml")).alias("name_raw"), F.when(key % 2 == 0, gtin).alias("gtin_raw"), F.lit("").alias("model_raw"), F.lit("").alias("variant_raw"),
        F.col("p_brand").alias("brand_raw"), F.col("p_type").alias("category_raw"), F.lit("").alias("package_raw"), F.concat(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit(" ₽")).alias("current_price_text"),
        F.concat((F.col("p_retailprice") * 1.2).cast("decimal(12,2)").cast("string"), F.lit(" ₽")).alias("old_price_text"), F.lit("2026-09-16T10:00:00+00:00").alias("collected_at"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as normalised events, some of them broken."""
    rows, n = observations(spark, sf_dir), F.col("sequence")
    kopecks = lambda c: F.round(F.col(c) * 100).cast("long")
    return rows.select(
        "canonical_product_id", F.when(n % 13 == 0, "").otherwise(F.col("name")).alias("name"), "shop",
        F.concat(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"), F.when(n % 17 == 0, "").otherwise("+00:00")).alias("date"),
        F.when(n % 7 == 0, kopecks("promotion_price")).otherwise(kopecks("original_price")).alias("original_price_kopecks"), kopecks("promotion_price").alias("promotion_price_kopecks"),
        F.when(n % 11 == 0, "unknown").otherwise(F.col("match_status")).alias("match_status"), n.alias("sequence"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw products as a confirmed catalog; keys divisible by four have a GTIN."""
    from promolith.operators.identity import prepare

    rows = prepare(raw_products(spark, sf_dir))
    return rows.select(
        F.concat(F.lit("prod_c"), "source_product_id").alias("canonical_product_id"), F.col("name_raw").alias("canonical_name"), "attributes",
        F.when(F.col("source_product_id").cast("long") % 4 == 0, F.array("gtin")).otherwise(F.array().cast("array<string>")).alias("gtins"),
        F.array(F.struct(F.lit("lenta").alias("shop"), F.concat(F.lit("catalog "), "name_raw").alias("name"))).alias("aliases"),
    )


def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table told by pages (url, html) of one shop, in one of five ways by its key.

    In a data script (some products twice, some at another host), as JSON-LD, in
    a flight payload, on a card, and at a price that is not lowered.
    """
    part = parts(spark, sf_dir)
    key, now = F.col("p_partkey").cast("string"), F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    old = (F.col("p_retailprice") * 1.2).cast("decimal(12,2)").cast("string")
    host = F.when(F.col("p_partkey") % 7 == 0, "https://other.example").otherwise("")
    told = lambda **fields: F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    script = told(title=F.col("p_name"), link=F.concat(host, F.lit("/product/p-"), key, F.lit("/")), price=now, oldPrice=F.concat(old, F.lit(" ₽")), sku=key, brandName=F.col("p_brand"))
    linked = F.concat(F.lit('{"@type": "Product", "name": "'), "p_name", F.lit('", "url": "/goods/'), key, F.lit('", "brand": {"name": "'), "p_brand", F.lit('"}, "offers": [{"price": "'), now, F.lit('", "highPrice": "'), old, F.lit('"}]}'))
    flight = told(name=F.col("p_name"), url=F.concat(F.lit("/catalog/x/"), key), price=now, oldPrice=old, code=key)
    same = told(title=F.col("p_name"), link=F.concat(F.lit("/product/"), key), price=now, oldPrice=now)
    data = lambda body: F.concat(F.lit('<script id="__NEXT_DATA__">{"items": ['), body, F.lit("]}</script>"))
    html = (
        F.when(F.col("p_partkey") % 5 == 0, data(F.when(F.col("p_partkey") % 10 == 0, F.concat_ws(",", script, script)).otherwise(script)))
        .when(F.col("p_partkey") % 5 == 1, F.concat(F.lit('<script type="application/ld+json">'), linked, F.lit("</script>")))
        .when(F.col("p_partkey") % 5 == 2, F.concat(F.lit('<script>self.__next_f.push([1,"3:'), F.replace(flight, F.lit('"'), F.lit('\\"')), F.lit('\\nrest"])</script>')))
        .when(F.col("p_partkey") % 5 == 3, F.concat(
            F.lit('<div class="catalog-item" data-product-id="'), key, F.lit('"><a class="catalog-item__name" href="/product/'), key, F.lit('/">'), "p_name",
            F.lit('</a><span class="price-value__actual">'), now, F.lit(" ₽</span><del>"), old, F.lit(" ₽</del></div>"),
        ))
        .otherwise(data(same))
    )
    return part.select(F.concat(F.lit("https://www.holodilnik.ru/list/"), key).alias("url"), F.concat(F.lit("<html><title>Shop</title>"), html, F.lit("</html>")).alias("html"))


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table as pages with JSON-LD; every third key has none."""
    part = parts(spark, sf_dir)
    key = F.col("p_partkey").cast("string")
    body = F.concat(
        F.lit('[{"@type": "WebSite"}, {"@type": ["Thing", "schema:Product"], "name": "'), "p_name", F.lit('", "sku": "'), key, F.lit('", "gtin": ["x1", "4006381333931"], "color": "red", "brand": {"name": "'), "p_brand",
        F.lit('"}, "category": ["a", {"name": "'), "p_type", F.lit('"}], "weight": {"value": '), F.col("p_size").cast("string"), F.lit(', "unitCode": "KGM"}, "offers": {"price": "'), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit('"}}]'),
    )
    script = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))).otherwise("<p>none</p>")
    return part.select(F.concat(F.lit("https://shop.example/p/"), key).alias("url"), script.alias("html"))


def price_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and the part's price told in one of eight ways by its key."""
    part = parts(spark, sf_dir)
    k, cents = F.col("p_partkey"), (F.col("p_retailprice").cast("decimal(12,2)") * 100).cast("long")
    whole, rest = F.floor(cents / 100).cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    groups = F.replace(F.format_number(F.floor(cents / 100), 0), F.lit(","), F.lit("\u00a0"))
    spaced = F.replace(groups, F.lit("\u00a0"), F.lit(" "))
    ways = [
        F.concat(groups, F.lit(","), rest, F.lit(" ₽")), F.concat(spaced, F.lit(" руб. "), rest, F.lit(" коп.")), F.concat(spaced, F.lit(" "), rest, F.lit(" ₽")), F.concat(spaced, F.lit(" ₽")),
        F.concat(whole, F.lit(","), rest, F.lit(" руб -20%")), F.concat(whole, F.lit(" ₽ / 1 шт.")), F.lit("цена по запросу"), F.concat(whole, F.lit("."), F.substring(rest, 1, 1), F.lit(" р.")),
    ]
    return part.select(k.alias("k"), F.element_at(F.array(*ways), (k % 8 + 1).cast("int")).alias("text"))


def name_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and the part's name in one of six spellings by its key."""
    part = parts(spark, sf_dir)
    size = F.col("p_size").cast("string")
    ways = [
        F.concat(F.upper("p_name"), F.lit(" "), size, F.lit(" KG")), F.concat("p_name", F.lit(" "), size, F.lit(",5 л")), F.concat(F.lit("Акция "), "p_name", F.lit(" хит")),
        F.concat(F.lit("Ёлка "), "p_name"), F.concat(F.lit("L’Café "), "p_name"), F.concat("p_name", F.lit(" X-"), size),
    ]
    return part.select(F.col("p_partkey").alias("k"), F.element_at(F.array(*ways), (F.col("p_partkey") % 6 + 1).cast("int")).alias("name"))


def catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog lines (value): ids that come twice, aliases of a hundred products, unknown fields."""
    part, k = parts(spark, sf_dir), F.col("p_partkey")
    own = F.concat(F.lit("prod_"), (k - F.when(k % 50 == 0, 1).otherwise(0)).cast("string"))
    alias = F.concat(F.lit("alias "), F.floor(k / 100).cast("string"))
    fields = [own.alias("canonical_product_id"), F.concat(F.lit("item "), k.cast("string")).alias("canonical_name"), F.array(alias).alias("aliases")]
    return part.select(F.to_json(F.when(k % 97 == 0, F.struct(*fields, F.lit("x").alias("extra"))).otherwise(F.struct(*fields, F.lit(None).cast("string").alias("extra")))).alias("value"))


def broken_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw products, some of them broken."""
    k = F.col("source_product_id").cast("long")
    return raw_products(spark, sf_dir).withColumns({
        "k": k, "shop": F.when(k % 11 == 0, "LENTA").otherwise(F.col("shop")), "source_url": F.when(k % 13 == 0, "ftp://shop.example").otherwise(F.col("source_url")),
        "collected_at": F.when(k % 17 == 0, "2026-09-16T10:00:00").otherwise(F.col("collected_at")), "name_raw": F.when(k % 19 == 0, "  ").otherwise(F.col("name_raw")),
        "source_id_is_stable": F.when(k % 23 != 0, F.lit(True)),
    })


def unlike_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw products without a GTIN, folded to one for each set of name words, brand, size and type: a catalog."""
    from promolith.operators.identity import prepare

    part = parts(spark, sf_dir)
    words = F.array_sort(F.array_distinct(F.split(F.lower("p_name"), " ")))
    least = part.groupBy(words.alias("w"), "p_brand", "p_size", "p_type").agg(F.min("p_partkey").alias("k")).select(F.col("k").cast("string").alias("source_product_id"))
    rows = prepare(raw_products(spark, sf_dir).join(least.hint("merge"), "source_product_id", "left_semi"))
    return rows.select(
        F.concat(F.lit("prod_c"), "source_product_id").alias("canonical_product_id"), F.col("name_raw").alias("canonical_name"), "attributes", F.array().cast("array<string>").alias("gtins"),
        F.array().cast("array<struct<shop:string,name:string>>").alias("aliases"),
    )
