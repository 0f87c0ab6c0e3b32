"""Texts, prices, codes, identity, catalog, pages and streams."""

import json

import pytest
from pyspark.sql import functions as F

from promolith.functions import extract, identity as text
from promolith.functions.text import gtin14, price_kopecks
from promolith.operators import identity, pages
from promolith.plans import adapter
from promolith.sources import catalog as catalogs
from promolith.sources import sink
from promolith.streaming import ingest

PRICES = {
    "199,99 ₽": 19999, "1 299 руб. 50 коп.": 129950, "1 299 ₽ 50 коп.": 129950, "199 руб. 5 коп.": 19905, "129 99 ₽": 12999, "1 299 ₽": 129900, "1 299 ₽": 129900,
    "199,99 руб -20%": 19999, "199 ₽ / 1 шт.": 19900, "199 ₽ за 100 г": 19900, "no price": None, "": None, "12.5": 1250, "50 коп": 50, "1 234 567": 123456700,
}
CODES = {"4006381333931": "04006381333931", " 4006-381 333931 ": "04006381333931", "4006381333932": None, "code4006381333931": None, "00000000": None, "٤٠٠٦٣٨١٣٣٣٩٣١": None, "": None, "96385074": "00000096385074"}


def test_prices_and_codes(spark):
    df = spark.createDataFrame([(t,) for t in PRICES], "t string")
    assert {r.t: r.p for r in df.select("t", price_kopecks(F.col("t")).alias("p")).collect()} == PRICES
    df = spark.createDataFrame([(t,) for t in CODES], "t string")
    assert {r.t: r.p for r in df.select("t", gtin14(F.col("t")).alias("p")).collect()} == CODES


def test_measurements():
    sizes = lambda t: [(m["value"], m["unit"]) for m in text.extract_attributes(t)["measurements"]]
    assert sizes("10000 mAh") == [(10000.0, "mah")] and sizes("20 cm") == [(200.0, "mm")] and sizes("500 грамм") == [(500.0, "g")] and sizes("2 штуки") == [(2.0, "pcs")]
    assert sizes("телефон 5G") == [] and sizes("масло 0W-20") == [] and sizes("1,5 л и 1.5 l") == [(1500.0, "ml")]
    assert text.extract_attributes("сок 0x500ml")["error"] and text.extract_attributes("сок 6x500ml")["pack_count"] == 6
    assert text.normalize_text("L’Oréal крем 0,25 кг АКЦИЯ") == text.normalize_text("LOREAL Крём 250 г") == "loreal крем 250g"
    assert text.normalize_text(None) == "" and text.similarity("a b", "b a") == 1.0 and text.similarity("", "a") == 0.0


def product(name, n=1, **kw):
    base = dict(shop="lenta", source_url="https://x.ru/p", source_product_id=str(n), source_id_is_stable=True, name_raw=name, gtin_raw=None, model_raw="", variant_raw="", brand_raw="", category_raw="", package_raw="", current_price_text="80 ₽", old_price_text="100 ₽", collected_at="2026-09-16T10:00:00+00:00")
    return base | kw


def lines(*items):
    return [json.dumps(x, ensure_ascii=False) for x in items]


@pytest.fixture(scope="module")
def shelf(spark):
    items = lines(
        {"canonical_product_id": "prod_phone", "canonical_name": "Acme Phone X1 128 GB", "brand": "Acme", "model": "X1", "gtins": ["4006381333931"]},
        {"canonical_product_id": "prod_cream", "canonical_name": "Крем для лица ночной 50 мл", "brand": "Nivea", "aliases": ["Ночной крем"]},
        {"canonical_product_id": "prod_tea", "canonical_name": "чай зелёный листовой"},
    )
    return catalogs.parse_catalog(spark.createDataFrame([(x,) for x in items], "value string")).drop("error")


def resolved(spark, shelf, *products, sources=None):
    rows = spark.createDataFrame(list(products), sink.RAW)
    return {r.source_key: r for r in identity.resolve(rows, shelf, sources).collect()}


def test_matching(spark, shelf):
    got = resolved(
        spark, shelf, product("Phone Acme X1 128 GB", 1, brand_raw="Acme", model_raw="X1"), product("Acme Phone X2 128 GB", 2, brand_raw="Acme", model_raw="X2"), product("листовой чай зеленый", 3), product("что угодно", 4, gtin_raw="4006381333931"),
        product("ночной крем", 5), product("новый товар без пары", 6), product("новый товар с кодом", 7, gtin_raw="96385074"), product("Крем для лица ночной 100 мл", 8, brand_raw="Nivea"), product("!!!", 9),
    )
    told = {k.split(":")[1]: (r.canonical_product_id, r.method, r.status) for k, r in got.items()}
    assert told["1"] == ("prod_phone", "attribute_match", "auto_matched")
    assert told["2"][1:] == ("provisional", "provisional") and told["2"][0] not in ("prod_phone",)
    assert told["3"] == ("prod_tea", "confirmed_alias", "confirmed") or told["3"] == ("prod_tea", "attribute_match", "auto_matched")
    assert told["4"] == ("prod_phone", "gtin", "confirmed") and told["5"] == ("prod_cream", "confirmed_alias", "confirmed")
    assert told["6"][1:] == ("provisional", "provisional") and told["7"][1:] == ("new_gtin", "provisional") and told["8"][2] == "provisional" and "9" not in told


def test_quarantine(spark, shelf):
    sources = spark.createDataFrame([("lenta:1", "prod_cream"), ("lenta:2", "prod_tea")], "source_key string, canonical_product_id string")
    got = resolved(spark, shelf, product("Acme Phone X1 128 GB", 1, gtin_raw="4006381333931"), product("совсем другое", 2), sources=sources)
    assert got["lenta:1"].status == "quarantine" and got["lenta:1"].conflicts == ["identity_mapping"]
    assert got["lenta:2"].status == "quarantine" and got["lenta:2"].conflicts == ["source_identity"]


@pytest.mark.parametrize("item", [
    {"canonical_name": "!!!"}, {"canonical_name": "x" * 1001, "canonical_product_id": "prod_1"}, {"canonical_name": "чай", "gtins": [4006381333931]}, {"canonical_name": "чай", "surprise": 1, "canonical_product_id": "prod_1"},
    {"canonical_name": "чай"}, {"canonical_name": "чай", "canonical_product_id": "bad id"}, {"canonical_name": "чай", "canonical_product_id": "prod_1", "attributes": {"pack_count": 0}}, {"canonical_name": "чай", "gtins": ["4006381333932"]},
])
def test_bad_catalog_lines(spark, item):
    rows = catalogs.parse_catalog(spark.createDataFrame([(json.dumps(item),)], "value string"))
    assert rows.first().error


def test_catalog_problems_and_file(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join(["", *lines({"canonical_product_id": "prod_1", "canonical_name": "чай"}, {"canonical_product_id": "prod_2", "canonical_name": "Чай"})]), encoding="utf-8")
    with pytest.raises(ValueError, match="alias"):
        catalogs.read_catalog(spark, str(path))
    path.write_text(lines({"canonical_name": "чай", "gtins": ["4006381333931"]})[0], encoding="utf-8")
    r = catalogs.read_catalog(spark, str(path)).first()
    assert r.gtins == ["04006381333931"] and r.canonical_product_id.startswith("prod_") and len(r.canonical_product_id) == 21


def test_replace_catalog(spark, shelf):
    a = identity.ATTRIBUTES
    runtime = spark.createDataFrame(
        [("prod_old", "x", None, [], "confirmed"), ("prod_m", "y", None, ["04006381333931"], "provisional"), ("prod_r", "z", None, [], "review"), ("prod_lost", "w", None, [], "provisional")],
        identity.T.StructType([*(identity.T.StructField(n, identity.T.StringType()) for n in ("canonical_product_id", "canonical_name")), identity.T.StructField("attributes", a), identity.T.StructField("gtins", identity.T.ArrayType(identity.T.StringType())), identity.T.StructField("status", identity.T.StringType())]),
    )
    pending = spark.createDataFrame([("s1", "prod_m", "provisional", [], "t"), ("s2", "prod_r", "review", [("prod_gone", 0.7)], "t"), ("s3", "prod_none", "review", [], "t")], "source_key string, product_id string, status string, candidates array<struct<canonical_product_id string, score double>>, created_at string")
    sources = spark.createDataFrame([("k1", "prod_old"), ("k2", "prod_tea")], "source_key string, canonical_product_id string")
    got = catalogs.replace_catalog(shelf, runtime, pending, sources)
    assert {r.canonical_product_id: r.status for r in got["products"].collect()} == {"prod_phone": "confirmed", "prod_cream": "confirmed", "prod_tea": "confirmed", "prod_r": "provisional"}
    assert [(r.source_key, r.status) for r in got["pending"].collect()] == [("s2", "provisional")]
    assert [r.source_key for r in got["sources"].collect()] == ["k2"] and {r.gtin: r.canonical_product_id for r in got["gtins"].collect()} == {"04006381333931": "prod_phone"}


def event(**kw):
    return dict(canonical_product_id="p", name="n", shop="s", date="2026-09-16T10:00:00.123456+03:00", original_price_kopecks=15000, promotion_price_kopecks=9999, match_status="confirmed") | kw


def test_sink_rows(spark):
    rows = [event(), event(original_price_kopecks=1_000_000_000_000), event(match_status="quarantine"), event(date="2026-09-16T10:00:00"), event(name=" "), event(promotion_price_kopecks=15000), event(shop=None)]
    df = spark.createDataFrame(rows, sink.EVENT)
    good = sink.valid_rows(df).collect()
    assert [(float(r.original_price), float(r.promotion_price)) for r in good] == [(150.0, 99.99)]
    assert good[0].date.microsecond == 123000
    assert sorted(",".join(r.errors) for r in sink.rejected_rows(df).collect()) == ["date_zone", "discount", "match_status", "name_text", "original_price", "shop_text"]


HTML = """<html><head><title>Shop</title><script type="application/ld+json">{"@type": "Product", "name": "Tea", "gtin13": "4006381333931", "weight": {"value": 2, "unitCode": "KGM"}, "offers": [{"price": "99"}]}</script>
<script id="__NEXT_DATA__">{"items": [{"title": "Green tea", "link": "/product/tea-1/", "price": 80, "oldPrice": "100", "sku": "7"}, {"title": "Same", "link": "/product/tea-1/", "price": 80, "oldPrice": "100"}, {"title": "No sale", "link": "/product/x", "price": 100, "oldPrice": 100}, {"title": "Elsewhere", "link": "https://evil.com/product/x", "price": 1, "oldPrice": 2}]}</script></head></html>"""
CARDS = """<div class="product-card" data-product-id="5"><a href="/catalog/a/b-c/">link</a><span class="name big">Soap <b>bar</b></span><i class="price-current">80 ₽</i><del>100 ₽</del></div>"""
SELECTORS = {"card": ".product-card", "link": "a[href]", "name": ".name", "current": "[data-price], .price-current", "old": "del, s"}


def test_extraction(spark):
    df = spark.createDataFrame([("https://shop.ru/", HTML), ("https://shop.ru/b", "<title>Just a moment...</title>" + HTML), ("https://shop.ru/c", CARDS), (None, None)], "url string, html string")
    got = {r.source_url: r for r in pages.unique_products(pages.extract_products(df, "shop", "shop.ru", "2026-09-16T10:00:00+00:00", SELECTORS)).collect()}
    assert set(got) == {"https://shop.ru/product/tea-1/", "https://shop.ru/catalog/a/b-c/"}
    assert got["https://shop.ru/product/tea-1/"].source_product_id == "tea-1" and got["https://shop.ru/catalog/a/b-c/"].name_raw == "Soap bar" and got["https://shop.ru/catalog/a/b-c/"].source_product_id == "5"
    assert sink.check_raw(spark.createDataFrame(list(got.values()), sink.RAW)).filter(F.size("errors") > 0).count() == 0
    linked = pages.linked_products(df.limit(1)).first()
    assert (linked.name, linked.gtin, linked.package, linked.price) == ("Tea", "4006381333931", "2 kg", "99")
    flight = 'self.__next_f.push([1,' + json.dumps('3:{"name": "Cup", "url": "/product/cup", "price": 1, "oldPrice": 2}\nx') + "])"
    assert [p["name_raw"] for p in extract.products_from_html(f"<script>{flight}</script>", "s", "shop.ru", "https://shop.ru/", "t")] == ["Cup"]


def test_blocked_pages_agree(spark):
    some = ["<title>403 Forbidden</title>", "<title>Error 429</title>", "<TITLE> Access   Denied </TITLE>", "x /cdn-cgi/challenge-platform/ y", "<title>Tea 503</title>", "", None]
    df = spark.createDataFrame([(x,) for x in some], "html string")
    assert [r[0] for r in df.select(pages.is_blocked(F.col("html"))).collect()] == [True, True, True, True, False, False, False]


def test_urls():
    assert extract.normalized_url("https://a.b/c?z=1&a=2#f") == "https://a.b/c/?a=2&z=1"
    assert extract.same_site_url("//shop.ru/x", "https://shop.ru", "shop.ru") == "https://shop.ru/x" and extract.same_site_url("https://notshop.ru/", "https://shop.ru", "shop.ru") is None
    assert extract.source_id("https://a.b/product/", {}, " Big  Tea") == ("big tea", False) and extract.source_id("https://a.b/p/77/", {}) == ("77", True)


def test_streams_equal_the_batch(spark, shelf, tmp_path):
    products = [product("Phone Acme X1 128 GB", 1, brand_raw="Acme", model_raw="X1"), product("ночной крем", 2), product("ничего", 3, old_price_text="70 ₽"), product("чай", 4, shop="ПЛОХО")]
    source, out, table, rejects = (tmp_path / n for n in ("in", "out", "table", "rejects"))
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps(p, ensure_ascii=False) for p in products[:2]), encoding="utf-8")
    (source / "b.json").write_text("\n".join(json.dumps(p, ensure_ascii=False) for p in products[2:]), encoding="utf-8")
    raw = ingest.parse_raw(ingest.json_source(spark, str(source)))
    ingest.normalize_stream(raw, shelf, str(out), str(tmp_path / "c1")).awaitTermination()
    events = spark.read.schema(sink.EVENT).parquet(str(out / "*"))
    batch = identity.normalized_events(spark.createDataFrame(products[:3], sink.RAW), shelf)
    assert sorted(map(tuple, events.collect())) == sorted(map(tuple, batch.collect())) and events.count() == 2
    lines_dir = tmp_path / "events"
    events.select(F.to_json(F.struct("*")).alias("value")).union(spark.createDataFrame([('{"name": "broken"}',)], "value string")).write.text(str(lines_dir))
    ingest.sink_stream(ingest.parse_events(ingest.json_source(spark, str(lines_dir))), str(table), str(rejects), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(table / "*")).count() == 2 and spark.read.parquet(str(rejects / "*")).count() == 1


def test_pending_cards_over_batches(spark, tmp_path):
    schema = "source_key string, canonical_product_id string, status string, gtin string, collected_at string"
    rows = [("s:1", "prod_a", "provisional", None, "2026-01-01"), ("s:1", "prod_b", "review", "g1", "2026-01-02"), ("s:2", "prod_c", "quarantine", None, "2026-01-01"), ("s:3", "prod_d", "confirmed", None, "2026-01-01")]
    for n, part in enumerate((rows[:1] + rows[2:], rows[1:2])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / f"in{n}"))
    want = {r.source_key: tuple(r) for r in ingest.pending_cards(spark.createDataFrame(rows, schema)).collect()}
    assert want["s:1"] == ("s:1", "prod_a", "review", ["g1"], "2026-01-01", 2) and set(want) == {"s:1", "s:2"}
    stream = ingest.pending_stream(spark.readStream.schema(schema).json(str(tmp_path / "in*")))
    got = {}
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: got.update({r.source_key: tuple(r) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert got == want


def test_the_catalog_is_the_whole_part_table(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    shelf = adapter.catalog(spark, sf_dir).cache()
    assert {r.canonical_product_id for r in shelf.collect()} == {f"prod_c{r.p_partkey}" for r in part.collect()}


def test_identity_over_a_whole_catalog(spark, sf_dir):
    """Blocks split by brand: the candidates without a conflict are those of the plain blocks."""
    shelf = adapter.catalog(spark, sf_dir)
    rows = identity.prepare(adapter.raw_products(spark, sf_dir).withColumn("rid", F.col("source_product_id").cast("long")).withColumn("brand_raw", F.when(F.col("rid") % 9 > 0, F.col("brand_raw")).otherwise("")))
    told = lambda **kw: {(r.rid, r.c.canonical_product_id, r.c.score) for r in identity.match_candidates(rows, shelf, 10_000, **kw).select("rid", F.explode("candidates").alias("c")).filter("size(c.conflicts) = 0").collect()}
    plain = told()
    assert plain and told(other_brands=False) == plain


def test_pending_cards_go_on(spark, shelf, tmp_path):
    """A batch after others: cards keep id and time, learn a GTIN; conflicts go to quarantine and stay there."""
    lamp, chair, desk, bowl = (product(n, k, brand_raw=b) for k, (n, b) in enumerate([("Настольная лампа белая", "Lumo"), ("Кресло серое большое", "Sidi"), ("Письменный стол дуб", "Sidi"), ("Миска глубокая синяя", "Lumo")], 1))
    told = {r.source_key: r.attributes for r in identity.prepare(spark.createDataFrame([lamp, chair, desk, bowl], sink.RAW)).collect()}
    cards = [("lenta:1", "prod_lamp", "provisional", []), ("lenta:2", "prod_chair", "review", []), ("lenta:3", "prod_desk", "quarantine", []), ("lenta:4", "prod_bowl", "provisional", ["00000073513537"])]
    state = identity.State(
        spark.createDataFrame([(i, told[k].name, told[k], codes, status) for k, i, status, codes in cards], identity.PRODUCT),
        spark.createDataFrame([(k, i, status, [], [], "2026-09-01") for k, i, status, _ in cards[:3]], identity.PENDING),
        spark.createDataFrame([("lenta:9", "prod_tea")], identity.SOURCES), spark.createDataFrame([], identity.GTINS),
    )
    rows = [lamp | {"gtin_raw": "96385074"}, chair | {"brand_raw": "Other"}, desk, bowl | {"gtin_raw": "73513537", "shop": "magnit"}, product("чай зеленый", 9)]
    resolved = identity.resolve(spark.createDataFrame(rows, sink.RAW), shelf, state=state).persist()
    got = {r.source_key: (r.method, r.status, r.score, r.canonical_product_id, r.conflicts) for r in resolved.collect()}
    assert got["lenta:1"] == ("new_gtin", "provisional", 0.95, "prod_lamp", [])
    assert got["lenta:2"] == ("quarantine", "quarantine", 0.0, "prod_chair", ["brand"])
    assert got["lenta:3"] == ("quarantine", "quarantine", 0.0, "prod_desk", ["pending_quarantine"])
    assert got["magnit:4"] == ("gtin", "provisional", 1.0, "prod_bowl", [])
    assert got["lenta:9"] == ("source_id", "confirmed", 1.0, "prod_tea", [])
    after = identity.next_state(resolved, state)
    products = {r.canonical_product_id: (r.gtins, r.status) for r in after.products.collect()}
    assert products == {"prod_lamp": (["00000096385074"], "provisional"), "prod_chair": ([], "quarantine"), "prod_desk": ([], "quarantine"), "prod_bowl": (["00000073513537"], "provisional")}
    pending = {r.source_key: (r.product_id, r.status, r.created_at) for r in after.pending.collect()}
    assert pending["lenta:1"] == ("prod_lamp", "provisional", "2026-09-01") and pending["magnit:4"] == ("prod_bowl", "provisional", rows[3]["collected_at"]) and len(pending) == 4
    assert [tuple(r) for r in after.sources.collect()] == [("lenta:9", "prod_tea")]
    resolved.unpersist()


def test_state_snapshots(spark, tmp_path):
    """The newest whole snapshot below a batch's number is read; a broken one does not count."""
    rows = lambda i: spark.createDataFrame([(f"k{i}", f"p{i}")], identity.SOURCES)
    for n in (0, 2):
        ingest.write_state(spark, identity.State(*list(identity.State.empty(spark).tables().values())[:2], rows(n), spark.createDataFrame([], identity.GTINS)), str(tmp_path), n)
    (tmp_path / "version=2" / "_done").unlink()
    assert [r.source_key for r in ingest.read_state(spark, str(tmp_path), 9).sources.collect()] == ["k0"]
    assert ingest.read_state(spark, str(tmp_path), 0).sources.count() == 0


def test_a_bad_line_is_told_with_its_number(spark, tmp_path):
    path = tmp_path / "catalog.jsonl"
    path.write_text('{"canonical_product_id": "prod_a", "canonical_name": "чай"}\n\n{"canonical_product_id": "prod_b", "canonical_name": "!!!"}\nnot json\n', encoding="utf-8")
    with pytest.raises(ValueError, match="line 3: "):
        catalogs.read_catalog(spark, str(path))


def test_counters(spark):
    from promolith.streaming import metrics

    rows = [("gtin", "confirmed", 1.0, []), ("gtin", "provisional", 1.0, []), ("quarantine", "quarantine", 0.0, ["brand", "brand"]), ("review", "review", 0.7, [])]
    df = spark.createDataFrame(rows, "method string, status string, score double, conflicts array<string>")
    assert {tuple(r) for r in metrics.match_counts(df).collect()} == {("gtin", "confirmed", 1), ("gtin", "provisional", 1), ("quarantine", "quarantine", 1), ("review", "review", 1)}
    assert [tuple(r) for r in metrics.conflict_counts(df).collect()] == [("brand", 1)]
    assert {r.method: (r["le_0"], r["le_0.8"], r["le_1"]) for r in metrics.score_buckets(df).collect()} == {"gtin": (0, 0, 2), "quarantine": (1, 1, 1), "review": (0, 1, 1)}
    out, watch = metrics.observed(df)
    out.write.format("noop").mode("overwrite").save()
    assert (watch.get["normalized"], watch.get["gtin"], watch.get["conflicting"]) == (4, 2, 1)
    codes = spark.createDataFrame([("4006381333931",), ("1",), (None,), ("",)], "gtin_raw string")
    assert {r.status: r.n for r in metrics.gtin_counts(codes).collect()} == {"valid": 1, "invalid": 1, "missing": 2}


def test_shop_cards():
    """Descendant selectors, links that a price stands around, names by the link."""
    told = lambda shop, html: [(p["source_url"], p["name_raw"], p["current_price_text"], p["old_price_text"]) for p in extract.products_from_html(html, shop, extract.SHOPS[shop][0], f"https://{extract.SHOPS[shop][0]}/", "t", extract.SHOPS[shop][1])]
    mvideo = "<mvid-product-card><mvid-product-title><a href='/products/tv-1'>Big TV</a></mvid-product-title><mvid-sale-price>90 ₽</mvid-sale-price><s>100 ₽</s></mvid-product-card>"
    assert told("mvideo", mvideo) == [("https://mvideo.ru/products/tv-1", "Big TV", "90 ₽", "100 ₽")]
    magnit = "<div><p>нет</p><div><a href='/promo-product/7-tea'>x</a><h3>Tea leaf</h3><span class='price-current'>80 ₽</span><del>99 ₽</del></div></div>"
    assert told("magnit", magnit) == [("https://magnit.ru/promo-product/7-tea", "Tea leaf", "80 ₽", "99 ₽")]
    podruzhka = "<div class='product-card'><a href='/catalog/cream/9'>Soft cream</a><i class='price-current'>5 ₽</i><del class='x text-inherit'>6 ₽</del></div>"
    assert told("podruzhka", podruzhka) == [("https://podrygka.ru/catalog/cream/9", "Soft cream", "5 ₽", "6 ₽")]
    assert list(extract.select(extract.Page("<div id='a'><p class='b'><i data-k='xyz'>t</i></p></div><i>u</i>").root, "#a .b i[data-k*='y']"))[0]["inside"] == ["t"]


def test_copies_in_the_catalog_are_scored_once_and_nothing_is_broadcast(spark):
    """The least ids stand for products that say the same; sizes of files do not make a join a broadcast."""
    row = lambda n, name: (n, "shop", "u", n, True, name, None, "", "", "acme", "", "", "10 ₽", "20 ₽", "t")
    names = "k string, shop string, source_url string, source_product_id string, source_id_is_stable boolean, name_raw string, gtin_raw string, model_raw string, variant_raw string, brand_raw string, category_raw string, package_raw string, current_price_text string, old_price_text string, collected_at string"
    raw = spark.createDataFrame([row(str(n), "copper kettle 3 l" if n < 8 else "copper kettle 5 l") for n in range(9)], names)
    ready = identity.prepare(raw)
    shelf = ready.select(F.concat(F.lit("prod_"), "k").alias("canonical_product_id"), F.col("name_raw").alias("canonical_name"), "attributes", F.array().cast("array<string>").alias("gtins"), F.array().cast("array<struct<shop:string,name:string>>").alias("aliases"))
    asked = ready.select(F.col("k").alias("rid"), "attributes", F.lit(None).cast("string").alias("gtin"))
    got = {r.rid: [c.canonical_product_id for c in r.candidates] for r in identity.match_candidates(asked, shelf, other_brands=False).collect()}
    assert got == {str(n): ["prod_0", "prod_1", "prod_2"] for n in range(8)} | {"8": ["prod_8"]}
    said = identity._alike(identity._catalog_view(shelf), 3, True).collect()
    assert sorted(r.members for r in said) == [["prod_0", "prod_1", "prod_2"], ["prod_8"]]
    plan = identity.resolve(raw, shelf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_parts_are_dealt_over_tasks(spark, sf_dir, monkeypatch):
    from promolith.plans import adapter

    whole = spark.read.parquet(f"{sf_dir}/part.parquet")
    monkeypatch.setattr(adapter, "ROWS_A_TASK", whole.count() // 4)
    dealt = adapter.parts(spark, sf_dir)
    assert dealt.rdd.getNumPartitions() >= 4 and sorted(dealt.collect()) == sorted(whole.collect())


def test_catalog_problems_read_the_catalog_once(spark, monkeypatch):
    from promolith.sources import catalog

    monkeypatch.setattr(catalog, "MOST_AT_ONCE", 2)
    lines = ["{"] * 5 + ['{"canonical_product_id": "prod_a", "canonical_name": "green tea", "aliases": ["x1"]}'] * 2 + ['{"canonical_product_id": "prod_b", "canonical_name": "black tea", "aliases": ["x1"]}']
    found = catalog.catalog_problems(catalog.parse_catalog(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert sorted((r.problem, "" if r.problem == "line" else r.value) for r in found.collect()) == [("alias", "*:x1"), ("id", "prod_a"), *[("line", "")] * 5]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_rows_that_a_gtin_settles_alone(spark, sf_dir):
    """The same rows as among all: conflicts, sources and aliases that disagree, learnt GTINs, codes that nobody has."""
    items = [
        {"canonical_product_id": "prod_phone", "canonical_name": "Acme Phone X1 128 GB", "brand": "Acme", "model": "X1", "gtins": ["4006381333931"], "aliases": [{"shop": "lenta", "name": "Acme phone"}]},
        {"canonical_product_id": "prod_cream", "canonical_name": "Крем для лица ночной 50 мл", "brand": "Nivea", "aliases": ["Ночной крем"]},
    ]
    shelf = catalogs.parse_catalog(spark.createDataFrame([(x,) for x in lines(*items)], "value string")).drop("error")
    code = {"gtin_raw": "4006381333931"}
    rows = [
        product("Acme Phone X1 128 GB", 1, **code), product("Acme Phone X1 128 GB", 2, **code, brand_raw="Other"), product("Acme Phone X1 256 GB", 3, **code), product("ночной крем", 4, **code), product("Acme phone", 5, **code), product("Acme phone", 6, shop="magnit", **code),
        product("крем", 7, gtin_raw="96385074"), product("вещь", 8, gtin_raw="73513537"), product("Acme Phone X1 128 GB", 9), product("!!!", 10, **code), product("телефон", 11, gtin_raw="4006381333932"), product("телефон", 12, **code), product("Acme phone", 13),
    ]
    raw = spark.createDataFrame(rows, sink.RAW)
    sources = spark.createDataFrame([("lenta:12", "prod_cream"), ("lenta:1", "prod_phone")], identity.SOURCES)
    empty = identity.State.empty(spark)
    state = identity.State(empty.products, empty.pending, sources, spark.createDataFrame([("00000096385074", "prod_cream")], identity.GTINS))
    for known, want in (({}, {"1", "5", "6", "12"}), ({"sources": sources}, {"1", "5", "6"}), ({"state": state}, {"1", "5", "6", "7"})):
        every = identity.resolve(raw, shelf, **known).filter("method = 'gtin'")
        alone = identity.resolve(raw, shelf, **known, gtin_only=True)
        assert alone.columns == every.columns and {r.source_key.split(":")[1] for r in alone.collect()} == want
        assert sorted(map(str, alone.collect())) == sorted(map(str, every.collect()))


def test_nothing_is_made_of_parts_before_they_are_dealt(spark, sf_dir, monkeypatch):
    """Filters on what is made of a row stay above the shuffle, and texts are read in Python once."""
    import __spark_entry__ as entry

    monkeypatch.setattr(adapter, "ROWS_A_TASK", 16)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    settled = plan(entry.queries()["identity_gtin"](spark, sf_dir))
    for told in (settled, plan(adapter.raw_products(spark, sf_dir).filter("gtin_raw is not null"))):
        below = [part.split("Relation [")[0] for part in told.split("RepartitionByExpression")[1:]]
        assert below and not any("Filter" in part or "Eval" in part for part in below)
    assert settled.count("attributes_of(") == 2 and "InMemoryRelation" not in settled
