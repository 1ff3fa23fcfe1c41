"""Captured payloads and pages as registered queries: the parts table is written as what shops
send, read by the parsers, and held against SQL over the table itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tianguis.plans.listings import table
from tianguis.plans.queries import query
from tianguis.sources import pages, payloads

AT, STAMP = "2024-03-01 08:30:00", "2024-03-01T08:30:00Z"


def _captured(**columns: Column) -> list[Column]:
    return [F.lit(AT).cast("timestamp").alias("captured_at"), *[c.alias(n) for n, c in columns.items()]]


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))


@query(f"""SELECT 'm:' || p_partkey || ':{STAMP}' AS observation_id, CAST(p_partkey AS VARCHAR) AS listing_id, p_name AS title, p_brand AS seller, p_type AS province, p_retailprice AS price,
  CASE WHEN p_partkey % 3 = 0 THEN 'CUP' ELSE 'USD' END AS currency, 'https://m.example/' || lower(replace(p_brand, '#', '-')) AS url FROM part WHERE p_partkey % 7 <> 0""")
def payload_marketplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload a province, with businesses and their offers; offers without a name are none."""
    offer = F.struct(F.col("k").alias("offerId"), F.when(F.col("k") % 7 == 0, "").otherwise(F.col("p_name")).alias("offerName"), F.col("p_retailprice").alias("price"), F.when(F.col("k") % 3 == 0, "CUP").alias("currency"))
    business = _part(spark, sf_dir).groupBy("p_type", "p_brand").agg(F.collect_list(offer).alias("offers"))
    each = F.struct(F.col("p_brand").alias("id"), F.col("p_brand").alias("name"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("slug"), F.lit("USD").alias("currency"), "offers")
    sent = business.groupBy("p_type").agg(F.collect_list(each).alias("list")).select(*_captured(province=F.col("p_type"), payload=F.to_json(F.struct("list"))))
    return payloads.marketplace(sent, "m", "https://m.example/").select("observation_id", "listing_id", "title", "seller", "province", "price", "currency", "url")


@query(f"""WITH v AS (
  SELECT p_partkey AS k, p_name, p_type, p_retailprice AS price, 0 AS i FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey, p_name, p_type, p_retailprice + i, i FROM part, range(1, 4) r(i) WHERE i <= p_partkey % 4)
SELECT CASE WHEN i = 0 THEN CAST(k AS VARCHAR) ELSE k || '-' || i END || '@' || lower(p_type) AS listing_id, p_name AS title, CASE WHEN i > 0 AND k % 5 <> 0 THEN round(price + 3.25 + i, 2) END AS price,
  CASE WHEN i = 1 THEN 'agotado' END AS availability, 'Envíos' AS seller FROM v""")
def payload_shipped_goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with none to three variants; the delivered price takes the cheapest of two carriers, and without one there is none."""
    carriers = lambda i: F.array(F.struct(F.lit("slow").alias("carrier_name"), (i + 3.25).alias("carrier_price")), F.struct(F.lit("fast").alias("carrier_name"), (i + 9.0).alias("carrier_price")))
    count = (F.col("k") % 4).cast("int")
    variants = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: i <= count),
        lambda i: F.struct(F.concat_ws("-", F.col("k").cast("string"), i.cast("string")).alias("id"), (F.col("p_retailprice") + i).alias("price"), F.when(i == 1, 0.0).otherwise(2.0).alias("qty_available"),
                           F.when(F.col("k") % 5 != 0, carriers(i)).alias("shipping")),
    )
    element = F.struct(F.col("k").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"), F.lit("USD").alias("currency"), variants.alias("variants"))
    sent = _part(spark, sf_dir).groupBy("p_type").agg(F.collect_list(element).alias("elements"))
    sent = sent.select(*_captured(province=F.col("p_type"), payload=F.to_json(F.struct(F.struct("elements").alias("data")))))
    return payloads.shipped_goods(sent, "e", "Envíos").select("listing_id", "title", "price", "availability", "seller")


@query("""SELECT p_partkey || '@' || lower(p_type) AS listing_id, p_name AS title, p_brand AS seller, p_retailprice AS price, CASE WHEN p_type <> 'LARGE' THEN 'USD' END AS currency,
  CASE WHEN p_size % 6 = 0 THEN 'agotado' ELSE 'disponible' END AS availability FROM part WHERE p_partkey % 11 <> 0""")
def payload_shop_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shop page a municipality; the currency counts where the page shows it."""
    product = F.struct(F.col("k").cast("string").alias("id"), F.when(F.col("k") % 11 != 0, F.col("p_name")).alias("name"), F.col("p_retailprice").alias("salePrice"), F.col("p_brand").alias("commercialName"), (F.col("p_size") % 6 == 0).alias("isOutOfStock"))
    sent = _part(spark, sf_dir).groupBy("p_type").agg(F.collect_list(product).alias("products"))
    shown = F.when(F.col("p_type") == "LARGE", "Precio").otherwise("Precio USD")
    sent = sent.select(*_captured(province=F.lit("P"), municipality=F.col("p_type"), page_text=shown, payload=F.to_json(F.struct(F.struct("products").alias("data")))))
    return payloads.shop_page(sent, "c").select("listing_id", "title", "seller", "price", "currency", "availability")


@query("""SELECT c.to_ AS from_currency, CAST(o_orderdate + INTERVAL 10 HOUR + CASE WHEN month(o_orderdate) BETWEEN 5 AND 9 THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS TIMESTAMP) AS as_of, c.f * o_totalprice AS rate, count(*) AS n
FROM orders, (VALUES ('USD', 1.0::DOUBLE), ('EUR', 2.0::DOUBLE)) c(to_, f) WHERE (month(o_orderdate) BETWEEN 5 AND 9 OR month(o_orderdate) IN (1, 2, 12)) AND o_totalprice > 0 GROUP BY ALL""")
def payload_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates published at ten in local time, in months whose offset from UTC is certain; other codes and what isn't a number go."""
    at, price = F.col("o_orderdate"), F.col("o_totalprice")
    sure = table(spark, sf_dir, "orders").where(F.month(at).isin(1, 2, 5, 6, 7, 8, 9, 12))
    named = F.create_map(F.lit("usd"), price.cast("string"), F.lit("ECU"), (price * 2).cast("string"), F.lit("BTC"), F.lit("1"), F.lit("MLC"), F.lit("x"), F.lit("EUR"), F.lit("-1"))
    sent = sure.select(F.to_json(F.struct(F.date_format(at, "yyyy-MM-dd").alias("date"), F.lit(10).alias("hour"), F.lit(0).alias("minutes"), F.lit(0).alias("seconds"), named.alias("tasas"))).alias("payload"))
    return payloads.rate_payload(sent, "CUP", "s").groupBy("from_currency", "as_of", "rate").agg(F.count("*").alias("n"))


@query("SELECT replace(url, '&', '&') AS url, count(*) AS n FROM pages GROUP BY ALL")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's address, written as a sitemap a host and read again."""
    rows = table(spark, sf_dir, "pages").select("url", F.substring_index(F.regexp_replace("url", "^https?://", ""), "/", 1).alias("host"))
    loc = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    maps = rows.groupBy("host").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(loc), ""), F.lit("</urlset>")).alias("xml"))
    return payloads.sitemap(maps).groupBy("url").agg(F.count("*").alias("n"))


def _page(script: Column, attributes: str) -> Column:
    return F.concat(F.lit(f"<html><body><p>x</p><script{attributes}>"), script, F.lit("</script></body></html>"))


@query("""SELECT 'c:' || p_partkey AS observation_id, CAST(p_partkey AS VARCHAR) AS listing_id, 'https://c.example/ad/' || p_partkey AS url, p_name || ' ' || p_size || ' ml' AS title, p_type AS province,
  p_retailprice AS price, 'CUP' AS currency, CASE WHEN p_partkey % 5 = 0 THEN 'img' || p_size END AS image_id, p_partkey % 9 = 0 AS promoted FROM part""")
def page_client_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifieds pages with a client state: references, places by id, promoted ads, an ad that comes twice."""
    ad = F.struct(
        F.col("k").cast("string").alias("id"), F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" ml")).alias("title"), F.col("p_retailprice").alias("price"), F.lit("CUP").alias("currency"),
        F.concat(F.lit("/ad/"), F.col("k").cast("string")).alias("permalink"), F.col("p_type").alias("provinceId"), F.when(F.col("k") % 5 == 0, F.struct(F.concat(F.lit("img"), F.col("p_size").cast("string")).alias("gcsKey"))).alias("mainImage"),
        (F.col("k") % 9 == 0).alias("isPromoted"), F.struct(F.struct(F.lit("53").alias("prefix"), F.lit("555").alias("number")).alias("firstPhone")).alias("phoneInfo"),
    )
    key = F.concat(F.lit("AdType:"), F.col("k").cast("string"))
    by_brand = _part(spark, sf_dir).groupBy("p_brand").agg(
        F.map_from_entries(F.collect_list(F.struct(key, F.to_json(ad)))).alias("ads"), F.collect_list(F.struct(F.struct(key.alias("__ref")).alias("node"))).alias("edges"),
        F.map_from_entries(F.collect_set(F.struct(F.concat(F.lit("ProvinceType:"), F.col("p_type")), F.to_json(F.struct(F.col("p_type").alias("id"), F.col("p_type").alias("name")))))).alias("places"),
    )
    result = F.to_json(F.struct(F.concat("edges", F.slice("edges", 1, 1)).alias("edges")))
    query_ = F.concat(F.lit('{"x":1,"adsPerPage({})":'), result, F.lit("}"))
    entries = F.map_concat("ads", "places", F.create_map(F.lit("ROOT_QUERY"), query_))
    # values are JSON already
    state = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(entries), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))
    script = F.concat(F.lit('{"props":{"pageProps":{"__APOLLO_STATE__":'), state, F.lit("}}}"))
    sent = by_brand.select(*_captured(url=F.col("p_brand"), base=F.lit("https://c.example"), html=_page(script, ' id="__NEXT_DATA__" type="application/json"')))
    out = pages.page_listings(sent, "classifieds", "c", seller_key=b"k")
    return out.select("observation_id", "listing_id", "url", "title", "province", F.col("price").cast("double").alias("price"), "currency", "image_id", F.get_json_object("raw", "$.promoted").cast("boolean").alias("promoted"))


@query("""SELECT 'g:' || p_partkey AS observation_id, 'https://g.example/' || p_partkey AS url, p_name AS title, p_brand AS seller, p_type AS province, p_retailprice AS price,
  CASE WHEN p_partkey % 2 = 0 THEN 'USD' END AS currency FROM part WHERE p_partkey % 13 <> 0""")
def page_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose ads stand somewhere inside a stream of JSON rows; a price in words is no price."""
    price = F.when(F.col("k") % 13 == 0, F.lit('"Precio"')).when(F.col("k") % 2 == 0, F.concat(F.lit('{"amount":'), F.col("p_retailprice").cast("string"), F.lit(',"currency":"USD"}'))).otherwise(F.col("p_retailprice").cast("string"))
    ad = F.concat(
        F.lit('{"id":"'), F.col("k").cast("string"), F.lit('","name":"'), F.col("p_name"), F.lit('","price":'), price, F.lit(',"slug":"'), F.col("k").cast("string"),
        F.lit('","province":{"name":"'), F.col("p_type"), F.lit('"},"owner":{"name":"'), F.col("p_brand"), F.lit('"}}'),
    )
    row = F.concat(F.lit('a:["$","div",null,{"ads":['), F.array_join(F.collect_list(ad), ","), F.lit("]}]"))
    by_brand = _part(spark, sf_dir).groupBy("p_brand", "p_type").agg(row.alias("row"))
    pushed = F.concat(F.lit('self.__next_f.push([1,"'), F.replace(F.replace("row", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('\\n"])'))
    sent = by_brand.select(*_captured(url=F.col("p_brand"), base=F.lit("https://g.example"), html=_page(pushed, "")))
    return pages.page_listings(sent, "classifieds", "g").select("observation_id", "url", "title", "seller", "province", F.col("price").cast("double").alias("price"), "currency")


@query(f"""SELECT 'p:K' || p_partkey || ':{STAMP}' AS observation_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_brand END AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS seller,
  p_retailprice AS price, 'EUR' AS currency, CASE WHEN p_size % 3 = 0 THEN 'agotado' ELSE 'disponible' END AS availability, CASE WHEN p_size % 4 = 0 THEN 'usado' ELSE 'nuevo' END AS condition FROM part""")
def page_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a product in linked data, in a list, in a graph or alone; half are sold by others."""
    k = F.col("k")
    price = F.col("p_retailprice").cast("string")
    offer = F.concat(
        F.when(k % 3 == 0, F.concat(F.lit('{"@type":"AggregateOffer","lowPrice":"'), price)).otherwise(F.concat(F.lit('{"@type":"Offer","price":"'), price)), F.lit('","priceCurrency":"EUR","availability":"https://schema.org/'),
        F.when(F.col("p_size") % 3 == 0, "OutOfStock").otherwise("InStock"), F.lit('","itemCondition":"https://schema.org/'), F.when(F.col("p_size") % 4 == 0, "UsedCondition").otherwise("NewCondition"), F.lit('"}'),
    )
    brand = F.when(k % 2 == 0, F.concat(F.lit('{"name":"Vendido por '), F.col("p_brand"), F.lit('"}'))).otherwise(F.concat(F.lit('"'), F.col("p_brand"), F.lit('"')))
    product = F.concat(F.lit('{"@type":"Product","sku":"K'), k.cast("string"), F.lit('","name":"'), F.col("p_name"), F.lit('","brand":'), brand, F.lit(',"offers":'), F.when(k % 5 == 0, F.concat(F.lit("["), offer, F.lit("]"))).otherwise(offer), F.lit("}"))
    linked = F.when(k % 3 == 0, F.concat(F.lit('[{"@type":"Thing"},'), product, F.lit("]"))).when(k % 3 == 1, F.concat(F.lit('{"@graph":['), product, F.lit("]}"))).otherwise(product)
    sent = _part(spark, sf_dir).select(*_captured(url=F.concat(F.lit("https://p.example/"), k.cast("string")), base=F.lit("https://p.example"), html=_page(linked, ' type="application/ld+json"')))
    return pages.page_listings(sent, "product", "p").select("observation_id", "title", "brand", "seller", F.col("price").cast("double").alias("price"), "currency", "availability", "condition")
