"""Captured JSON payloads of shops and rate services as listings and rates; columns only.

Each parser takes a table with the payload's text in ``payload`` and ``captured_at`` beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tianguis.functions.text import fold

MARKETPLACE = (
    "struct<list:array<struct<id:string,name:string,slug:string,currency:string,averageScore:double,sponsored:boolean,categories:array<struct<name:string>>,"
    "deliveryTimeRestaurantDto:struct<deliveryTime:string,deliveryTimeUnitEs:string>,"
    "offers:array<struct<offerId:string,offerName:string,price:double,currency:string,originalPrice:double,priceByMeasure:string>>>>>"
)
SHIPPED = (
    "struct<data:struct<elements:array<struct<id:string,title:string,price:double,currency:string,customs_duty:double,weight:double,"
    "variants:array<struct<id:string,title:string,slug:string,price:double,qty_available:double,shipping:array<struct<carrier_name:string,carrier_price:double>>>>>>>>"
)
SHOP = (
    "struct<data:struct<products:array<struct<id:string,name:string,shortDescription:string,salePrice:double,commercialName:string,isOutOfStock:boolean,"
    "stock:double,categoryName:string,tags:array<struct<name:string>>>>>>"
)


def place_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"\s+", " "))


def _stamp() -> Column:
    return F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ssXXX")


def marketplace(payloads: DataFrame, source_id: str, site: str = "", source_name: str | None = None) -> DataFrame:
    """Businesses with their offers; the business sells, and its currency stands in for an offer's."""
    biz = payloads.select("captured_at", "province", F.explode(F.from_json("payload", MARKETPLACE)["list"]).alias("b"))
    offer = biz.select("captured_at", "province", "b", F.explode("b.offers").alias("o")).where(F.col("o.offerId").isNotNull() & (F.coalesce("o.offerName", F.lit("")) != ""))
    return offer.select(
        F.concat_ws(":", F.lit(source_id), "o.offerId", _stamp()).alias("observation_id"), F.lit(source_id).alias("source_id"), F.lit(source_name).cast("string").alias("source_name"),
        F.col("o.offerId").alias("listing_id"), F.when(F.col("b.slug").isNotNull(), F.concat(F.lit(site), F.col("b.slug"))).alias("url"), F.col("o.offerName").alias("title"),
        F.col("b.name").alias("seller"), "province", F.col("o.price").alias("price"), F.coalesce("o.currency", "b.currency").alias("currency"), "captured_at",
        F.to_json(F.struct("o.*", F.col("b.id").alias("business_id"), F.col("b.averageScore").alias("business_score"), F.coalesce("b.sponsored", F.lit(False)).alias("sponsored"))).alias("raw"),
    )


def shipped_goods(payloads: DataFrame, source_id: str, seller: str, site: str = "", source_name: str | None = None) -> DataFrame:
    """Products by variant. The price is the delivered one, goods and cheapest shipping; without shipping there is none."""
    none = F.array(F.lit(None).cast("struct<id:string,title:string,slug:string,price:double,qty_available:double,shipping:array<struct<carrier_name:string,carrier_price:double>>>"))
    product = payloads.select("captured_at", "province", F.explode(F.from_json("payload", SHIPPED)["data"]["elements"]).alias("p"))
    each = product.select("captured_at", "province", "p", F.explode(F.when(F.size("p.variants") > 0, F.col("p.variants")).otherwise(none)).alias("v"))
    vid, base = F.coalesce("v.id", "p.id"), F.coalesce("v.price", "p.price")
    carriers = F.filter(F.transform("v.shipping", lambda s: s["carrier_price"]), lambda x: x.isNotNull())
    cheapest = F.array_min(carriers)
    where = place_key(F.col("province"))
    return each.where(vid.isNotNull() & base.isNotNull()).select(
        F.concat_ws(":", F.lit(source_id), vid, where, _stamp()).alias("observation_id"), F.lit(source_id).alias("source_id"), F.lit(source_name).cast("string").alias("source_name"),
        F.concat(vid, F.lit("@"), where).alias("listing_id"), F.when(F.col("v.slug").isNotNull(), F.concat(F.lit(site), F.col("v.slug"))).alias("url"),
        F.coalesce(F.nullif("v.title", F.lit("")), "p.title").alias("title"), F.lit(seller).alias("seller"), "province",
        # cents are added as decimals, which rounds as the shop shows it
        (base.cast("decimal(18,2)") + cheapest.cast("decimal(18,2)")).cast("double").alias("price"), F.col("p.currency").alias("currency"),
        F.when(F.col("v.qty_available") == 0, "agotado").alias("availability"), "captured_at",
        F.to_json(F.struct(F.col("p.id").alias("product_id"), base.alias("base_price"), cheapest.alias("cheapest_shipping"), F.size(carriers).alias("shipping_options"), "p.customs_duty", "p.weight", "v.qty_available")).alias("raw"),
    )


def shop_page(payloads: DataFrame, source_id: str, source_name: str | None = None) -> DataFrame:
    """Products of a shop page; the currency counts only where the page's visible text shows it.

    Reads ``payload, page_text, province, municipality, captured_at``.
    """
    each = payloads.select("captured_at", "province", "municipality", "page_text", F.explode(F.from_json("payload", SHOP)["data"]["products"]).alias("p"))
    where = F.trim(fold(F.coalesce("municipality", F.lit(""))))
    return each.where((F.coalesce("p.id", F.lit("")) != "") & (F.coalesce("p.name", F.lit("")) != "")).select(
        F.concat_ws(":", F.lit(source_id), "p.id", where, _stamp()).alias("observation_id"), F.lit(source_id).alias("source_id"), F.lit(source_name).cast("string").alias("source_name"),
        F.concat("p.id", F.lit("@"), where).alias("listing_id"), F.col("p.name").alias("title"), F.col("p.shortDescription").alias("description"), F.col("p.commercialName").alias("seller"),
        "province", "municipality", F.col("p.salePrice").alias("price"), F.when(F.col("page_text").contains("USD"), "USD").alias("currency"),
        F.when(F.coalesce("p.isOutOfStock", F.lit(False)), "agotado").otherwise("disponible").alias("availability"), "captured_at",
        F.to_json(F.struct(F.col("p.id").alias("product_id"), "p.stock", "p.categoryName", F.col("p.tags.name").alias("tags"))).alias("raw"),
    )


# Codes of the rate service and the currencies they stand for.
RATE_CODES = {"USD": "USD", "ECU": "EUR", "EUR": "EUR", "MLC": "MLC"}


def rate_payload(payloads: DataFrame, to: str, source: str, zone: str = "America/Havana") -> DataFrame:
    """Rates into one currency, published in local time; unknown codes and what isn't a positive number go."""
    fields = "struct<date:string,hour:int,minutes:int,seconds:int,tasas:map<string,string>>"
    p = payloads.select(F.from_json("payload", fields).alias("p")).where(F.coalesce("p.date", F.lit("")) != "")
    local = F.make_timestamp_ntz(F.year(F.to_date("p.date")), F.month(F.to_date("p.date")), F.day(F.to_date("p.date")), F.coalesce("p.hour", F.lit(0)), F.coalesce("p.minutes", F.lit(0)), F.coalesce("p.seconds", F.lit(0)))
    each = p.select(F.to_utc_timestamp(local.cast("timestamp"), zone).alias("as_of"), F.explode("p.tasas").alias("code", "value"))
    codes = F.create_map(*[F.lit(x) for pair in RATE_CODES.items() for x in pair])
    rate = F.when(F.col("value").rlike(r"^-?[0-9.]+([eE][+-]?[0-9]+)?$"), F.col("value").try_cast("double"))
    out = each.select(F.element_at(codes, F.upper("code")).alias("from_currency"), F.lit(to).alias("to_currency"), rate.alias("rate"), "as_of", F.lit(source).alias("source"))
    return out.where("from_currency is not null and rate > 0")


def sitemap(pages: DataFrame, column: str = "xml") -> DataFrame:
    loc = F.regexp_extract_all(column, F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))
    out = F.col("u")
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(mark), F.lit(char))
    return pages.select(F.explode(loc).alias("u")).select(F.trim(out).alias("url"))


def pseudonym(message: Column, key: bytes, prefix: str = "vendedor-") -> Column:
    """A stable pseudonym: keyed HMAC-SHA256, composed of built-in hashes; the message does not stay."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(message, "UTF-8")), 256))
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit(bytearray(outer)), first), 256), 1, 12))
