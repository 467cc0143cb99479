"""Payloads of stores, shopping results and market places as listings, with native JSON and XML functions. Malformed payloads give no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.ids import normalize_gtin
from larkspur.functions.text import condition, conditional_kind, foreign_price, parse_price, shipping_of, vendor_display

STORE = "struct<title:string,vendor:string,handle:string,variants:array<struct<id:string,title:string,sku:string,barcode:string,price:string,compare_at_price:string,available:boolean>>>"
SHOPPING = "array<struct<title:string,source:string,price:string,extracted_price:double,old_price:string,delivery:string,second_hand_condition:string,product_link:string,tag:string,badge:string>>"
MARKET = "array<struct<itemId:string,title:string,condition:string,price:struct<value:string,currency:string>,shippingOptions:array<struct<shippingCostType:string,shippingCost:struct<value:string>>>,seller:struct<username:string,feedbackPercentage:string,feedbackScore:long>,itemWebUrl:string>>"


def _cents(c):
    """Whole numbers are cents, decimal texts dollars."""
    return F.when(c.rlike(r"^\d+$"), c.try_cast("double") / 100).otherwise(parse_price(c))


def store_variants(payloads: DataFrame) -> DataFrame:
    """A row for each variant of store products (url, payload)."""
    p = F.coalesce(F.from_json(F.get_json_object("payload", "$.product"), STORE), F.from_json("payload", STORE))
    rows = payloads.withColumn("p", p).select("url", "p.title", "p.vendor", "p.handle", F.posexplode("p.variants").alias("ord", "v"))
    price, regular = _cents(F.col("v.price")), _cents(F.col("v.compare_at_price"))
    named = F.coalesce(F.nullif(F.col("v.title"), F.lit("Default Title")), F.lit(""))
    return rows.where(price > 0).select(
        "url", "ord", F.trim(F.concat_ws(" ", "title", named)).alias("title"), "vendor", "handle", F.col("v.id").alias("variant_id"), F.col("v.sku").alias("sku"),
        normalize_gtin(F.col("v.barcode")).alias("gtin"), price.alias("price"), F.when(regular > price, regular).alias("regular_price"), F.col("v.available").alias("in_stock"),
    )


def shopping_rows(payloads: DataFrame) -> DataFrame:
    """Listings of shopping results (query, payload), those with a dollar price only."""
    rows = payloads.select("query", F.posexplode(F.from_json(F.get_json_object("payload", "$.shopping_results"), SHOPPING)).alias("ord", "r"))
    price = F.coalesce("r.extracted_price", parse_price(F.col("r.price")))
    foreign = foreign_price(F.col("r.price"))
    regular = parse_price(F.col("r.old_price"))
    return rows.where((price > 0) & ~foreign).select(
        "query", "ord", F.col("r.title").alias("title"), vendor_display(F.col("r.source")).alias("vendor"), price.alias("price"), F.when(regular > price, regular).alias("regular_price"),
        shipping_of(F.col("r.delivery")).alias("shipping"), condition(F.col("r.title"), F.col("r.second_hand_condition")).alias("condition"), F.col("r.product_link").alias("url"),
        F.nullif(conditional_kind(F.concat_ws(" | ", "r.tag", "r.badge"))["kind"], F.lit("")).alias("conditional"), F.lit("market_snapshot").alias("evidence"),
    )


def market_rows(payloads: DataFrame, min_percent: float = 95.0, min_score: int = 10) -> DataFrame:
    """Listings of market-place results (query, payload) in dollars, with seller_ok."""
    rows = payloads.select("query", F.posexplode(F.from_json(F.get_json_object("payload", "$.itemSummaries"), MARKET)).alias("ord", "r"))
    price, option = parse_price(F.col("r.price.value")), F.get(F.col("r.shippingOptions"), F.lit(0))
    seller_ok = (F.coalesce(F.col("r.seller.feedbackPercentage").try_cast("double"), F.lit(0.0)) >= min_percent) & (F.coalesce(F.col("r.seller.feedbackScore"), F.lit(0)) >= min_score)
    shipping = F.when(option["shippingCostType"] == "FREE", F.lit(0.0)).otherwise(parse_price(option["shippingCost"]["value"]))
    return rows.where((price > 0) & (F.col("r.price.currency") == "USD")).select(
        "query", "ord", F.col("r.title").alias("title"), F.col("r.seller.username").alias("vendor"), price.alias("price"), shipping.alias("shipping"), condition(F.col("r.title"), F.col("r.condition")).alias("condition"),
        seller_ok.alias("seller_ok"), F.col("r.itemWebUrl").alias("url"), F.col("r.itemId").alias("merchant_item_id"), F.lit("verified_direct").alias("evidence"),
    )


def sitemap_links(maps: DataFrame) -> DataFrame:
    """(url, link, position) of the locations of sitemaps (url, xml), in order."""
    return maps.select("url", F.posexplode(F.regexp_extract_all(F.coalesce("xml", F.lit("")), F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("position", "link"))
