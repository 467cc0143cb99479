"""Tables in and out: items, observations and results, by Spark's own readers and writers."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import text as X
from larkspur.functions.ids import gtins_in_text, normalize_gtin
from larkspur.functions.urls import normalize_url, urls_in
from larkspur.operators.cache import learned_identity

OBSERVATIONS = "run string, ts timestamp, wid string, offer string, fp string, vendor string, source string, evidence string, conf string, trusted boolean, condition string, pack int, price double, shipping double, effective double, unit double, regular double, conditional string, url string, event string"


#: Days between checks of items of a priority (others are always due), and the priority of items without one.
CADENCE_DAYS, PRIORITY = {2: 6, 1: 9}, 3


def plain_header(name: str) -> str:
    """Letters and digits only, in lower case."""
    return re.sub("[^a-z0-9]+", "", name.lower())


def find_column(df: DataFrame, *names: str) -> str | None:
    """The column whose plain header equals one of the names', else begins with one."""
    for test in (str.__eq__, str.startswith):
        for n in filter(None, map(plain_header, names)):
            for column in df.columns:
                if test(plain_header(column), n):
                    return column
    return None


def load_items(sheet: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Wanted items of a sheet, whose headers are found by name or beginning; rows without a product go.

    packs are the pack sizes that an item allows: singles, for bulk items also their
    sizes, and null (any) for bulk items without sizes. Items that name only links
    but have none are searched (links_only_fallback). known (wid, product, gtins,
    mpns, brand), as `learn` keeps it, adds its codes to those of the sheet, and its
    brand where the sheet has none, for items whose product is still the same.
    """
    product = find_column(sheet, "product")

    def text(*names: str) -> Column:
        c = find_column(sheet, *names)
        return F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) if c and (c != product or "product" in names) else F.lit("")

    number = lambda c: c.try_cast("double").try_cast("int")
    rows = sheet.select(
        text("wishlist item", "wid", "id").alias("wid"), text("product", "item").alias("product"), X.entries(text("product specifications", "specifications")).alias("_specs"),
        X.entries(text("search keywords", "keywords")).alias("_words"), text("brand", "manufacturer").alias("brand"), X.split_multi(text("mpn", "model number", "model", "manufacturer part")).alias("mpns"),
        X.split_multi(text("gtin", "upc", "ean")).alias("_gtins"), F.greatest(F.lit(1), F.coalesce(number(text("quantity needed", "quantity", "qty")), F.lit(1))).alias("qty_needed"), X.parse_price(text("target price", "target")).alias("target"),
        X.truthy(text("open to used", "used")).alias("open_used"), F.coalesce(number(text("priority")), F.lit(PRIORITY)).alias("priority"), X.truthy(text("is bulk option")).alias("bulk"),
        text("bulk keywords", "bulk").alias("_bulk"), text("location").alias("location"), F.array_distinct(F.transform(urls_in(text("product urls", "product url", "product links", "links")), normalize_url)).alias("urls"),
        X.truthy(text("only check primary links", "only check product urls")).alias("_only"),
    ).where("product <> ''")
    words = X.wanted(F.col("_words"))
    gtins = F.concat(F.array_compact(F.transform("_gtins", normalize_gtin)), F.flatten(F.transform(words, gtins_in_text)))
    sizes = F.when(F.col("_bulk") != "", X.bulk_sizes(F.col("_bulk")))
    singles = F.array(F.lit(1))
    items = rows.select(
        "wid", "product", X.wanted(F.col("_specs")).alias("specs"), F.filter(words, lambda k: ~X.looks_like_sku(k)).alias("keywords"), F.filter(words, X.looks_like_sku).alias("skus"),
        F.array_distinct(F.concat(X.exclusions(F.col("_specs")), X.exclusions(F.col("_words")))).alias("exclude"), "brand", "mpns", F.array_sort(F.array_distinct(gtins)).alias("gtins"), "qty_needed", "target", "open_used",
        "priority", "bulk", sizes.alias("bulk_sizes"), F.when(~F.col("bulk"), singles).when(F.size(F.coalesce(sizes, F.array().cast("array<int>"))) > 0, F.concat(singles, sizes)).alias("packs"), "location", "urls",
        (F.col("_only") & (F.size("urls") > 0)).alias("only_links"), (F.col("_only") & (F.size("urls") == 0)).alias("links_only_fallback"),
    )
    if known is None:
        return items
    own = F.transform("mpns", lambda m: F.upper(m))
    new = F.filter("learned_mpns", lambda m: ~F.array_contains(own, F.upper(m)))
    out = learned_identity(items, known).withColumns({"gtins": F.array_sort(F.array_union("gtins", "learned_gtins")), "mpns": F.concat("mpns", new), "brand": F.coalesce(F.nullif("brand", F.lit("")), "learned_brand")})
    return out.select(*items.columns)


def select_items(
    items: DataFrame, min_priority: int | None = None, wids: list[str] | None = None, locations: list[str] | None = None, limit: int | None = None, history: DataFrame | None = None, cadence: dict[int, int] = CADENCE_DAYS,
    now: dt.datetime | None = None,
) -> DataFrame:
    """Chosen items, highest priority first, then by wid: of a priority, of ids, of a location that has one of the texts in it, and due.

    With history (wid, dt) an item isn't due until the days of its priority have passed since it was last seen, less half a day; a priority without days is always due.
    """
    if min_priority is not None:
        items = items.where(F.coalesce("priority", F.lit(0)) >= min_priority)
    if wids:
        items = items.where(F.trim("wid").isin(wids))
    if locations:
        items = items.where(F.coalesce("location", F.lit("")).rlike("(?i)" + "|".join(map(re.escape, locations))))
    if history is not None and cadence:
        gap = F.try_element_at(F.create_map(*[F.lit(x) for kv in cadence.items() for x in kv]), F.col("priority"))
        last = history.groupBy(F.col("wid").alias("_wid")).agg(F.max("dt").alias("_last"))
        age = F.unix_micros(F.lit(now) if now else F.now()) - F.unix_micros(F.col("_last"))
        early = age < (gap * 24 - 12) * 3_600_000_000
        items = items.join(last, F.trim(items["wid"]) == F.col("_wid"), "left").where(~F.coalesce(early, F.lit(False))).select(*[items[c] for c in items.columns])
    items = items.orderBy(F.desc_nulls_last("priority"), "wid")
    return items.limit(limit) if limit is not None else items


def load_vendors(sheet: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """(name, vendor_key, is_direct, domain, position) of a vendor sheet; a missing domain is that of the first known key (key: domain) that matches. Rows without a name go."""
    name, direct, domain = (find_column(sheet, *n) for n in (("vendor",), ("isdirecttoconsumer", "is direct"), ("domain",)))
    text = lambda c: F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) if c else F.lit("")
    key = X.vendor_key(text(name))
    guesses = [F.when(X.keys_match(key, F.lit(k)), F.lit(d)) for k, d in (known or {}).items()]
    found = F.coalesce(F.nullif(text(domain), F.lit("")), *guesses, F.lit(""))
    rows = sheet.select(text(name).alias("name"), key.alias("vendor_key"), X.truthy(text(direct)).alias("is_direct"), found.alias("domain"), F.monotonically_increasing_id().alias("position"))
    return rows.where("name <> ''")


#: Columns of past run rows, and the headers that they are found by.
HISTORY = {
    "dt": "rowdatetime", "run": "runid", "wid": "wishlistitem", "avg_new": "avg price (new)", "avg_res": "avg price (resale)", "n_new": "avg sample (new)", "n_res": "avg sample (resale)", "baseline": "vendor baseline (new)",
    "baseline_src": "baseline source", "link_failed": "primary link failed", "no_results": "expanded search no results",
}


def load_history(rows: DataFrame) -> DataFrame:
    """Past run rows with HISTORY's columns: times and prices typed, texts never null; rows whose time can't be read go."""
    def column(name: str) -> Column:
        c = find_column(rows, HISTORY[name])
        return F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")

    typed = {"dt": column("dt").try_cast("timestamp"), "wid": F.trim(F.coalesce(column("wid"), F.lit("")))}
    typed |= {n: X.parse_price(column(n)) for n in ("avg_new", "avg_res", "n_new", "n_res", "baseline")}
    typed |= {n: F.coalesce(column(n), F.lit("")) for n in ("run", "baseline_src", "link_failed", "no_results")}
    return rows.select(*[typed[n].alias(n) for n in HISTORY]).where("dt is not null")


#: Sections of the state that runs keep, each a map of records as JSON texts.
STATE = ("identity", "discovery", "shopify", "serp_cache", "serp_last", "http_cache", "strategies", "circuits", "offers", "vendor_stats", "vendor_candidates", "suggestions")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """(section, key, record) of state files in JSON; files that can't be read, and missing sections, give no rows."""
    text = spark.read.option("wholetext", True).text(path)
    ddl = ", ".join(f"{s} map<string,string>" for s in STATE)
    state = text.select(F.from_json("value", ddl).alias("s"))
    sections = F.array(*[F.struct(F.lit(n).alias("section"), F.coalesce(F.col(f"s.{n}"), F.create_map().cast("map<string,string>")).alias("rows")) for n in STATE])
    return state.select(F.inline(sections)).select("section", F.explode("rows").alias("key", "record"))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; lines that can't be read are skipped, missing fields are null."""
    return spark.read.schema(T.StructType.fromDDL(OBSERVATIONS)).option("mode", "DROPMALFORMED").json(path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows; columns that the table doesn't have yet are added to it (read it with mergeSchema)."""
    df.write.mode("append").parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def overwrite_runs(df: DataFrame, path: str) -> None:
    """Writes whole runs, partitioned by run: a repeated run replaces itself and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
