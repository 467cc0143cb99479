"""What earlier runs leave behind: answers with an age limit, links that worked, learned identifiers and trusted observations, as keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import norm_text, text_of
from larkspur.operators.history import replace_rows

# Signs of a store's page, age limits in days, and how many rows end a series of searches.
STORE_SIGNS = r"cdn\.shopify\.com|Shopify\.theme|shopify-section"
STORE_DAYS, TRUSTED_DAYS = 30, 365
ENOUGH_ROWS, STORE_PRODUCTS = 3, 3
DETAIL_CHARS = 160


def fresh(rows: DataFrame, now: Column, hours: float, ts: str = "ts") -> DataFrame:
    """Cached rows of `hours` or less; rows without a time are stale."""
    return rows.where((F.unix_timestamp(now) - F.unix_timestamp(ts)) <= hours * 3600)


def put(cache: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """cache with the rows of new in place of those with the same keys."""
    return replace_rows(cache, new, keys)


def age_days(searches: DataFrame, now: Column, keys: list[str]) -> DataFrame:
    """(keys, age_days) since the last search of each key."""
    return searches.groupBy(*keys).agg(((F.unix_timestamp(now) - F.unix_timestamp(F.max("ts"))) / 86400).alias("age_days"))


def discovery_state(attempts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, url, ok, ts): what is known of a site after all attempts (url, ok, ts): a failure clears the link, a success without one keeps the last."""
    w = Window.partitionBy(*keys).orderBy(*order)
    empty = F.coalesce("url", F.lit("")) == ""
    turn = F.sum(F.when(F.col("ok") & empty, 0).otherwise(1)).over(w)
    held = attempts.withColumn("_turn", turn)
    of = Window.partitionBy(*keys, "_turn").orderBy(*order)
    url = F.when(F.col("_turn") > 0, F.first(F.coalesce("url", F.lit(""))).over(of)).otherwise("")
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    out = held.withColumn("_url", url).withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return out.select(*keys, F.col("_url").alias("url"), "ok", "ts")


def known_links(state: DataFrame) -> DataFrame:
    """The sites of discovery_state whose link works."""
    return state.where(F.col("ok") & (F.coalesce("url", F.lit("")) != ""))


def is_store(api_products: Column, html: Column) -> Column:
    """Whether a site is a store of the known kind: its product list answered, else its page shows it; null where neither is known."""
    return F.when(api_products.isNotNull() & api_products, True).when(html.isNotNull(), html.rlike(STORE_SIGNS))


def store_verdicts(sites: DataFrame, cached: DataFrame, now: Column) -> DataFrame:
    """(host, is_store): of sites (host, api_products, html) by a cached verdict (host, is_store, ts) of STORE_DAYS or less, else as seen now."""
    known = fresh(cached, now, STORE_DAYS * 24).groupBy("host").agg(F.max_by("is_store", "ts").alias("_known"))
    return sites.join(known, "host", "left").select("host", F.coalesce("_known", is_store(F.col("api_products"), F.col("html"))).alias("is_store"))


def until_enough(rows: DataFrame, keys: list[str], query: str, enough: int = ENOUGH_ROWS) -> DataFrame:
    """Rows of the first queries (by number) of each key, as long as those before them gave less than `enough` rows."""
    counts = rows.groupBy(*keys, query).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(query).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = counts.withColumn("_before", before).where(F.col("_before") < enough).select(*keys, query)
    return rows.join(asked, [*keys, query], "left_semi")


def store_matches(rows: DataFrame, order: list[str], limit: int = STORE_PRODUCTS) -> DataFrame:
    """The products that a store's searches give an item: by code first, by name only where no code found any; each handle once, `limit` that match.

    rows: wid, host, query (0: GTIN, 1: code, 2: name), handle, matches, and others, which stay.
    """
    by = Window.partitionBy("wid", "host")
    first = F.min("query").over(by)
    found = rows.where(F.coalesce("handle", F.lit("")) != "").withColumn("_first", first).where(F.col("query") == F.col("_first")).drop("_first")
    once = Window.partitionBy("wid", "host", "handle").orderBy(*order)
    found = found.withColumn("_n", F.row_number().over(once)).where("_n = 1 and matches").drop("_n")
    return found.withColumn("rank", F.row_number().over(by.orderBy(*order))).where(F.col("rank") <= limit)


def first_payload(fresh_rows: DataFrame, cached: DataFrame, other: DataFrame, key: str = "handle") -> DataFrame:
    """(key, payload, how): what a product page gives now, else what is cached of it and unchanged, else its other form."""
    rows = [df.select(key, "payload", F.lit(i).alias("_i"), F.lit(how).alias("how")) for i, (df, how) in enumerate(((fresh_rows, "page"), (cached, "cached"), (other, "other form")))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).where("payload is not null").groupBy(key).agg(F.min_by("payload", "_i").alias("payload"), F.min_by("how", "_i").alias("how"))


def chosen_variant(rows: DataFrame, wanted: str = "wanted") -> DataFrame:
    """A product's rows of the wanted variant; all of them where there is none."""
    hit = (F.col("variant_id") == F.col(wanted)) & (F.coalesce(wanted, F.lit("")) != "")
    return rows.withColumn("_any", F.max(F.coalesce(hit, F.lit(False))).over(Window.partitionBy("wid", "handle"))).where(~F.col("_any") | hit).drop("_any")


# Learned identity


def learn(known: DataFrame, found: DataFrame) -> DataFrame:
    """known (wid, product, gtins, mpns, brand) with what validated pages report: found (wid, gtins, mpns, brand).

    A code must have a digit and four characters or more, and none that differs in case only counts twice; a known brand stays.
    """
    empty = F.array().cast("array<string>")
    seen = found.groupBy("wid").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("gtins", empty))))).alias("_g"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform(F.coalesce("mpns", empty), lambda m: F.trim(m)))))).alias("_m"), F.min(F.nullif("brand", F.lit(""))).alias("_b"),
    )
    k = known.join(seen, "wid", "left").withColumns({"_g": F.coalesce("_g", empty), "_m": F.coalesce("_m", empty), "mpns": F.coalesce("mpns", empty)})
    own = F.transform("mpns", lambda m: F.upper(m))
    new = F.filter("_m", lambda m: (F.length(m) >= 4) & m.rlike(r"\d") & ~F.array_contains(own, F.upper(m)))
    once = F.filter(new, lambda m, i: ~F.array_contains(F.slice(F.transform(new, lambda x: F.upper(x)), 1, i), F.upper(m)))
    gtins = F.array_sort(F.array_distinct(F.concat(F.coalesce("gtins", empty), F.filter("_g", lambda g: g != ""))))
    return k.select("wid", "product", gtins.alias("gtins"), F.array_sort(F.concat("mpns", once)).alias("mpns"), F.coalesce(F.nullif("brand", F.lit("")), "_b", F.lit("")).alias("brand"))


def learned_identity(items: DataFrame, known: DataFrame) -> DataFrame:
    """items (wid, product) with learned_gtins, learned_mpns and learned_brand; what was learned under another product name doesn't count."""
    empty = F.array().cast("array<string>")
    k = known.select("wid", norm_text(F.col("product")).alias("_name"), F.col("gtins").alias("_g"), F.col("mpns").alias("_m"), F.col("brand").alias("_b"))
    out = items.withColumn("_name", norm_text(F.col("product"))).join(k, ["wid", "_name"], "left")
    return out.select(*items.columns, F.coalesce("_g", empty).alias("learned_gtins"), F.coalesce("_m", empty).alias("learned_mpns"), F.coalesce("_b", F.lit("")).alias("learned_brand"))


def trusted_units(observations: DataFrame, now: Column, exclude_run: str = "", days: int = TRUSTED_DAYS) -> DataFrame:
    """(wid, ts, unit): trusted observations of new offers of the last `days`, but those of the present run; packs count by their unit price."""
    o = observations.where(F.col("trusted") & (F.coalesce("run", F.lit("")) != exclude_run) & (F.coalesce("condition", F.lit("new")) == "new") & (F.coalesce("unit", F.lit(0.0)) != 0))
    return o.where(F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS")).select("wid", "ts", "unit")


# Page records


def to_record(pages: DataFrame, key: str = "url") -> DataFrame:
    """(key, record): each extracted page as one JSON text, for reuse when the page hasn't changed."""
    return pages.select(key, F.to_json(F.struct(*[c for c in pages.columns if c != key])).alias("record"))


def from_record(records: DataFrame, like: DataFrame, key: str = "url") -> DataFrame:
    """The rows that to_record wrote, with the columns of `like`; records that can't be read give nulls."""
    kinds = dict(like.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in like.columns if c != key)
    return records.select(key, F.from_json(text_of(F.col("record")), ddl).alias("_r")).select(key, "_r.*")
