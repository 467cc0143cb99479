"""The operators over the driver's tables, each with the same result in SQL.

The tables have no offers, so their rows stand in for some: line items are
listings of parts (items), suppliers are vendors, events are observations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import ids, text, urls
from larkspur.operators import history, learning, medians, pricing, reconcile
from larkspur.sources import pages as P
from larkspur.streaming import attempts

#: Columns that tell listings apart; rows equal in all of them are equal.
ORDER = ["orderkey", "linenumber", "suppkey", "quantity", "extended"]
NOW = "TIMESTAMP '2024-01-31 00:00:00'"

LISTINGS_SQL = """listings AS (
  SELECT *, floor(effective_price / pack_qty * 100 + 0.5000001) / 100 AS unit_price FROM (
    SELECT *, floor((price + coalesce(shipping, 0)) * 100 + 0.5000001) / 100 AS effective_price FROM (
      SELECT l_partkey AS wid, l_orderkey AS orderkey, l_linenumber AS linenumber, l_suppkey AS suppkey, l_quantity AS quantity, l_extendedprice AS extended,
        1 + l_linenumber % 3 AS pack_qty, floor(l_extendedprice / l_quantity * (1 + l_linenumber % 3) * 100 + 0.5000001) / 100 AS price,
        CASE WHEN l_tax < 0.05 THEN 100 * l_tax END AS shipping, CASE l_returnflag WHEN 'R' THEN 'used' ELSE 'new' END AS condition,
        CASE WHEN l_linestatus = 'O' THEN true WHEN l_tax < 0.04 THEN false END AS in_stock,
        CASE l_orderkey % 3 WHEN 0 THEN 'verified_direct' WHEN 1 THEN 'verified_discovered' ELSE 'market_snapshot' END AS evidence,
        CASE WHEN l_discount < 0.06 THEN 'High' WHEN l_discount < 0.09 THEN 'Medium' ELSE 'Low' END AS confidence,
        CASE WHEN l_tax > 0.075 THEN 'coupon' END AS conditional, l_suppkey % 3 = 0 AS is_primary, l_returnflag = 'R' AS is_resale, l_suppkey % 7 = 0 AS is_direct,
        l_suppkey % 11 = 0 AS from_url, CASE WHEN l_suppkey % 4 = 0 THEN floor(l_extendedprice / l_quantity * (1 + l_linenumber % 3) * 110 + 0.5000001) / 100 END AS regular_price,
        CASE l_returnflag WHEN 'A' THEN 'gtin' ELSE 'title' END AS match_evidence, 'v' || l_suppkey AS vkey, l_shipdate AS dt
      FROM lineitem)) ), items AS (
  SELECT p_partkey AS wid, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN [1] ELSE [1, p_size % 4] END AS packs, CASE WHEN p_size % 5 = 0 THEN p_retailprice * 3 END AS target, p_size % 3 > 0 AS open_used FROM part), scored AS (
  SELECT *, ok AND conditional IS NULL AS eligible, ok AND conditional IS NOT NULL AS cond_ok, ok AND conditional IS NULL AND coalesce(in_stock, true) AND (open_used OR (is_primary AND NOT is_resale)) AS reportable FROM (
    SELECT *, confidence IN ('High', 'Medium') AND NOT (in_stock IS NOT NULL AND NOT in_stock AND NOT (evidence LIKE 'verified%' AND NOT is_resale)) AND (packs IS NULL OR list_contains(packs, pack_qty))
      AND (target IS NULL OR from_url OR unit_price >= target * 0.35) AND (open_used OR NOT is_resale) AS ok FROM listings JOIN items USING (wid)) ), trusted AS (
  SELECT * FROM scored WHERE eligible AND evidence LIKE 'verified%' AND confidence = 'High' AND condition = 'new' AND NOT is_resale AND conditional IS NULL )"""
SERIES_SQL = "series AS (SELECT user_id AS wid, ts AS dt, max(value) AS v, bool_or(event_type <> 'error') AS in_stock FROM events WHERE value > 0 GROUP BY user_id, ts)"
MONEY = "floor({} * 100 + 0.5000001) / 100"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as listings of any item that is open to used offers."""
    l = table(spark, sf, "lineitem")
    tax, vendor = F.col("l_tax"), F.col("l_suppkey")
    pack = (1 + F.col("l_linenumber") % 3).cast("int")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    rows = l.select(
        F.col("l_partkey").alias("wid"), F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), vendor.alias("suppkey"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extended"),
        pack.alias("pack_qty"), text.money(unit * pack).alias("price"), F.when(tax < 0.05, 100 * tax).alias("shipping"), F.when(F.col("l_returnflag") == "R", "used").otherwise("new").alias("condition"),
        F.when(F.col("l_linestatus") == "O", True).when(tax < 0.04, False).alias("in_stock"),
        F.when(F.col("l_orderkey") % 3 == 0, "verified_direct").when(F.col("l_orderkey") % 3 == 1, "verified_discovered").otherwise("market_snapshot").alias("evidence"),
        F.when(F.col("l_discount") < 0.06, "High").when(F.col("l_discount") < 0.09, "Medium").otherwise("Low").alias("confidence"), F.when(tax > 0.075, "coupon").alias("conditional"),
        (vendor % 3 == 0).alias("is_primary"), (F.col("l_returnflag") == "R").alias("is_resale"), (vendor % 7 == 0).alias("is_direct"), (vendor % 11 == 0).alias("from_url"),
        F.when(vendor % 4 == 0, F.floor(unit * pack * 110 + 0.5000001) / 100).alias("regular_price"), F.when(F.col("l_returnflag") == "A", "gtin").otherwise("title").alias("match_evidence"),
        F.concat(F.lit("v"), vendor.cast("string")).alias("vkey"), F.col("l_shipdate").alias("dt"),
    )
    return pricing.normalize_prices(rows)


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as items: some sell singles only, some have a target price, some are open to used offers."""
    kind = F.col("p_size") % 4
    packs = F.when(kind == 1, F.array(F.lit(1))).when(kind > 1, F.array(F.lit(1), kind.cast("int")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("wid"), packs.alias("packs"), F.when(F.col("p_size") % 5 == 0, F.col("p_retailprice") * 3).alias("target"), (F.col("p_size") % 3 > 0).alias("open_used"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return pricing.score_eligibility(listings(spark, sf), items(spark, sf))


def series(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("value > 0")
    return e.groupBy(F.col("user_id").alias("wid"), F.col("ts").alias("dt")).agg(F.max("value").alias("v"), F.bool_or(F.col("event_type") != "error").alias("in_stock"))


def now() -> Column:
    return F.expr(NOW)


# Prices and pools


def unit_price(spark, sf):
    return listings(spark, sf).select(*ORDER, "effective_price", "unit_price", "availability")


def baseline(spark, sf):
    return pricing.verified_baseline(scored(spark, sf))


def packs(spark, sf):
    return pricing.pack_baselines(scored(spark, sf))


def trimmed(spark, sf):
    return pricing.trimmed_mean(listings(spark, sf), ["wid"], "unit_price")


def market(spark, sf):
    return pricing.market_stats(scored(spark, sf))


def consensus(spark, sf):
    return pricing.regular_consensus(scored(spark, sf))


def _history(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("wid"), F.col("p_retailprice").alias("median"), (F.col("p_retailprice") + 1).alias("ewma"))


def reference(spark, sf):
    return pricing.reference_price(scored(spark, sf), _history(spark, sf), ORDER)


def band(spark, sf):
    out = pricing.apply_band(scored(spark, sf), pricing.verified_baseline(scored(spark, sf)).select("wid", F.col("baseline").alias("anchor")))
    return out.groupBy("wid").agg(F.count_if("in_band").alias("inside"), F.count_if("eligible").alias("eligible"), F.count_if("reportable").alias("reportable"))


def deal_facts(spark, sf):
    s, stats = scored(spark, sf), pricing.market_stats(scored(spark, sf))
    wide = stats.groupBy("wid").agg(*[F.max(F.when(F.col("is_resale") == resale, F.col(c))).alias(f"{side}_{c}") for side, resale in (("new", False), ("res", True)) for c in ("avg", "n")])
    maps = pricing.pack_baselines(s).groupBy("wid").agg(F.map_from_entries(F.collect_list(F.struct("pack_qty", "pack_price"))).alias("packs"))  # one entry a pack size
    hist = _history(spark, sf).select("wid", "median", F.lit(5).alias("median_n"), (F.col("median") * 0.8).alias("low"), (F.col("median") * 0.7).alias("trend"))
    facts = pricing.reference_price(s, _history(spark, sf), ORDER).drop("ref_type").join(pricing.verified_baseline(s).drop("n"), "wid", "left")
    return facts.join(wide, "wid", "left").join(maps, "wid", "left").join(hist, "wid", "left").join(items(spark, sf).drop("packs"), "wid", "left")


def deals(spark, sf):
    found = pricing.find_deals(scored(spark, sf), deal_facts(spark, sf), ORDER, target_rule=True)
    return found.select("wid", "rank", *ORDER, "unit_price", "ref", F.array_join("reasons", "; ").alias("reasons"))


def used_primary(spark, sf):
    refs = table(spark, sf, "part").select(F.col("p_partkey").alias("wid"), (F.col("p_retailprice") * 3).alias("new_ref"))
    return pricing.used_primary_offers(scored(spark, sf), refs, ORDER).select("wid", "rank", "unit_price", F.floor(F.col("saving") * 10000 + 0.5).cast("long").alias("saving"))


def plan_need(spark, sf):
    """A plan that covers three units, from packs of one to three, resale offers once each."""
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("wid"), F.lit(3).alias("qty_needed"))
    return pricing.quantity_plan(scored(spark, sf), items, ORDER)


# Duplicates and agreement


def dedupe(spark, sf):
    s = scored(spark, sf).withColumn("source", F.concat(F.lit("s"), (F.col("orderkey") % 4).cast("string")))
    s = s.select("wid", "suppkey", "condition", "pack_qty", "orderkey", "linenumber", "quantity", "extended", "unit_price", "source", "evidence", "confidence", "in_stock", "from_url")  # whole rows are exchanged
    merged = reconcile.merge_duplicates(s, ["wid", "suppkey", "condition", "pack_qty"], ["orderkey", "linenumber", "quantity", "extended"])
    return merged.select("wid", "suppkey", "condition", "pack_qty", "orderkey", "unit_price", F.array_join("corroborated_by", ",").alias("corroborated_by"))


def twins(spark, sf):
    stay, gone = reconcile.merge_twins(scored(spark, sf), ["wid", "condition", "pack_qty"], ORDER)
    return gone.groupBy("note").agg(F.count(F.lit(1)).alias("n")).unionByName(stay.select(F.lit("stay").alias("note")).groupBy("note").agg(F.count(F.lit(1)).alias("n")))


TITLES = ["Steel widget with long handle, pack of 2", "Ceramic planter for balcony"]


def promotion(spark, sf):
    """Medium offers by why they are promoted; titles are one of two that don't resemble each other, codes come from item and vendor."""
    s = scored(spark, sf)
    code = F.concat_ws("-", F.lit("C"), "wid", F.col("suppkey") % 5)
    s = s.withColumns({
        "title": F.when(F.col("suppkey") % 2 == 0, TITLES[0]).otherwise(TITLES[1]), "mpns": F.when(F.col("linenumber") % 2 == 0, F.array(code)),
        "gtins": F.when(F.col("linenumber") == 3, F.array(F.concat(F.lit("0"), (F.col("suppkey") % 3).cast("string")))),
    })
    return reconcile.promote(s, ORDER).where("promoted is not null").groupBy("wid", F.col("promoted").alias("why")).agg(F.count(F.lit(1)).alias("n"))


def identifier_overlap(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("wid"), F.col("p_brand"), F.array(F.concat_ws("-", "p_type", "p_size"), F.concat_ws("-", "p_brand", "p_size")).alias("codes"))
    return reconcile.share_identifier(p.where("p_brand < 'Brand#13'"), p.where("p_brand >= 'Brand#13'"), "wid", "codes")


def vendor_match(spark, sf):
    c = table(spark, sf, "customer").select(text.vendor_key(F.concat(F.lit("The "), "c_mktsegment", F.lit(".com - seller"))).alias("vkey"))
    v = table(spark, sf, "customer").select(text.vendor_key(F.substring("c_mktsegment", 1, 5)).alias("vendor_key")).unionByName(c.select(F.col("vkey").alias("vendor_key")))
    return reconcile.match_vendors(c, v)


def fingerprints(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", ids.fingerprint(F.col("p_brand"), F.col("p_name"), F.lit(None).cast("string"), F.col("p_size")).alias("fingerprint"))


# History


def prior_price(spark, sf):
    return history.running(series(spark, sf), ["dt", "v"]).select("wid", "dt", "v", "prior", F.coalesce("material", F.lit(False)).alias("material"), F.coalesce("new_low", F.lit(False)).alias("new_low"), F.col("low_before"))


def trailing(spark, sf):
    return history.trailing_median(series(spark, sf), 7).select("wid", "dt", "median", "n")


def group_medians(spark, sf):
    """Few keys of very many rows each."""
    return medians.group_medians(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice").withColumnRenamed("median", "middle")


def averages(spark, sf):
    s = history.moving_average(series(spark, sf), ["dt", "v"])
    return s.select("wid", "dt", "v", text.money(F.col("ewma")).alias("ewma"))


def trusted_low(spark, sf):
    """Lows of users' values with those of errors, which are no series, as trusted units of the next user."""
    unit = table(spark, sf, "events").where("event_type = 'error'").select((F.col("user_id") + 1).alias("wid"), F.col("value").alias("unit"))
    return history.with_trusted_low(history.history_stats(series(spark, sf), now()), unit).select("wid", "prior", "median_n", "low")


def stats(spark, sf):
    return history.history_stats(series(spark, sf), now())


def events(spark, sf):
    return history.price_events(series(spark, sf), ["dt", "v"]).select("wid", "dt", "v", "event", "since")


def streak(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("wid"), "ts", "event_id", "event_type")
    return history.flag_streak(e, F.col("event_type") != "error", ["ts", "event_id"])


def trend(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("wid"), F.col("ts").alias("dt"), F.col("value").alias("avg"), F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k").cast("int")).alias("n"))
    return history.resale_trend(rows, now(), 14)


def cadence(spark, sf):
    items = table(spark, sf, "customer").select(F.col("c_custkey").alias("wid"))
    runs = table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("wid"), F.col("ts").alias("dt"))
    return history.due_items(items, runs, now(), 3)


def upsert(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    old, new = o.where("o_orderpriority <> '1-URGENT'"), o.where("o_orderpriority in ('1-URGENT', '2-HIGH')")
    out = history.replace_rows(old, new, ["o_custkey", "o_orderpriority"])
    return out.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


def retention(spark, sf):
    return history.retain(table(spark, sf, "events"), "ts", now(), 10).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest"))


def newest_rows(spark, sf):
    return history.newest(table(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], 4)


# Learning


def _attempts(spark, sf):
    e = table(spark, sf, "events")
    outcome = F.when(F.col("event_type") == "error", "blocked").when(F.col("event_type") == "view", "no_match").when(F.col("event_type") == "signup", "skipped").otherwise("success")
    return e.select(F.concat(F.lit("d"), (F.col("user_id") % 40).cast("string")).alias("domain"), F.col("user_id").alias("wid"), F.date_format("ts", "yyyy-MM-dd").alias("run"), outcome.alias("outcome"), F.get_json_object("props", "$.k").cast("int").alias("k"), "ts").withColumn("n_listings", F.col("k") % 2)


def yields(spark, sf):
    return learning.skips(learning.retailer_yield(_attempts(spark, sf)), now(), 5, 2, 30)


def lifetime_yield(spark, sf):
    """Attempts in two batches, the second of later days."""
    a, split = _attempts(spark, sf), F.lit("2024-01-16")
    state = spark.createDataFrame([], attempts.LOG), spark.createDataFrame([], attempts.TOTALS)
    for batch in (a.where(F.col("run") < split), a.where(F.col("run") >= split)):
        state = attempts.merge_attempts(*state, batch)
    return state[1]


def candidates(spark, sf):
    s = scored(spark, sf).join(_history(spark, sf).select("wid", F.col("median").alias("ref")), "wid", "left").where("eligible and not is_resale")
    rows = s.select("vkey", "wid", (F.col("orderkey") % 10).alias("run"), "confidence", F.col("unit_price").alias("unit"), "ref", F.startswith("evidence", F.lit("verified")).alias("is_verified"))
    return learning.vendor_candidates(rows, 20, 10, 4, 0.9)


def best_of_vendor(spark, sf):
    s = scored(spark, sf).where("eligible").withColumn("is_verified", F.startswith("evidence", F.lit("verified")))
    return learning.best_of_vendor(s.select("wid", "vkey", "confidence", "is_verified", "unit_price", *ORDER), ORDER).select("wid", "vkey", "confidence", "is_verified", "unit_price")


def outcomes(spark, sf):
    return learning.outcome_summary(_attempts(spark, sf).select("outcome", F.col("domain").alias("target")))


def evidence_mix(spark, sf):
    s = listings(spark, sf)
    n = [F.count_if(F.col("evidence") == e).cast("string") for e in reconcile.EVIDENCE_RANK]
    return s.groupBy("wid").agg(F.count(F.lit(1)).alias("listings"), F.count_distinct("vkey").alias("vendors"), F.concat_ws("/", *n).alias("mix"), F.min(F.when(F.col("confidence") == "High", F.col("unit_price"))).alias("lowest"))


def words_missing(spark, sf):
    p = table(spark, sf, "part")
    items = p.select((F.col("p_partkey") % 500).alias("wid"), F.concat_ws(" ", "p_name", "p_type").alias("product"))
    titles = p.select((F.col("p_partkey") % 500).alias("wid"), F.col("p_name").alias("title"))
    return learning.missing_words(items, titles)


def snapshots(spark, sf):
    s = scored(spark, sf).where("evidence = 'market_snapshot' and eligible")
    return learning.cheapest_snapshots(s.select("wid", "vkey", "unit_price", *ORDER), 2, ORDER).select("wid", "vkey", "unit_price", "rank")


# Text, URLs and pages


def titles(spark, sf):
    p = table(spark, sf, "part")
    title = F.concat(F.lit('The NEW 4" '), "p_name", F.lit(" 2nd Gen wi-fi, pack of "), (F.col("p_size") % 5 + 1).cast("string"), F.lit(" - $"), F.col("p_retailprice").cast("decimal(10,2)").cast("string"))
    return p.select("p_partkey", text.norm_text(title).alias("normal"), text.pack_qty(title).alias("pack_qty"), text.parse_price(F.split_part(title, F.lit("$"), F.lit(2))).alias("price"), F.array_join(text.colors(F.col("p_name")), ",").alias("colors"))


def conditions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    title = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, " open-box").when(F.col("doc_id") % 5 == 1, " Renewed").when(F.col("doc_id") % 5 == 2, " for parts").otherwise(""))
    return d.select("doc_id", text.condition(title, F.lit(None).cast("string")).alias("condition"), text.shipping_of(F.concat(F.lit("$"), (F.col("doc_id") % 9).cast("string"), F.lit(".50 shipping"))).alias("shipping"))


def vendors(spark, sf):
    s = table(spark, sf, "supplier")
    name = F.concat(F.lit("From The "), F.regexp_replace("s_name", "#0*", " & "), F.lit(" Store, Inc"))
    return s.select("s_suppkey", text.vendor_key(name).alias("vkey"), text.vendor_key(F.concat(F.lit("https://shop"), F.col("s_suppkey").cast("string"), F.lit(".example.com/x"))).alias("url_key"))


def gtins(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919 + 400000000000).cast("string"), 12, "0").alias("digits"))
    return o.select("o_orderkey", ids.gtin_valid(F.col("digits")).alias("valid"), ids.normalize_gtin(F.col("digits")).alias("gtin"))


def page_urls(spark, sf):
    p = table(spark, sf, "pages")
    u = F.col("url")
    return p.select("page_id", urls.normalize_url(u).alias("canonical"), urls.host_of(u).alias("host"), urls.is_listing_page(u).alias("listing"), urls.us_locale_ok(u).alias("locale_ok"), urls.merchant_item_id(F.concat(u, F.lit("&sku=AB12"))).alias("item"))


def page_links(spark, sf):
    return P.links(table(spark, sf, "pages")).select("url", "link", "position")


def page_facts(spark, sf):
    p = table(spark, sf, "pages")
    h = F.col("html")
    return p.select("page_id", P.page_title(h).alias("title"), P.looks_blocked(h).alias("blocked"), P.looks_like_shell(h).alias("shell"), P.outcome(F.when(F.col("page_id") % 9 == 0, 404).otherwise(200), h).alias("outcome"))


def event_props(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count_if(F.get_json_object("props", "$.k").cast("int") > 50).alias("large"), F.sum(F.get_json_object("props", "$.k").cast("int")).alias("total"))


def sorted_top(spark, sf):
    w = Window.partitionBy("wid").orderBy("unit_price", *ORDER)
    return scored(spark, sf).where("reportable").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("wid", "rank", "unit_price")


def _first_of(c: str, pools: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN count(*) FILTER ({p}) > 0 THEN {c.format(p)}" for p in pools) + " END"


_POOLS = ["WHERE coalesce(in_stock, true) AND pack_qty = 1", "WHERE pack_qty = 1", "WHERE coalesce(in_stock, true)", "WHERE true"]
_TRIM = """{name} AS (SELECT {keys}, floor(CAST(sum(CAST({v} AS DECIMAL(18, 2))) AS DOUBLE) / count(*) * 100 + 0.5000001) / 100 AS avg, count(*) AS n, floor(min(m) * 0.4 * 100 + 0.5000001) / 100 AS lo
  FROM (SELECT *, median({v}) OVER (PARTITION BY {keys}) AS m FROM {source}) WHERE {v} BETWEEN m * 0.4 AND m * 2.5 GROUP BY {keys})"""
_BASELINE = f"baseline AS (SELECT wid, {MONEY.format(_first_of('median(unit_price) FILTER ({})', _POOLS))} AS baseline, {_first_of('count(*) FILTER ({})', _POOLS)} AS n FROM trusted GROUP BY wid)"
_PACKS = """packs AS (SELECT wid, pack_qty, floor(median(unit_price) * 100 + 0.5000001) / 100 AS pack_price
  FROM (SELECT *, count(*) FILTER (WHERE coalesce(in_stock, true)) OVER (PARTITION BY wid) AS stocked FROM trusted) WHERE stocked = 0 OR coalesce(in_stock, true) GROUP BY wid, pack_qty)"""
_REGS = """regs AS (SELECT wid, floor(regular_price / pack_qty * 100 + 0.5000001) / 100 AS reg FROM scored WHERE confidence = 'High' AND condition = 'new' AND NOT is_resale AND regular_price > 0),
consensus AS (SELECT wid, floor(median(reg) * 100 + 0.5000001) / 100 AS consensus, count(*) AS n FROM (SELECT *, median(reg) OVER (PARTITION BY wid) AS m FROM regs) WHERE abs(reg - m) / m <= 0.05 GROUP BY wid HAVING count(*) >= 2)"""
_HISTORY = "hist AS (SELECT p_partkey AS wid, p_retailprice AS median, p_retailprice + 1 AS ewma FROM part)"
_ORDER = ", ".join(ORDER)
_REFERENCE = f"""ver AS (SELECT *, row(pack_qty <> 1, NOT is_direct, NOT from_url, {_ORDER}) AS r, floor(regular_price / pack_qty * 100 + 0.5000001) / 100 AS reg
  FROM scored WHERE evidence LIKE 'verified%' AND confidence = 'High' AND condition = 'new' AND NOT is_resale AND (eligible OR cond_ok)),
found AS (SELECT wid, arg_min(reg, r) FILTER (WHERE reg > 0) AS published, arg_min(price, r) FILTER (WHERE is_direct AND pack_qty = 1) AS direct,
  floor(median(unit_price) FILTER (WHERE pack_qty = 1 AND eligible) * 100 + 0.5000001) / 100 AS current FROM ver GROUP BY wid),
reference AS (SELECT wid, coalesce(published, direct, consensus, median, ewma, current) AS ref_price,
  CASE WHEN published > 0 OR direct > 0 THEN 'msrp_regular' WHEN consensus > 0 THEN 'regular_consensus' WHEN median > 0 OR ewma > 0 THEN 'historical_verified' WHEN current > 0 THEN 'verified_current' ELSE 'none' END AS ref_type
  FROM (SELECT DISTINCT wid FROM scored) LEFT JOIN found USING (wid) LEFT JOIN consensus USING (wid) LEFT JOIN hist USING (wid))"""
_MARKET = _TRIM.format(name="market", keys="wid, is_resale", v="unit_price", source="(SELECT * FROM scored WHERE eligible AND confidence = 'High')")
_ATTEMPTS = """attempts AS (SELECT 'd' || (user_id % 40) AS domain, user_id AS wid, strftime(ts, '%Y-%m-%d') AS run, ts, CAST(props->>'$.k' AS INTEGER) % 2 AS n_listings,
  CASE event_type WHEN 'error' THEN 'blocked' WHEN 'view' THEN 'no_match' WHEN 'signup' THEN 'skipped' ELSE 'success' END AS outcome FROM events)"""

QUERIES: dict[str, tuple] = {
    "unit_price": (unit_price, f"WITH {LISTINGS_SQL} SELECT {_ORDER}, effective_price, unit_price, CASE WHEN in_stock IS NULL THEN 'unknown' WHEN in_stock THEN 'in_stock' ELSE 'out_of_stock' END AS availability FROM listings"),
    "verified_baseline": (baseline, f"WITH {LISTINGS_SQL}, {_BASELINE} SELECT * FROM baseline"),
    "pack_baselines": (packs, f"WITH {LISTINGS_SQL}, {_PACKS} SELECT * FROM packs"),
    "trimmed_mean": (trimmed, f"WITH {LISTINGS_SQL}, {_TRIM.format(name='t', keys='wid', v='unit_price', source='listings')} SELECT * FROM t"),
    "market_stats": (market, f"WITH {LISTINGS_SQL}, {_MARKET} SELECT * FROM market"),
    "regular_consensus": (consensus, f"WITH {LISTINGS_SQL}, {_REGS} SELECT * FROM consensus"),
    "reference_price": (reference, f"WITH {LISTINGS_SQL}, {_REGS}, {_HISTORY}, {_REFERENCE} SELECT * FROM reference"),
    "price_band": (band, f"""WITH {LISTINGS_SQL}, {_BASELINE}, b AS (SELECT *, (from_url AND evidence LIKE 'verified%') OR baseline IS NULL OR baseline <= 0 OR
        unit_price BETWEEN baseline * CASE WHEN is_resale THEN 0.30 ELSE 0.60 END AND baseline * CASE WHEN is_resale THEN 1.05 ELSE 1.40 END AS inside FROM scored LEFT JOIN (SELECT wid, baseline FROM baseline) USING (wid))
      SELECT wid, count(*) FILTER (WHERE inside) AS inside, count(*) FILTER (WHERE inside AND eligible) AS eligible, count(*) FILTER (WHERE inside AND reportable) AS reportable FROM b GROUP BY wid"""),
    "find_deals": (deals, f"""WITH {LISTINGS_SQL}, {_BASELINE}, {_PACKS}, {_REGS}, {_HISTORY}, {_REFERENCE}, {_MARKET}, facts AS (
        SELECT s.*, r.ref_price, b.baseline, p.pack_price, n.avg AS new_avg, n.n AS new_n, u.avg AS res_avg, u.n AS res_n, h.median, h.median * 0.8 AS low, h.median * 0.7 AS trend FROM scored s
        LEFT JOIN reference r USING (wid) LEFT JOIN baseline b USING (wid) LEFT JOIN packs p ON p.wid = s.wid AND p.pack_qty = s.pack_qty LEFT JOIN hist h ON h.wid = s.wid
        LEFT JOIN market n ON n.wid = s.wid AND NOT n.is_resale LEFT JOIN market u ON u.wid = s.wid AND u.is_resale
        WHERE confidence = 'High' AND coalesce(in_stock, true) AND (reportable OR (cond_ok AND (open_used OR (is_primary AND NOT s.is_resale))))
      ), refs AS (SELECT *, CASE WHEN is_resale THEN CASE WHEN res_n >= 3 THEN res_avg END ELSE coalesce(CASE WHEN pack_qty > 1 THEN pack_price END, ref_price, baseline, CASE WHEN new_n >= 3 THEN new_avg END) END AS ref FROM facts
      ), sane AS (SELECT *, coalesce(unit_price >= ref * 0.4, true) AS sane, CASE WHEN is_resale THEN trend ELSE median END AS t FROM refs
      ), reasons AS (SELECT *, list_filter([CASE WHEN is_resale AND ref IS NULL AND unit_price <= ref_price * (1 - 0.35) THEN 'far below new' END, CASE WHEN ref > 0 AND sane AND unit_price <= ref * (1 - 0.15) THEN 'below reference' END,
        CASE WHEN t > 0 AND sane AND unit_price < t THEN 'below trend' END, CASE WHEN NOT is_resale AND low > 0 AND sane AND unit_price <= low - 0.01 THEN 'new verified low' END,
        CASE WHEN unit_price <= target * (1 - 0.15) THEN 'below target' END], lambda x: x IS NOT NULL) AS rs FROM sane
      ), ranked AS (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY conditional IS NOT NULL, evidence NOT LIKE 'verified%', CASE WHEN is_primary AND NOT is_resale THEN 0 WHEN NOT is_resale THEN 1 ELSE 2 END, unit_price, {_ORDER}) AS rank FROM reasons WHERE len(rs) > 0)
      SELECT wid, rank, {_ORDER}, unit_price, ref, array_to_string(rs, '; ') AS reasons FROM ranked WHERE rank <= 5"""),
    "used_primary_offers": (used_primary, f"""WITH {LISTINGS_SQL}, s AS (SELECT *, (p_retailprice * 3 - unit_price) / (p_retailprice * 3) AS saving FROM scored JOIN part ON p_partkey = wid
        WHERE condition = 'used' AND is_primary AND evidence LIKE 'verified%' AND confidence = 'High' AND coalesce(in_stock, true) AND reportable AND pack_qty = 1)
      SELECT wid, rank, unit_price, CAST(floor(saving * 10000 + 0.5) AS BIGINT) AS saving FROM (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY unit_price, {_ORDER}) AS rank FROM s WHERE saving >= 0.05) WHERE rank <= 3"""),
    "quantity_plan": (plan_need, f"""WITH {LISTINGS_SQL}, l AS (SELECT *, is_resale OR condition <> 'new' AS once, CAST(evidence NOT LIKE 'verified%' AS INTEGER) AS u FROM scored WHERE reportable AND confidence = 'High' AND effective_price > 0),
      o AS (SELECT wid, pack_qty AS p, effective_price AS e, u, once, row_number() OVER (PARTITION BY wid) AS i FROM (
        FROM l WHERE NOT once QUALIFY row_number() OVER (PARTITION BY wid, pack_qty ORDER BY effective_price, u, NOT is_primary, {_ORDER}) = 1
        UNION ALL FROM l WHERE once QUALIFY row_number() OVER (PARTITION BY wid ORDER BY unit_price, {_ORDER}) <= {pricing.ONE_OFF_LIMIT})),
      two AS (SELECT a.wid, round(a.e + b.e, 2) AS e, a.u + b.u AS u, a.p + b.p AS p, b.i, b.once FROM o a JOIN o b ON a.wid = b.wid AND (a.i < b.i OR (a.i = b.i AND NOT a.once))),
      three AS (SELECT a.wid, round(a.e + b.e, 2) AS e, a.u + b.u AS u, a.p + b.p AS p FROM two a JOIN o b ON a.wid = b.wid AND (a.i < b.i OR (a.i = b.i AND NOT a.once))),
      best AS (SELECT wid, min(row(e, u, p)) AS x FROM (SELECT wid, e, u, p FROM o UNION ALL SELECT wid, e, u, p FROM two UNION ALL FROM three) WHERE p >= 3 GROUP BY wid)
      SELECT wid, 3 AS need, x[1] AS total, CAST(x[2] AS INTEGER) AS unverified, CAST(x[3] AS INTEGER) AS units FROM best"""),
    "dedupe_authority": (dedupe, f"""WITH {LISTINGS_SQL}, s AS (SELECT *, 's' || (orderkey % 4) || '/' || evidence AS seen, row_number() OVER (PARTITION BY wid, suppkey, condition, pack_qty ORDER BY NOT from_url,
        CASE evidence WHEN 'verified_direct' THEN 0 WHEN 'verified_discovered' THEN 1 ELSE 2 END, CASE confidence WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, in_stock IS NULL, orderkey, linenumber, quantity, extended) AS n FROM scored),
      g AS (SELECT wid, suppkey, condition, pack_qty, arg_min(orderkey, n) AS orderkey, arg_min(unit_price, n) AS unit_price, arg_min(seen, n) AS own, list_sort(list(DISTINCT seen)) AS others FROM s GROUP BY ALL)
      SELECT wid, suppkey, condition, pack_qty, orderkey, unit_price, array_to_string([x FOR x IN others IF x <> own], ',') AS corroborated_by FROM g"""),
    "twin_merge": (twins, f"""WITH {LISTINGS_SQL}, v AS (SELECT *, row(NOT from_url, CASE evidence WHEN 'verified_direct' THEN 0 ELSE 1 END, CASE confidence WHEN 'High' THEN 0 ELSE 1 END, in_stock IS NULL, {_ORDER}) AS r FROM scored WHERE evidence LIKE 'verified%' AND confidence <> 'Low'),
      m AS (SELECT s.wid, s.condition, s.pack_qty, s.vkey, {", ".join(f"s.{c}" for c in ORDER)}, s.unit_price, arg_min(v.unit_price, v.r) AS vp FROM scored s JOIN v ON v.wid = s.wid AND v.condition = s.condition AND v.pack_qty = s.pack_qty
        AND (s.vkey = v.vkey OR (least(length(s.vkey), length(v.vkey)) >= 4 AND (starts_with(s.vkey, v.vkey) OR starts_with(v.vkey, s.vkey)))) WHERE s.evidence = 'market_snapshot' AND s.confidence <> 'Low' GROUP BY ALL)
      SELECT CASE WHEN abs(unit_price - vp) / vp > 0.02 THEN 'stale' ELSE 'agrees' END AS note, count(*) AS n FROM m GROUP BY 1
      UNION ALL SELECT 'stay', count(*) FROM scored s LEFT JOIN (SELECT *, true AS gone FROM m) g ON {" AND ".join(f"g.{c} = s.{c}" for c in ["wid", "condition", "pack_qty", "vkey", *ORDER, "unit_price"])} AND s.evidence = 'market_snapshot' AND s.confidence <> 'Low' WHERE gone IS NULL"""),
    "promotion_band": (promotion, f"""WITH {LISTINGS_SQL}, o AS (SELECT *, suppkey % 2 AS title, list_concat(CASE WHEN linenumber % 2 = 0 THEN ['C' || wid || (suppkey % 5)] ELSE [] END, CASE WHEN linenumber = 3 THEN ['0' || (suppkey % 3)] ELSE [] END) AS codes FROM scored WHERE conditional IS NULL),
      h AS (SELECT * FROM o WHERE confidence = 'High' AND condition = 'new'), p AS (
        SELECT m.wid, {", ".join(f"m.{c}" for c in ORDER)}, min(CASE WHEN m.match_evidence = 'gtin' AND h.pack_qty = m.pack_qty AND abs(m.unit_price - h.unit_price) / h.unit_price <= 0.15 THEN 'a identifier'
          WHEN m.match_evidence <> 'gtin' AND h.pack_qty = m.pack_qty AND abs(m.unit_price - h.unit_price) / h.unit_price <= 0.15 AND h.evidence LIKE 'verified%' AND h.title = m.title THEN 'b title'
          WHEN m.evidence LIKE 'verified%' AND len(list_intersect(m.codes, h.codes)) > 0 THEN 'c shared code' END) AS why
        FROM o m JOIN h ON h.wid = m.wid AND (h.evidence <> m.evidence OR NOT (h.vkey = m.vkey OR (least(length(h.vkey), length(m.vkey)) >= 4 AND (starts_with(h.vkey, m.vkey) OR starts_with(m.vkey, h.vkey)))))
        WHERE m.confidence = 'Medium' GROUP BY ALL)
      SELECT wid, substr(why, 3) AS why, count(*) AS n FROM p WHERE why IS NOT NULL GROUP BY ALL"""),
    "identifier_overlap": (identifier_overlap, """WITH c AS (SELECT p_partkey AS wid, p_brand, unnest([p_type || '-' || p_size, p_brand || '-' || p_size]) AS code FROM part)
      SELECT DISTINCT a.wid AS left_wid, b.wid AS right_wid FROM c a JOIN c b ON a.code = b.code WHERE a.p_brand < 'Brand#13' AND b.p_brand >= 'Brand#13'"""),
    "keys_match_join": (vendor_match, """WITH c AS (SELECT DISTINCT lower(c_mktsegment) AS vkey FROM customer), v AS (SELECT vkey AS vendor_key FROM c UNION SELECT lower(substr(c_mktsegment, 1, 5)) FROM customer)
      SELECT vkey, vendor_key FROM c, v WHERE vkey = vendor_key OR (least(length(vkey), length(vendor_key)) >= 4 AND (starts_with(vkey, vendor_key) OR starts_with(vendor_key, vkey)))"""),
    "fingerprint_sha1": (fingerprints, "SELECT p_partkey, substr(sha1(coalesce(p_brand, '') || '|' || coalesce(p_name, '') || '||' || coalesce(CAST(p_size AS VARCHAR), '')), 1, 12) AS fingerprint FROM part"),
    "prior_price": (prior_price, f"""WITH {SERIES_SQL}, w AS (SELECT *, lag(v) OVER o AS prior, min(v) OVER (PARTITION BY wid ORDER BY dt, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low_before FROM series WINDOW o AS (PARTITION BY wid ORDER BY dt, v))
      SELECT wid, dt, v, prior, coalesce(abs((v - prior) / prior) >= 0.02, false) AS material, coalesce(v <= low_before - 0.01, false) AS new_low, low_before FROM w"""),
    "trailing_median": (trailing, f"""WITH {SERIES_SQL} SELECT wid, dt, floor(median(v) OVER w * 100 + 0.5000001) / 100 AS median, count(v) OVER w AS n FROM series WINDOW w AS (PARTITION BY wid ORDER BY dt RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)"""),
    "group_medians": (group_medians, "SELECT l_returnflag, l_linestatus, median(CAST(l_extendedprice AS DOUBLE)) AS middle, count(*) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL"),
    "history_stats": (stats, f"""WITH {SERIES_SQL}, g AS (SELECT wid, arg_max(v, row(dt, v)) AS prior, median(v) FILTER (WHERE dt >= {NOW} - INTERVAL 30 DAYS) AS m, count(*) FILTER (WHERE dt >= {NOW} - INTERVAL 30 DAYS) AS median_n, list(v ORDER BY dt, v) AS s, min(v) AS low FROM series GROUP BY wid)
      SELECT wid, prior, CASE WHEN median_n >= 3 THEN floor(m * 100 + 0.5000001) / 100 END AS median, median_n, floor(list_reduce(s, lambda a, v: 0.3::DOUBLE * v + (1::DOUBLE - 0.3::DOUBLE) * a) * 100 + 0.5000001) / 100 AS ewma, floor(low * 100 + 0.5000001) / 100 AS low FROM g"""),
    "trusted_low": (trusted_low, f"""WITH {SERIES_SQL}, a AS (SELECT wid, arg_max(v, row(dt, v)) AS prior, count(*) FILTER (WHERE dt >= {NOW} - INTERVAL 30 DAYS) AS median_n, min(v) AS low FROM series GROUP BY wid),
      b AS (SELECT user_id + 1 AS wid, min(value) AS low FROM events WHERE event_type = 'error' AND value > 0 GROUP BY 1)
      SELECT wid, prior, coalesce(median_n, 0) AS median_n, floor(least(a.low, b.low) * 100 + 0.5000001) / 100 AS low FROM a FULL JOIN b USING (wid)"""),
    "moving_average": (averages, f"""WITH RECURSIVE {SERIES_SQL}, r AS (SELECT wid, dt, v, row_number() OVER (PARTITION BY wid ORDER BY dt, v) AS i FROM series),
      e AS (SELECT wid, dt, v, i, v AS e FROM r WHERE i = 1 UNION ALL SELECT r.wid, r.dt, r.v, r.i, 0.3::DOUBLE * r.v + (1::DOUBLE - 0.3::DOUBLE) * e.e FROM e JOIN r ON r.wid = e.wid AND r.i = e.i + 1)
      SELECT wid, dt, v, floor(e * 100 + 0.5000001) / 100 AS ewma FROM e"""),
    "price_events": (events, f"""WITH {SERIES_SQL}, l AS (SELECT *, v - lag(v) OVER o AS d, NOT lag(in_stock) OVER o AND coalesce(in_stock, true) AS back FROM series WINDOW o AS (PARTITION BY wid ORDER BY dt, v)),
      k AS (SELECT *, CASE WHEN d IS NULL THEN 'new offer' WHEN abs(d) < 0.01 THEN 'unchanged' WHEN d < 0 THEN 'price drop' ELSE 'price increase' END AS kind FROM l)
      SELECT wid, dt, v, kind || CASE WHEN back THEN '; back in stock' ELSE '' END AS event, max(CASE WHEN kind <> 'unchanged' THEN dt END) OVER (PARTITION BY wid ORDER BY dt, v ROWS UNBOUNDED PRECEDING) AS since FROM k"""),
    "flag_streak": (streak, "WITH r AS (SELECT user_id AS wid, sum(CAST(event_type = 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS no FROM events) SELECT wid, count(*) FILTER (WHERE no = 0) AS streak FROM r GROUP BY wid"),
    "resale_trend": (trend, f"""WITH r AS (SELECT user_id AS wid, value AS avg, CASE WHEN event_type <> 'view' THEN CAST(props->>'$.k' AS INTEGER) END AS n FROM events WHERE ts >= {NOW} - INTERVAL 14 DAYS)
      SELECT wid, floor(CAST(sum(CAST(avg AS DECIMAL(18, 2))) AS DOUBLE) / count(avg) * 100 + 0.5000001) / 100 AS trend, count(avg) AS n FROM r WHERE (n IS NULL OR n >= 3) AND avg IS NOT NULL GROUP BY wid HAVING count(avg) >= 3"""),
    "cadence_select": (cadence, f"""WITH r AS (SELECT user_id AS wid, max(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT c_custkey AS wid FROM customer LEFT JOIN r ON wid = c_custkey WHERE t IS NULL OR date_sub('hour', t, {NOW}) >= 60"""),
    "idempotent_upsert": (upsert, """WITH n AS (SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')), a AS (
        SELECT o_custkey, o_orderpriority, o_totalprice FROM orders o WHERE o_orderpriority <> '1-URGENT' AND NOT EXISTS (SELECT 1 FROM n WHERE n.o_custkey = o.o_custkey AND n.o_orderpriority = o.o_orderpriority)
        UNION ALL SELECT o_custkey, o_orderpriority, o_totalprice FROM n)
      SELECT o_custkey, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM a GROUP BY ALL"""),
    "retention": (retention, f"SELECT event_type, count(*) AS n, min(ts) AS oldest FROM events WHERE ts >= {NOW} - INTERVAL 10 DAYS GROUP BY event_type"),
    "newest_rows": (newest_rows, "SELECT user_id, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 4"),
    "retailer_yield": (yields, f"""WITH {_ATTEMPTS}, k AS (SELECT domain, run, wid, arg_max(CASE WHEN n_listings > 0 AND outcome = 'success' THEN 'found' WHEN outcome = 'blocked' THEN 'blocked' ELSE 'empty' END,
          row(ts, CASE WHEN n_listings > 0 AND outcome = 'success' THEN 'found' WHEN outcome = 'blocked' THEN 'blocked' ELSE 'empty' END)) AS kind, max(ts) AS ts FROM attempts WHERE outcome <> 'skipped' GROUP BY domain, run, wid),
        y AS (SELECT domain, count(*) AS attempts, count(DISTINCT wid) AS items, count(*) FILTER (WHERE kind = 'found') AS found, count(*) FILTER (WHERE kind = 'blocked') AS blocked, count(*) FILTER (WHERE kind = 'empty') AS empty, max(ts) AS last_try FROM k GROUP BY domain)
      SELECT *, found = 0 AND attempts >= 5 AND items >= 2 AND last_try > {NOW} - INTERVAL 30 DAYS AS skip FROM y"""),
    "lifetime_yield": (lifetime_yield, f"""WITH {_ATTEMPTS}, a AS (SELECT *, CASE WHEN n_listings > 0 AND outcome = 'success' THEN 'found' WHEN outcome = 'blocked' THEN 'blocked' ELSE 'empty' END AS kind FROM attempts WHERE outcome <> 'skipped'),
        k AS (SELECT domain, arg_max(kind, row(ts, kind)) AS kind, min(ts) AS first_try, max(ts) FILTER (WHERE kind = 'found') AS last_found, max(ts) AS last_try FROM a GROUP BY domain, run, wid)
      SELECT domain, count(*) FILTER (WHERE kind = 'found') AS found_total, min(first_try) AS first_try, max(last_found) AS last_found, max(last_try) AS last_try FROM k GROUP BY domain"""),
    "vendor_candidates": (candidates, f"""WITH {LISTINGS_SQL}, {_HISTORY}, h AS (SELECT vkey, wid, orderkey % 10 AS run, unit_price AS unit, CASE WHEN median > 0 THEN unit_price / median END AS ratio, evidence LIKE 'verified%' AS ver FROM scored LEFT JOIN hist USING (wid) WHERE eligible AND NOT is_resale AND confidence = 'High'),
      c AS (SELECT vkey, count(*) AS high, count(DISTINCT wid) AS items, count(DISTINCT run) AS runs, count(*) FILTER (WHERE ver) AS verified, min(unit) AS best, min(ratio) AS br, CAST(sum(CAST(ratio AS DECIMAL(18, 6))) AS DOUBLE) / count(ratio) AS ar FROM h GROUP BY vkey),
      m AS (SELECT *, CAST(high >= 20 AS INTEGER) + CAST(items >= 10 AS INTEGER) + CAST(runs >= 4 AS INTEGER) + CAST(br IS NULL OR br <= 0.9 AS INTEGER) AS met FROM c)
      SELECT vkey, high, items, runs, verified, best, floor(br * 1000 + 0.5) / 1000 AS best_ratio, floor(ar * 1000 + 0.5) / 1000 AS avg_ratio, met, met = 4 AS ok FROM m"""),
    "best_of_vendor": (best_of_vendor, f"""WITH {LISTINGS_SQL} SELECT wid, vkey, confidence, evidence LIKE 'verified%' AS is_verified, unit_price FROM scored WHERE eligible
      QUALIFY row_number() OVER (PARTITION BY wid, vkey ORDER BY confidence <> 'High', evidence NOT LIKE 'verified%', unit_price, {_ORDER}) = 1"""),
    "outcome_summary": (outcomes, f"WITH {_ATTEMPTS} SELECT outcome, count(*) AS n, substr(string_agg(DISTINCT domain, ', ' ORDER BY domain), 1, 80) AS targets FROM attempts GROUP BY outcome"),
    "evidence_mix": (evidence_mix, f"""WITH {LISTINGS_SQL} SELECT wid, count(*) AS listings, count(DISTINCT vkey) AS vendors, concat_ws('/', count(*) FILTER (WHERE evidence = 'verified_direct'), count(*) FILTER (WHERE evidence = 'verified_discovered'), count(*) FILTER (WHERE evidence = 'market_snapshot')) AS mix,
      min(unit_price) FILTER (WHERE confidence = 'High') AS lowest FROM listings GROUP BY wid"""),
    "missing_words": (words_missing, """WITH t AS (SELECT DISTINCT p_partkey % 500 AS wid, unnest(string_split(lower(p_name), ' ')) AS w FROM part),
      i AS (SELECT DISTINCT p_partkey % 500 AS wid, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part)
      SELECT wid, string_agg(w, ' ' ORDER BY w) AS missing FROM i WHERE length(w) >= 3 AND wid IN (SELECT wid FROM t) AND NOT EXISTS (SELECT 1 FROM t WHERE t.wid = i.wid AND t.w = i.w) GROUP BY wid"""),
    "cheapest_snapshots": (snapshots, f"""WITH {LISTINGS_SQL}, c AS (SELECT * FROM scored WHERE evidence = 'market_snapshot' AND eligible QUALIFY row_number() OVER (PARTITION BY wid, vkey ORDER BY unit_price, {_ORDER}) = 1)
      SELECT wid, vkey, unit_price, row_number() OVER (PARTITION BY wid ORDER BY unit_price, vkey, {_ORDER}) AS rank FROM c QUALIFY rank <= 2"""),
    "title_text": (titles, """SELECT p_partkey, 'the new 4 inch ' || lower(p_name) || ' gen2 wifi pack of ' || (p_size % 5 + 1) || ' ' || CAST(CAST(p_retailprice AS DECIMAL(10, 2)) AS VARCHAR) AS normal, p_size % 5 + 1 AS pack_qty,
      CAST(CAST(p_retailprice AS DECIMAL(10, 2)) AS DOUBLE) AS price, array_to_string(list_sort([c FOR c IN ['black', 'white', 'silver', 'gray', 'grey', 'gold', 'blue', 'red', 'green', 'pink', 'purple', 'yellow', 'orange', 'brown'] IF list_contains(string_split(lower(p_name), ' '), c)]), ',') AS colors FROM part"""),
    "condition_text": (conditions, r"""WITH t AS (SELECT doc_id, lower(coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN ' open-box' WHEN 1 THEN ' Renewed' WHEN 2 THEN ' for parts' ELSE '' END) AS t FROM documents)
      SELECT doc_id, CASE WHEN regexp_matches(t, 'for parts|not working|broken|damaged|as[- ]is|defective') THEN 'parts' WHEN regexp_matches(t, 'refurb|renewed|reconditioned|recertified') THEN 'refurbished'
        WHEN regexp_matches(t, 'open[- ]box|pre-?owned|\bused\b|like[- ]new') THEN 'used' ELSE 'new' END AS condition, doc_id % 9 + 0.5::DOUBLE AS shipping FROM t"""),
    "vendor_keys": (vendors, "SELECT s_suppkey, 'supplier' || CAST(regexp_extract(s_name, '#0*(.*)', 1) AS VARCHAR) AS vkey, 'shop' || s_suppkey || 'example' AS url_key FROM supplier"),
    "gtin_check": (gtins, """WITH d AS (SELECT o_orderkey, CAST(o_orderkey * 7919 + 400000000000 AS VARCHAR) AS d FROM orders), s AS (SELECT *, (10 - list_sum([CAST(d[i] AS INTEGER) * CASE WHEN (length(d) - 1 - i) % 2 = 0 THEN 3 ELSE 1 END FOR i IN range(1, length(d))]) % 10) % 10 AS c FROM d)
      SELECT o_orderkey, c = CAST(d[-1] AS INTEGER) AS valid, CASE WHEN c = CAST(d[-1] AS INTEGER) THEN lpad(d, 14, '0') END AS gtin FROM s"""),
    "normalize_url": (page_urls, r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS s, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS h, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
      n AS (SELECT *, CASE WHEN length(path) > 1 THEN rtrim(path, '/') ELSE '/' END AS np, array_to_string(list_sort([x FOR x IN string_split(q, '&') IF regexp_matches(x, '^[^=]+=.') AND NOT regexp_matches(x, '^(utm_[a-z]*|ref|tag|cid)=')]), '&') AS nq FROM p)
      SELECT page_id, s || '://' || h || np || CASE WHEN nq <> '' THEN '?' || nq ELSE '' END AS canonical, regexp_replace(h, '^(www\d?|m|shop|store)\.', '') AS host,
        path IN ('', '/') OR regexp_matches(path, '/(search|s|blog|blogs|support|help|compare|collections?|category|categories|c|cat|stories|press|news)(/|$)') OR regexp_matches('?' || q, '[?&](q|query)=') AS listing,
        NOT regexp_matches(path, '/[a-z]{2}[-_][a-z]{2}(/|$)') AS locale_ok, CASE WHEN strpos(url, '&sku=') > 0 OR true THEN 'AB12' END AS item FROM n"""),
    "links_from_pages": (page_links, r"""WITH l AS (SELECT url, regexp_extract_all(html, '(?i)href=["'']([^"''#]+)', 1) AS hs FROM pages), e AS (SELECT url, unnest(hs) AS href, unnest(range(len(hs))) AS position FROM l),
      a AS (SELECT url, position, replace(href, '&amp;', '&') AS href FROM e), b AS (SELECT url, position, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href END AS link FROM a),
      h AS (SELECT *, regexp_replace(lower(regexp_extract(link, '://([^/?#:]+)', 1)), '^(www\d?|m|shop|store)\.', '') AS lh, regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^(www\d?|m|shop|store)\.', '') AS uh FROM b)
      SELECT url, link, min(position) AS position FROM h WHERE link IS NOT NULL AND (lh = uh OR ends_with(lh, '.' || uh)) GROUP BY url, link"""),
    "page_facts": (page_facts, r"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT page_id, trim(replace(replace(replace(replace(replace(replace(replace(replace(regexp_extract(h, '(?i)<title[^>]*>([^<]+)</title>', 1),
        '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), ' ') AS title,
        regexp_matches(lower(substr(h, 1, 20000)), 'captcha|are you a robot|robot or human|access denied|request unsuccessful. incapsula|pardon our interruption|attention required|verify you are human|unusual traffic|bot detection|/_incapsula_resource') AS blocked,
        len(regexp_extract_all(regexp_replace(h, '(?is)<script.*?</script>|<style.*?</style>|<[^>]+>', ' ', 'g'), '[A-Za-z]{3,}')) < 250 OR regexp_matches(h, 'id=["''](root|__next|app|__nuxt)["'']\s*>\s*</div>') AS shell FROM p)
      SELECT *, CASE WHEN blocked THEN 'blocked' WHEN page_id % 9 = 0 THEN 'unavailable' ELSE 'success' END AS outcome FROM f"""),
    "json_props": (event_props, "SELECT event_type, count(*) FILTER (WHERE CAST(props->>'$.k' AS INTEGER) > 50) AS large, sum(CAST(props->>'$.k' AS INTEGER)) AS total FROM events GROUP BY event_type"),
    "top_offers": (sorted_top, f"WITH {LISTINGS_SQL} SELECT wid, rank, unit_price FROM (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY unit_price, {_ORDER}) AS rank FROM scored WHERE reportable) WHERE rank <= 3"),
}
