"""Prices of offers: normal forms, baselines, market figures, reference prices, deals and purchase plans.

Listings have wid (the item), vendor, price, shipping, pack_qty, condition,
in_stock (null: unknown, which counts as available), evidence, confidence,
conditional (null: an ordinary price), regular_price, is_primary, is_resale and
eligible. Every reduction is by wid; an item's rows are never gathered in one
task but where a function says so, and then they are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import money

# Evidence that is verified, and the thresholds of deals and pools.
VERIFIED = ["verified_direct", "verified_discovered"]
DEAL_DISCOUNT = 0.15
MARKET_MIN_SAMPLE = 3
OUTLIER_LOW, OUTLIER_HIGH = 0.4, 2.5
MAX_DEALS = 5
BAND_NEW, BAND_RESALE = (0.60, 1.40), (0.30, 1.05)
RESALE_VS_NEW = 0.35
USED_PRIMARY_SAVING, USED_PRIMARY_MAX = 0.05, 3
CONSENSUS_TOLERANCE = 0.05
MIN_TARGET_RATIO = 0.35
ONE_OFF_LIMIT = 12
#: Columns that listings may lack; null means: not an own link, a seller that is fine, an ordinary price, no regular price, stock unknown.
OPTIONAL = {"from_url": "boolean", "seller_ok": "boolean", "conditional": "string", "regular_price": "double", "in_stock": "boolean", "shipping": "double"}
#: Bins of prices BIN_RATIO wide: prices that agree are at most BIN_REACH bins apart.
BIN_RATIO, BIN_REACH = 1.15, 2


def verified() -> Column:
    return F.col("evidence").isin(VERIFIED)


def available() -> Column:
    return F.coalesce(F.col("in_stock"), F.lit(True))


def mean_cents(c: Column) -> Column:
    """The mean of money values, the same whatever the order of the sum."""
    return F.sum(c.cast("decimal(18,2)")).cast("double") / F.count(c)


def normalize_prices(listings: DataFrame) -> DataFrame:
    """listings with effective_price (with shipping; null: none), pack_qty of 1 at least, unit_price and availability; OPTIONAL columns are added where missing."""
    listings = listings.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in listings.columns})
    pack = F.greatest(F.lit(1), F.coalesce("pack_qty", F.lit(1)))
    effective = money(F.col("price") + F.coalesce("shipping", F.lit(0.0)))
    return listings.withColumns({
        "pack_qty": pack, "effective_price": effective, "unit_price": money(effective / pack),
        "availability": F.when(F.col("in_stock").isNull(), "unknown").when(F.col("in_stock"), "in_stock").otherwise("out_of_stock"),
    })


def score_eligibility(listings: DataFrame, items: DataFrame) -> DataFrame:
    """listings with eligible, cond_ok, reportable and trusted, by items (wid, packs: allowed sizes or null for any, target, open_used).

    Needs unit_price. An item without a row allows single units only.
    """
    l = listings.join(items.select("wid", "packs", "target", "open_used", F.lit(True).alias("_item")), "wid", "left")
    packs_ok = F.when(F.col("_item").isNull(), F.col("pack_qty") == 1).otherwise(F.col("packs").isNull() | F.array_contains("packs", F.col("pack_qty")))
    sold_out = ~available() & ~(verified() & ~F.col("is_resale"))
    cheap = (F.coalesce("target", F.lit(0.0)) > 0) & ~F.coalesce("from_url", F.lit(False)) & (F.col("unit_price") < F.col("target") * MIN_TARGET_RATIO)
    open_used = F.coalesce("open_used", F.lit(False))
    ok = (F.col("condition") != "parts") & packs_ok & F.col("confidence").isin("High", "Medium") & ~sold_out & ~cheap & (~F.col("is_resale") | open_used)
    ordinary = F.col("conditional").isNull()
    out = l.withColumns({"cond_ok": ok & ~ordinary, "eligible": ok & ordinary})
    reportable = F.col("eligible") & available() & (open_used | (F.col("is_primary") & ~F.col("is_resale")))
    return out.withColumns({"reportable": reportable, "trusted": trusted()}).drop("_item", "packs", "target", "open_used")


def trusted() -> Column:
    """May feed baselines and history."""
    return F.col("eligible") & verified() & (F.col("confidence") == "High") & (F.col("condition") == "new") & ~F.col("is_resale") & F.col("conditional").isNull()


def verified_baseline(listings: DataFrame) -> DataFrame:
    """(wid, baseline, n): the median unit price of the first pool with rows: single units in stock, single units, in stock, all.

    Items without a trusted listing have no row.
    """
    pool = listings.where(trusted())
    pools = [available() & (F.col("pack_qty") == 1), F.col("pack_qty") == 1, available(), F.lit(True)]
    aggregates = [x for i, p in enumerate(pools) for x in (F.median(F.when(p, F.col("unit_price"))).alias(f"m{i}"), F.count(F.when(p, 1)).alias(f"n{i}"))]
    rows = pool.groupBy("wid").agg(*aggregates)
    first = F.coalesce(*[F.when(F.col(f"n{i}") > 0, F.struct(F.col(f"m{i}").alias("m"), F.col(f"n{i}").alias("n"))) for i in range(4)])
    return rows.select("wid", money(first["m"]).alias("baseline"), first["n"].alias("n"))


def pack_baselines(listings: DataFrame) -> DataFrame:
    """(wid, pack_qty, pack_price): the median unit price by pack size of trusted listings in stock; of all where none is."""
    pool = listings.where(trusted())
    rows = pool.groupBy("wid", "pack_qty").agg(F.median(F.when(available(), F.col("unit_price"))).alias("m"), F.median("unit_price").alias("all"), F.count(F.when(available(), 1)).alias("n"))
    stocked = rows.groupBy("wid").agg(F.sum("n").alias("stocked"))
    rows = rows.join(stocked, "wid").where((F.col("stocked") == 0) | (F.col("n") > 0))
    return rows.select("wid", "pack_qty", money(F.when(F.col("stocked") == 0, F.col("all")).otherwise(F.col("m"))).alias("pack_price"))


def trimmed_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, avg, n, lo): the mean of values between OUTLIER_LOW and OUTLIER_HIGH times their group's median, borders included.

    Null values count for nothing; a group without values has no row.
    """
    df = df.where(F.col(value).isNotNull()).select(*keys, value)
    medians = df.groupBy(*keys).agg(F.median(value).alias("_median"))
    kept = df.join(medians, keys).where(F.col(value).between(F.col("_median") * OUTLIER_LOW, F.col("_median") * OUTLIER_HIGH))
    return kept.groupBy(*keys).agg(money(mean_cents(F.col(value))).alias("avg"), F.count(F.lit(1)).alias("n"), money(F.min("_median") * OUTLIER_LOW).alias("lo"))


def market_stats(listings: DataFrame) -> DataFrame:
    """(wid, is_resale, avg, n, lo) over eligible listings of high confidence."""
    return trimmed_mean(listings.where(F.col("eligible") & (F.col("confidence") == "High")), ["wid", "is_resale"], "unit_price")


def _regular() -> Column:
    return F.when(F.col("regular_price") > 0, money(F.col("regular_price") / F.col("pack_qty")))


def regular_consensus(listings: DataFrame) -> DataFrame:
    """(wid, consensus, n): the median of published regular unit prices within CONSENSUS_TOLERANCE of their median, of two at least."""
    regs = listings.where((F.col("confidence") == "High") & (F.col("condition") == "new") & ~F.col("is_resale")).select("wid", _regular().alias("reg")).where("reg > 0")
    medians = regs.groupBy("wid").agg(F.median("reg").alias("_median"))
    agree = regs.join(medians, "wid").where(F.abs(F.col("reg") - F.col("_median")) / F.col("_median") <= CONSENSUS_TOLERANCE)
    return agree.groupBy("wid").agg(money(F.median("reg")).alias("consensus"), F.count(F.lit(1)).alias("n")).where("n >= 2")


def reference_price(listings: DataFrame, history: DataFrame, order: list[str]) -> DataFrame:
    """(wid, ref_price, ref_type) of every item of listings: the first there is of a regular price that a verified merchant publishes (single units, direct
    sellers and own links first), a direct seller's price, the regular consensus, the history's median, its moving average, the verified price now.

    history: (wid, median, ewma). `order` breaks ties; is_direct marks direct sellers.
    """
    ver = listings.where(verified() & (F.col("confidence") == "High") & (F.col("condition") == "new") & ~F.col("is_resale") & (F.col("eligible") | F.col("cond_ok")))
    rank = F.struct(F.col("pack_qty") != 1, ~F.col("is_direct"), ~F.coalesce("from_url", F.lit(False)), *order)
    direct = F.col("is_direct") & (F.col("pack_qty") == 1)
    found = ver.groupBy("wid").agg(
        F.min_by(F.when(_regular() > 0, _regular()), F.when(_regular() > 0, rank)).alias("published"),
        F.min_by(F.when(direct, money(F.col("price"))), F.when(direct, rank)).alias("direct"),
        money(F.median(F.when((F.col("pack_qty") == 1) & F.col("eligible"), F.col("unit_price")))).alias("current"),
    )
    all_of = listings.select("wid").distinct().join(found, "wid", "left").join(regular_consensus(listings).drop("n"), "wid", "left").join(history.select("wid", "median", "ewma"), "wid", "left")
    steps = [("published", "msrp_regular"), ("direct", "msrp_regular"), ("consensus", "regular_consensus"), ("median", "historical_verified"), ("ewma", "historical_verified"), ("current", "verified_current")]
    first = F.coalesce(*[F.when(F.col(c) > 0, F.struct(F.col(c).alias("p"), F.lit(t).alias("t"))) for c, t in steps])
    return all_of.select("wid", first["p"].alias("ref_price"), F.coalesce(first["t"], F.lit("none")).alias("ref_type"))


def apply_band(listings: DataFrame, anchors: DataFrame) -> DataFrame:
    """listings with in_band, and eligible, cond_ok and reportable false outside the band around their item's anchor.

    anchors: (wid, anchor); items without one, and own verified links, are always in band.
    """
    l = listings.join(anchors.select("wid", "anchor"), "wid", "left")
    lo, hi = (F.when(F.col("is_resale"), BAND_RESALE[i]).otherwise(BAND_NEW[i]) for i in range(2))
    own = F.coalesce("from_url", F.lit(False)) & verified()
    inside = own | F.coalesce(F.col("anchor") <= 0, F.lit(True)) | F.col("unit_price").between(F.col("anchor") * lo, F.col("anchor") * hi)
    return l.withColumn("in_band", inside).withColumns({c: F.col(c) & F.col("in_band") for c in ("eligible", "cond_ok", "reportable")}).drop("anchor")


def find_deals(listings: DataFrame, facts: DataFrame, order: list[str], limit: int = MAX_DEALS, target_rule: bool = False) -> DataFrame:
    """The best deals of each item: listings with reasons (texts), ref and rank (from 1).

    facts: (wid, ref_price, baseline, new_avg, new_n, res_avg, res_n, median, median_n, low, trend and, if there, target and open_used), and packs, a map of
    pack prices. A conditional price counts if its item is open to used offers or it is a primary vendor's new one. target_rule: DEAL_DISCOUNT below the
    item's target is a reason, too.
    Ordinary prices come before conditional ones, verified before others, primary before other vendors before resale, then the unit
    price; `order` breaks ties. A row_number filter, so each task keeps its first `limit` rows before the shuffle.
    """
    facts = facts.withColumns({c: F.lit(None).cast(t) for c, t in (("target", "double"), ("open_used", "boolean")) if c not in facts.columns})
    l = listings.where((F.col("confidence") == "High") & F.coalesce("seller_ok", F.lit(True)) & available() & (F.col("reportable") | F.col("cond_ok"))).join(facts, "wid", "left")
    l = l.where(F.col("reportable") | F.coalesce("open_used", F.lit(False)) | (F.col("is_primary") & ~F.col("is_resale")))
    unit, new = F.col("unit_price"), ~F.col("is_resale")
    pack = F.when(F.col("pack_qty") > 1, F.try_element_at("packs", F.col("pack_qty")))
    market = lambda side: F.when(F.col(f"{side}_n") >= MARKET_MIN_SAMPLE, F.col(f"{side}_avg"))
    positive = lambda c: F.when(c > 0, c)
    ref = F.when(new, F.coalesce(pack, positive(F.col("ref_price")), positive(F.col("baseline")), market("new"))).otherwise(market("res"))
    l = l.withColumn("ref", ref)
    sane = F.col("ref").isNull() | (unit >= F.col("ref") * OUTLIER_LOW)
    trend = F.when(new, F.col("median")).otherwise(F.col("trend"))
    rules = [
        (F.col("is_resale") & F.col("ref").isNull() & (unit <= F.col("ref_price") * (1 - RESALE_VS_NEW)), "far below new"),
        ((F.col("ref") > 0) & sane & (unit <= F.col("ref") * (1 - DEAL_DISCOUNT)), "below reference"),
        ((trend > 0) & sane & (unit < trend), "below trend"),
        (new & (F.col("low") > 0) & (F.col("median_n") >= 3) & sane & (unit <= F.col("low") - 0.01), "new verified low"),
        (F.lit(target_rule) & (F.col("target") > 0) & (unit <= F.col("target") * (1 - DEAL_DISCOUNT)), "below target"),
    ]
    l = l.withColumn("reasons", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))).where(F.size("reasons") > 0)
    kind = F.when(F.col("is_primary") & new, 0).when(new, 1).otherwise(2)
    w = Window.partitionBy("wid").orderBy(F.col("conditional").isNotNull(), ~verified(), kind, unit, *order)
    return l.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop(*[c for c in facts.columns if c != "wid"])


def used_primary_offers(listings: DataFrame, references: DataFrame, order: list[str]) -> DataFrame:
    """The cheapest verified used or refurbished single units of primary vendors, each USED_PRIMARY_SAVING below the new price or more: listings with saving and rank.

    references: (wid, new_ref).
    """
    l = listings.where(
        F.col("condition").isin("used", "refurbished") & F.col("is_primary") & verified() & (F.col("confidence") == "High") & F.coalesce("seller_ok", F.lit(True))
        & available() & F.col("conditional").isNull() & F.col("reportable") & (F.col("pack_qty") == 1)
    ).join(references.where("new_ref > 0").select("wid", "new_ref"), "wid")
    l = l.withColumn("saving", (F.col("new_ref") - F.col("unit_price")) / F.col("new_ref")).where(F.col("saving") >= USED_PRIMARY_SAVING)
    w = Window.partitionBy("wid").orderBy("unit_price", *order)
    return l.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= USED_PRIMARY_MAX)


def plan_options(listings: DataFrame, order: list[str]) -> DataFrame:
    """What a purchase plan may use: the cheapest new retail offer of each pack size, and the ONE_OFF_LIMIT cheapest resale offers, so few rows an item."""
    l = listings.where(F.col("reportable") & (F.col("confidence") == "High") & F.coalesce("seller_ok", F.lit(True)) & F.col("conditional").isNull() & available() & (F.col("effective_price") > 0))
    l = l.withColumns({"once": F.col("is_resale") | (F.col("condition") != "new"), "unverified": (~verified()).cast("int")})
    retail = Window.partitionBy("wid", "pack_qty").orderBy("effective_price", "unverified", ~F.col("is_primary"), *order)
    once = Window.partitionBy("wid").orderBy("unit_price", *order)
    kept = l.where(~F.col("once")).withColumn("_n", F.row_number().over(retail)).where("_n = 1")
    return kept.unionByName(l.where("once").withColumn("_n", F.row_number().over(once)).where(F.col("_n") <= ONE_OFF_LIMIT)).drop("_n")


def cheapest_cover(options: list[tuple[int, float, int, bool]], need: int) -> tuple[float, int, int] | None:
    """(cost, unverified purchases, units) of the cheapest way to get `need` units or more; options: (pack, price, unverified, once only)."""
    best: list[tuple[float, int, int] | None] = [(0.0, 0, 0)] + [None] * need
    for pack, price, unverified, once in sorted(options, key=lambda o: not o[3]):
        source = list(best) if once else best
        for x in range(1, need + 1):
            if (before := source[max(0, x - pack)]) is not None:
                now = (round(before[0] + price, 2), before[1] + unverified, before[2] + pack)
                if best[x] is None or now < best[x]:
                    best[x] = now
    return best[need]


def quantity_plan(listings: DataFrame, items: DataFrame, order: list[str]) -> DataFrame:
    """(wid, need, total, unverified, units): the cheapest purchases that cover items (wid, qty_needed); ties: fewer unverified, then fewer units."""

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for wid, need, options in zip(pdf["wid"], pdf["need"], pdf["options"]):
                if (found := cheapest_cover([(o["pack_qty"], o["effective_price"], o["unverified"], o["once"]) for o in options], int(need))) is not None:
                    rows.append((wid, int(need), found[0], found[1], found[2]))
            yield pd.DataFrame(rows, columns=["wid", "need", "total", "unverified", "units"])

    options = plan_options(listings, order).groupBy("wid").agg(F.collect_list(F.struct("pack_qty", "effective_price", "unverified", "once")).alias("options"))
    wanted = options.join(items.select("wid", F.greatest(F.lit(1), F.coalesce("qty_needed", F.lit(1))).alias("need")), "wid")
    kind = dict(listings.dtypes)["wid"]
    return wanted.mapInPandas(plan, f"wid {kind}, need int, total double, unverified int, units int")
