"""What a run reports: rows of items and deals, flags, notes and a summary, as columns and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.pricing import verified

# What the sheet's columns hold.
EVIDENCE = ["verified_direct", "verified_discovered", "market_snapshot"]
STATUS_CHARS, PLAN_CHARS, OUTCOME_CHARS, FLAG_CHARS, TITLE_CHARS = 900, 400, 600, 300, 200
MATERIAL = 0.02


def stock_status() -> Column:
    """Whether stock is confirmed: only merchants' own pages can."""
    return F.when(verified() & F.col("in_stock").isNotNull(), F.when(F.col("in_stock"), "Yes").otherwise("No")).otherwise("N/A")


def flag_text(items: Column, streak: Column) -> Column:
    """"No", or "Yes" with the items and, where earlier runs in a row had the flag, the number of this one."""
    again = F.when(streak > 0, F.concat(F.lit(" (run "), (streak + 1).cast("string"), F.lit(" in a row)"))).otherwise("")
    return F.when(F.size(items) > 0, F.concat(F.lit("Yes"), again, F.lit(": "), F.array_join(items, "; "))).otherwise("No")


def evidence_mix() -> Column:
    """An aggregate: how many eligible listings there are of each kind of evidence."""
    n = {e: F.count_if(F.col("eligible") & (F.col("evidence") == e)) for e in EVIDENCE}
    parts = F.array_compact(F.array(*[F.when(c > 0, F.concat(c.cast("string"), F.lit(f" {e}"))) for e, c in n.items()]))
    return F.when(F.count_if("eligible") == 0, "no eligible listings").otherwise(F.array_join(parts, ", "))


def run_rows(listings: DataFrame) -> DataFrame:
    """(wid, listings, matching, websites, lowest, evidence_mix) of scored listings."""
    sure = F.col("reportable") & (F.col("confidence") == "High")
    return listings.groupBy("wid").agg(
        F.count(F.lit(1)).alias("listings"), F.count_if("eligible").alias("matching"), F.count_distinct(F.nullif("vkey", F.lit(""))).alias("websites"),
        F.min(F.when(sure, F.col("unit_price"))).alias("lowest"), evidence_mix().alias("evidence_mix"),
    )


def target_counts(listings: DataFrame, items: DataFrame, deals: DataFrame) -> DataFrame:
    """(wid, at_target, primary_at_target, deals, primary_deals): reportable listings at an item's target or below, and its deals."""
    sure = listings.where(F.col("reportable") & (F.col("confidence") == "High")).join(items.select("wid", "target"), "wid")
    met = sure.where((F.col("target") > 0) & (F.col("unit_price") <= F.col("target"))).groupBy("wid").agg(F.count(F.lit(1)).alias("at_target"), F.count_if("is_primary").alias("primary_at_target"))
    found = deals.groupBy("wid").agg(F.count(F.lit(1)).alias("deals"), F.count_if("is_primary").alias("primary_deals"))
    out = items.select("wid").join(met, "wid", "left").join(found, "wid", "left")
    return out.select("wid", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("at_target", "primary_at_target", "deals", "primary_deals")])


def change_of(baseline: Column, prior: Column) -> Column:
    """The relative change of a verified price against the one before; null without both."""
    return F.when((prior > 0) & (baseline > 0), F.floor((baseline - prior) / prior * 10000 + 0.5) / 10000)


def change_note(baseline: Column, prior: Column) -> Column:
    """A note on a change of MATERIAL or more."""
    c = change_of(baseline, prior)
    way = F.when(c < 0, "down").otherwise("up")
    return F.when(F.abs(c) >= MATERIAL, F.format_string("verified price %s %.1f%% vs prior $%.2f", way, F.abs(c) * 100, prior))


def item_rows(items: DataFrame, runs: DataFrame, facts: DataFrame, texts: DataFrame) -> DataFrame:
    """One row an item: its counts (run_rows), its figures (facts: wid, baseline, ref_price, ref_type, median, trend, low, ewma, prior, plan_total) and its texts (wid, status, notes, plan, outcomes, link_flag, search_flag), cut to what a cell holds."""
    cut = {"status": STATUS_CHARS, "notes": STATUS_CHARS, "plan": PLAN_CHARS, "outcomes": OUTCOME_CHARS, "link_flag": FLAG_CHARS, "search_flag": FLAG_CHARS}
    t = texts.select("wid", *[F.substring(c, 1, n).alias(c) for c, n in cut.items()])
    out = items.select("wid", "product").join(runs, "wid", "left").join(facts, "wid", "left").join(t, "wid", "left")
    return out.withColumns({
        "listings": F.coalesce("listings", F.lit(0).cast("long")), "evidence_mix": F.coalesce("evidence_mix", F.lit("no eligible listings")), "plan": F.coalesce("plan", F.lit("no purchasable High-confidence offer")),
        "status": F.coalesce("status", F.lit("none listed in the sheet")), "change": change_of(F.col("baseline"), F.col("prior")),
    })


def deal_rows(deals: DataFrame, items: DataFrame) -> DataFrame:
    """One row a deal (of find_deals, with ref): prices against target and reference, labels, and texts cut to what a cell holds."""
    d = deals.join(items.select("wid", "product", "target"), "wid", "left")
    below = lambda c: F.when(F.col(c) > 0, F.floor((F.col(c) - F.col("unit_price")) / F.col(c) * 10000 + 0.5) / 10000)
    pool = F.when(F.col("is_resale"), "resale").otherwise("new")
    rule = F.concat(F.when(F.col("conditional").isNotNull(), F.concat(F.lit("CONDITIONAL ("), "conditional", F.lit(") "))).otherwise(""), F.array_join("reasons", "; "), F.lit(" ["), pool, F.lit(" pool]"), F.when(~verified(), " [market snapshot]").otherwise(""))
    title = F.substring(F.col("title"), 1, TITLE_CHARS) if "title" in deals.columns else F.lit(None).cast("string")
    return d.select(
        "wid", "product", "rank", F.col("is_primary").cast("int").alias("is_primary"), "target", F.col("unit_price").alias("price"), "confidence", "vkey", "condition", F.col("price").alias("listed_price"), "pack_qty",
        below("target").alias("below_target"), F.col("ref").alias("baseline"), below("ref").alias("below_baseline"), rule.alias("rule"), (F.col("is_resale") & ~F.col("is_primary")).alias("secondary"), stock_status().alias("stock_verified"), title.alias("title"), "evidence",
    )


def result_note() -> Column:
    """An audit line of a source's result (source, target, outcome, n, detail)."""
    n = F.when(F.col("n") > 0, F.concat(F.lit(" "), F.col("n").cast("string"), F.lit(" listing(s)"))).otherwise("")
    detail = F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(" - "), "detail")).otherwise("")
    return F.concat("source", F.lit("["), "target", F.lit("]: "), "outcome", n, detail)


def ratio_text(ratio: Column) -> Column:
    """A price ratio as text."""
    return F.when(ratio > 0, F.format_string("%.2fx", ratio)).otherwise("n/a")


def summary_lines(rows: DataFrame) -> DataFrame:
    """(wid, line): a table row in Markdown for each item (product, baseline, ref_price, deals, new_events, plan, outcomes), to be ordered by wid."""
    money = lambda c: F.when(F.col(c) > 0, F.concat(F.lit("$"), F.format_number(c, 2))).otherwise("-")
    found = F.format_string("%d (%d)", F.coalesce("deals", F.lit(0)), F.coalesce("new_events", F.lit(0)))
    cells = ["product", money("baseline"), money("ref_price"), found, F.substring(F.coalesce("plan", F.lit("-")), 1, 80), F.substring(F.coalesce("outcomes", F.lit("")), 1, 120)]
    return rows.select("wid", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
