"""What larger tables need: work over many tasks, no exchange of what a join makes many of, narrow rows."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import tasks as dealing
from larkspur.functions.text import keys_match
from larkspur.operators import identity, reconcile, sourcing
from larkspur.plans import offers, sources
from larkspur.plans import sourcing as sourcing_plans
from tests.conftest import SF


def tasks(df) -> int:
    """The tasks that a query's last stage has rows in."""
    return df.select(F.spark_partition_id().alias("task")).distinct().count()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def parts(spark, tmp_path):
    """A folder with a part table of one file."""
    rows = spark.range(64).select(F.col("id").alias("p_partkey"), F.concat(F.lit("red bolt "), "id").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("SMALL").alias("p_type"), (F.col("id") % 50 + 1).cast("int").alias("p_size"), (F.col("id") + 0.5).alias("p_retailprice"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_structured_offers_run_in_many_tasks(spark, parts):
    found = sources.structured(spark, parts)
    assert tasks(found) > 8 and found.count() == 64


def test_page_listings_run_in_many_tasks(spark, parts):
    found = sources.product_pages(spark, parts)
    assert "REPARTITION_BY_NUM" in plan(found) and found.count() == 128


def test_pairs_that_share_codes_are_not_exchanged(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "PAIR_KEYS", 2)
    codes = {1: ["a", "b", "c"], 2: ["b", None], 3: ["c", "a"], 4: [], 5: ["x"], 6: ["b", "a"], 7: None, 8: ["a", "c", "c"]}
    rows = [*codes.items(), (2, ["c"]), (1, ["b"])]
    left = spark.createDataFrame(rows, "wid long, codes array<string>")
    right = spark.createDataFrame([(k + 100, c) for k, c in rows if k != 5], "wid long, codes array<string>")
    pairs = reconcile.share_identifier(left, right, "wid", "codes")
    every = lambda k: {c for key, cs in rows if key == k for c in cs or [] if c}
    wanted = sorted((a, b + 100) for a in codes for b in codes if b != 5 and every(a) & every(b))
    assert sorted(tuple(r) for r in pairs.collect()) == wanted
    assert "hashpartitioning(left_wid" not in plan(pairs)


def test_a_vendor_sheet_is_no_part_of_the_plan(spark):
    names = ["Philips Hue Direct", "Bolt & Nut Store", "Soundcore Inc", "The Shop", "Hue hue", None]
    sheet = spark.createDataFrame([(n, f"www.v{i}.com" if i != 3 else "", d) for i, n in enumerate(names * 2) for d in (True, False, None)], "name string, domain string, is_direct boolean")
    items = spark.createDataFrame([(1, "hue color slim bolt"), (2, "sound core speaker"), (3, None), (4, "hue color slim bolt"), (None, "nut")], "wid int, product_text string")
    hosts = lambda *h: spark.createDataFrame([(f"v{i}.com",) for i in h], "host string")
    covered = spark.createDataFrame([(1, "v0.com"), (1, "v0.com"), (4, "v1.com"), (2, None), (None, "v1.com"), (2, "elsewhere.com")], "wid int, host string")
    asked = sourcing.verification_targets(items, sheet, covered, hosts(4), hosts(5, 2))
    assert "v6.com" not in plan(asked)
    pairs = items.crossJoin(sheet.where("domain <> ''").selectExpr("name vendor", "substring(domain, 5) host", "is_direct")).where("host <> 'v4.com' and (is_direct or host not in ('v5.com', 'v2.com'))")
    pairs = pairs.where(~F.coalesce("is_direct", F.lit(False)) | sourcing.name_fits_product(F.col("vendor"), F.col("product_text"))).join(covered, ["wid", "host"], "left_anti")
    wanted = pairs.select("wid", "vendor", "host", F.when(F.col("is_direct"), "direct").otherwise("retailer"))
    assert sorted(map(repr, map(tuple, asked.collect()))) == sorted(map(repr, map(tuple, wanted.collect())))


def test_item_sheet_is_read_in_many_tasks(spark, parts):
    found = sources.item_sheet(spark, parts)
    assert "REPARTITION_BY_NUM" in plan(found) and found.count() == 64


def test_what_offers_say_alike_is_classified_once(spark, monkeypatch):
    none = [None] * 6
    items = spark.createDataFrame([(1, "Acme Glow Lamp", "Acme", ["red"], ["AGL1000"], *none[:2]), (2, "Bolt", None, *none[:4])], "wid int, product string, brand string, specs array<string>, mpns array<string>, gtins array<string>, exclude array<string>")
    said = [("Acme Glow Lamp red", None, ["AGL-1000"], 1, ""), ("Acme Glow Lamp case", None, None, 1, None), (None, None, None, 1, None)]
    rows = spark.createDataFrame([(w, n, *x) for n in range(5) for w in (1, 2, 3, None) for x in said], "wid int, n int, title string, offer_gtins array<string>, offer_mpns array<string>, pack_qty int, color string")
    every = identity.classify(rows.join(identity.item_features(items), "wid")).select(*rows.columns, "confidence", "reason", "match_evidence").collect()
    asked, classify = [], identity.classify
    monkeypatch.setattr(identity, "classify", lambda pairs, *a: asked.append(pairs.count()) or classify(pairs, *a))
    got = identity.classify_offers(items, rows).collect()
    assert asked == [6] and sorted(map(repr, got)) == sorted(map(repr, every)) and len(got) == 30


def test_promotion_joins_offers_once(spark):
    found = offers.promotion(spark, SF)
    assert plan(found).count("LeftOuter") == 1 and "LeftSemi" in plan(found)


def test_merged_offers_are_exchanged_with_few_columns(spark):
    assert not any(c in plan(offers.dedupe(spark, SF)) for c in ("l_shipdate", "regular_price", "is_direct"))


@pytest.mark.parametrize(("query", "most"), [("link_fallback", 40), ("failed_stand_ins", 7), ("vendor_roles", 15), ("unworking_snapshots", 6)])
def test_tables_are_read_few_times(spark, query, most):
    assert plan(sourcing_plans.QUERIES[query][0](spark, SF)).count("FileScan parquet") <= most


def test_vendors_meet_each_way_once(spark):
    words = ["", None, "v", "v12", "v123", "v1234", "v12345", "v124", "shop", "shopone", "v"]
    keys = spark.createDataFrame([(w % 2, k) for w in range(2) for k in words], "wid int, vkey string")
    vendors = keys.where("vkey <> 'v1234'").select("wid", F.col("vkey").alias("vendor_key"))
    wanted = keys.distinct().join(vendors.distinct(), "wid").where(keys_match(F.col("vkey"), F.col("vendor_key"))).select("wid", "vkey", "vendor_key").collect()
    pairs = reconcile.match_vendors(keys, vendors, on=("wid",))
    assert plan(pairs).count("Join") == 2
    assert sorted(pairs.collect()) == sorted(wanted)
    kept, others = (reconcile.of_vendors(keys, vendors, ("wid",), keep) for keep in (True, False))
    hit = {(r[0], r[1]) for r in wanted}
    assert sorted(map(tuple, kept.collect())) == sorted((w, k) for w in range(2) for k in words if (w, k) in hit)
    assert kept.count() + others.count() == keys.count() and "Inner" not in plan(kept)


def test_failed_links_meet_in_more_tasks_as_rows_grow(spark, monkeypatch):
    wanted = sourcing_plans.stand_ins(spark, SF)
    assert "REPARTITION_BY_NUM" not in plan(wanted)
    monkeypatch.setattr(dealing, "TASK_ROWS", 200)
    parts = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 200)
    found = sourcing_plans.stand_ins(spark, SF)
    assert parts > 8 and plan(found).count(f", {parts}), REPARTITION_BY_NUM") >= 6
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
