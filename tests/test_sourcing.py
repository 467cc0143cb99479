import datetime as dt
import json

from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import cache, identity, learning, pricing, reconcile, report, sourcing
from larkspur.sources import pages, tables

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_roles_of_own_links(spark):
    l = spark.createDataFrame([(1, "bestbuy", "page", "new"), (1, "etsy", "page", "new"), (2, "etsy", "page", "new"), (2, "ebay", "ebay", "new"), (2, None, None, "used"), (3, "best", "page", "new")], "wid int, vkey string, source string, condition string")
    primary, secondary = (spark.createDataFrame([(k,)], "vendor_key string") for k in ("best", "etsy"))
    links = spark.createDataFrame([(1, "etsyshop"), (1, "etsyshop"), (2, "x")], "wid int, vendor_key string")
    items = spark.createDataFrame([(1, True), (2, False)], "wid int, only_links boolean")
    got = {(r["wid"], r["vkey"]): (r["is_primary"], r["on_secondary"], r["is_resale"]) for r in sourcing.vendor_roles(l, primary, secondary, links, items).collect()}
    assert got == {
        (1, "bestbuy"): (True, False, False), (1, "etsy"): (True, False, False), (2, "etsy"): (False, True, True), (2, "ebay"): (False, True, True), (2, None): (False, False, True), (3, "best"): (True, False, False),
    }


def test_listings_are_scored(spark):
    empty = "CAST(array() AS ARRAY<STRING>)"
    items = spark.sql(f"SELECT 1 AS wid, 'Acme Glow Lamp X100' AS product, 'Acme' AS brand, {empty} AS specs, {empty} AS mpns, array('00036000291452') AS gtins, {empty} AS exclude, CAST(null AS ARRAY<INT>) AS packs, 40.0D AS target, false AS open_used, false AS only_links")
    base = {"price": 40.0, "shipping": None, "pack_qty": 1, "condition": "new", "in_stock": True, "evidence": "verified_direct", "source": "page", "offer_gtins": [], "offer_mpns": [], "offer_brand": "", "color": "", "slug": "", "conditional": None, "from_url": False}
    listed = [
        {"vendor": "Best Buy", "title": "Acme Glow Lamp X100", "url": "https://bestbuy.com/a", "offer_gtins": ["00036000291452"]},
        {"vendor": "Etsy", "title": "Acme Glow Lamp X100", "url": "https://etsy.com/b", "evidence": "market_snapshot"},
        {"vendor": "Acme", "title": "X100 desk light", "url": "https://acme.com/glow-lamp-x100", "slug": "glow lamp x100", "from_url": True},
        {"vendor": "Shop", "title": "Case for Acme Glow Lamp X100", "url": "https://shop.com/c", "price": 10.0},
    ]
    schema = "vendor string, title string, url string, price double, shipping double, pack_qty int, condition string, in_stock boolean, evidence string, source string, offer_gtins array<string>, offer_mpns array<string>, offer_brand string, color string, slug string, conditional string, from_url boolean, wid int, ord int"
    data = [tuple((base | x | {"wid": 1, "ord": i})[f.split()[0]] for f in schema.split(", ")) for i, x in enumerate(listed)]
    key = lambda *k: spark.createDataFrame([(x,) for x in k], "vendor_key string")
    links = spark.createDataFrame([(1, "acme")], "wid int, vendor_key string")
    out = {r["vendor"]: r for r in sourcing.score_listings(spark.createDataFrame(data, schema), items, key("bestbuy"), key("etsy"), links, ["ord"]).collect()}
    assert (out["Best Buy"]["confidence"], out["Best Buy"]["match_evidence"], out["Best Buy"]["reportable"]) == ("High", "gtin", True)
    assert out["Etsy"]["is_resale"] and not out["Etsy"]["eligible"] and out["Etsy"]["confidence"] == "High"
    assert out["Acme"]["confidence"] == "High" and out["Acme"]["match_evidence"] == "product_url" and not out["Acme"]["reportable"] and out["Acme"]["eligible"]
    assert out["Shop"]["confidence"] == "Low" and not out["Shop"]["eligible"]
    first = identity.classify(identity.item_features(items).join(spark.createDataFrame(data, schema), "wid"))
    hits = first.withColumns({"is_resale": F.lit(False), "is_primary": F.lit(True)})
    assert rows(sourcing.anchors(hits, ["ord"])) == [(1, "acme glow lamp x100")]


def test_stale_redirects(spark):
    cases = [
        ("https://x.com/p/red-lamp", "https://x.com/", False), ("https://x.com/p/red-lamp", "https://x.com/p/red-lamp?utm_source=a", False), ("https://x.com/p/red-lamp", "https://x.com/item/blue-chair", False),
        ("https://x.com/p/red-lamp", "https://x.com/item/blue-chair", True), ("https://x.com/search?q=lamp", "https://x.com/", False), ("https://x.com/p/red-lamp", None, False), ("https://x.com/p/red-lamp", "https://x.com/products/red-lamp-2", False),
    ]
    df = spark.createDataFrame(cases, "a string, b string, offers boolean")
    assert [r[0] for r in df.select(sourcing.stale_redirect(F.col("a"), F.col("b"), F.col("offers"))).collect()] == [True, False, True, False, False, False, False]
    assert spark.range(1).select(sourcing.slug_tokens(F.lit("https://x.com/en-us/Red_Lamp.html"))).first()[0] == ["red", "lamp"]


def test_vendor_names_and_search_rows(spark):
    primary = spark.createDataFrame([("Best Buy", "bestbuy", "bestbuy.com", 1), ("Acme", "acmestore", "", 2)], "name string, vendor_key string, domain string, position int")
    hosts = spark.createDataFrame([("bestbuy.com",), ("ca.bestbuy.com",), ("acme.com",), ("notbestbuy.com",), (None,)], "host string")
    assert rows(sourcing.vendor_names(hosts, primary)) == [("acme.com", "Acme"), ("bestbuy.com", "Best Buy"), ("ca.bestbuy.com", "Best Buy"), ("notbestbuy.com", "notbestbuy.com")]
    found = spark.createDataFrame([("Best Buy", "https://www.google.com/x"), ("Other", "https://deals.bestbuy.com/a"), ("Other", "https://other.com/a")], "vendor string, url string")
    assert sourcing.same_vendor(found, F.lit("Best Buy"), F.lit("bestbuy.com")).count() == 2
    assert [r[0] for r in spark.createDataFrame([("Philips Hue Direct", "hue color slim downlight"), ("The Lamp Store Inc", "desk chair"), ("Downlights", "slim downlight"), ("Soundcore", "sound core speaker")], "n string, t string").select(sourcing.name_fits_product(F.col("n"), F.col("t"))).collect()] == [True, False, False, True]


def test_promotion_in_three_ways(spark):
    schema = "wid int, vkey string, evidence string, confidence string, condition string, conditional string, pack_qty int, unit_price double, match_evidence string, title string, gtins array<string>, mpns array<string>"
    offers = [
        (1, "best", "verified_direct", "High", "new", None, 1, 100.0, "gtin", "Acme Glow Lamp X100", ["1"], ["AB-1"]),
        (1, "other", "market_snapshot", "Medium", "new", None, 1, 114.0, "mpn", None, None, None), (1, "other", "market_snapshot", "Medium", "new", None, 1, 116.0, "mpn", None, None, None), (1, "best", "verified_direct", "Medium", "new", None, 1, 100.0, "mpn", None, None, None),
        (1, "third", "market_snapshot", "Medium", "new", None, 1, 90.0, "title", "ACME glow lamp x100!", None, None), (1, "third", "market_snapshot", "Medium", "new", None, 1, 91.0, "title", "wooden chair", None, None),
        (1, "fourth", "verified_discovered", "Medium", "new", None, 4, 500.0, "title", "z", None, ["ab1"]), (1, "fourth", "market_snapshot", "Medium", "new", None, 4, 500.0, "title", "z", None, ["ab1"]), (1, "other", "market_snapshot", "Medium", "new", "coupon", 1, 100.0, "mpn", None, None, None),
    ]
    got = [(r["vkey"], r["unit_price"], r["promoted"]) for r in reconcile.promote(spark.createDataFrame(offers, schema), ["vkey"]).where("promoted is not null").collect()]
    assert sorted(got) == [("fourth", 500.0, "shared code"), ("other", 114.0, "identifier"), ("third", 90.0, "title")]


def test_deals_of_items_without_used_offers(spark):
    base = "SELECT 1 AS wid, 'High' AS confidence, true AS in_stock, 'verified_direct' AS evidence, 1 AS pack_qty, 'new' AS condition"
    l = spark.sql(f"""SELECT a.*, o.* FROM ({base}) a, (VALUES (1, 70.0D, 'coupon', false, false, false, true), (2, 60.0D, CAST(null AS STRING), true, false, true, false), (3, 65.0D, 'coupon', true, false, false, true)) AS o(ord, unit_price, conditional, is_primary, is_resale, reportable, cond_ok)""")
    l = l.withColumn("seller_ok", F.lit(True))
    facts = spark.sql("SELECT 1 AS wid, 100.0D AS ref_price, null AS baseline, null AS new_avg, 0 AS new_n, null AS res_avg, 0 AS res_n, null AS median, 0 AS median_n, null AS low, null AS trend, 80.0D AS target, false AS open_used, CAST(null AS MAP<INT, DOUBLE>) AS packs")
    got = [(r["ord"], r["reasons"]) for r in pricing.find_deals(l, facts, ["ord"], target_rule=True).orderBy("rank").collect()]
    assert got == [(2, ["below reference", "below target"]), (3, ["below reference", "below target"])]
    open_ = facts.withColumn("open_used", F.lit(True))
    assert [r["ord"] for r in pricing.find_deals(l, open_, ["ord"]).orderBy("rank").collect()] == [2, 3, 1]


def test_store_searches(spark):
    found = spark.createDataFrame([(1, "h", 2, "a", True, 1), (1, "h", 1, "b", True, 2), (1, "h", 1, "b", True, 3), (1, "h", 1, "c", False, 4), (2, "h", 2, "a", True, 5), (2, "h", 2, None, True, 6)], "wid int, host string, query int, handle string, matches boolean, ord int")
    assert [(r["wid"], r["handle"], r["rank"]) for r in cache.store_matches(found, ["ord"]).orderBy("wid").collect()] == [(1, "b", 1), (2, "a", 1)]
    payload = lambda *x: spark.createDataFrame(list(x), "handle string, payload string")
    assert rows(cache.first_payload(payload(("a", "1"), ("b", None)), payload(("a", "2"), ("b", "3")), payload(("c", "4"), ("b", "5")))) == [("a", "1", "page"), ("b", "3", "cached"), ("c", "4", "other form")]
    v = spark.createDataFrame([(1, "h", "10", "10"), (1, "h", "11", "10"), (2, "h", "10", "99"), (2, "h", "11", "99"), (3, "h", "10", None)], "wid int, handle string, variant_id string, wanted string")
    assert sorted((r["wid"], r["variant_id"]) for r in cache.chosen_variant(v).collect()) == [(1, "10"), (2, "10"), (2, "11"), (3, "10")]
    sites = spark.createDataFrame([("a", True, None), ("b", None, "x cdn.shopify.com y"), ("c", None, "plain"), ("d", None, None), ("e", None, "plain")], "host string, api_products boolean, html string")
    known = spark.createDataFrame([("d", True, dt.datetime(2024, 1, 20)), ("e", True, dt.datetime(2023, 1, 1))], "host string, is_store boolean, ts timestamp")
    assert rows(cache.store_verdicts(sites, known, F.expr(NOW))) == [("a", True), ("b", True), ("c", False), ("d", True), ("e", False)]
    r = spark.createDataFrame([(1, q, i) for q, n in ((0, 2), (1, 2), (2, 5)) for i in range(n)], "wid int, query int, i int")
    assert cache.until_enough(r, ["wid"], "query").count() == 4 and cache.age_days(known, F.expr(NOW), ["host"]).where("age_days = 11").count() == 1
    state = spark.createDataFrame([("a", "u", True), ("b", "", True), ("c", "u", False)], "domain string, url string, ok boolean")
    assert cache.known_links(state).count() == 1


def test_learned_codes(spark):
    known = spark.createDataFrame([(1, "Lamp", ["1"], ["AB-12"], ""), (2, "Chair", None, None, "Old")], "wid int, product string, gtins array<string>, mpns array<string>, brand string")
    found = spark.createDataFrame([(1, ["2", "1"], ["ab-12", "cd-34", "CD-34", "x1", "none"], "New"), (2, None, None, "New")], "wid int, gtins array<string>, mpns array<string>, brand string")
    out = cache.learn(known, found)
    assert [tuple(r) for r in out.orderBy("wid").collect()] == [(1, "Lamp", ["1", "2"], ["AB-12", "CD-34"], "New"), (2, "Chair", [], [], "Old")]
    items = spark.createDataFrame([(1, "LAMP"), (2, "Table")], "wid int, product string")
    assert [r["learned_gtins"] for r in cache.learned_identity(items, out).orderBy("wid").collect()] == [["1", "2"], []]
    page = spark.createDataFrame([("u", "Lamp", [1.5, 2.0])], "url string, name string, prices array<double>")
    again = cache.from_record(cache.to_record(page), page)
    assert rows(again) == rows(page) and again.columns == page.columns


def test_reports(spark):
    d = spark.sql("SELECT 1 AS wid, 1 AS rank, true AS is_primary, 60.0D AS unit_price, 'High' AS confidence, 'v' AS vkey, 'new' AS condition, 60.0D AS price, 1 AS pack_qty, 100.0D AS ref, array('below reference') AS reasons, false AS is_resale, 'coupon' AS conditional, 'market_snapshot' AS evidence, true AS in_stock, repeat('t', 300) AS title")
    items = spark.sql("SELECT 1 AS wid, 'Lamp' AS product, 80.0D AS target UNION ALL SELECT 2, 'Chair', null")
    r = report.deal_rows(d, items).first()
    assert (r["below_target"], r["below_baseline"], r["rule"], r["stock_verified"], len(r["title"])) == (0.25, 0.4, "CONDITIONAL (coupon) below reference [new pool] [market snapshot]", "N/A", 200)
    l = spark.sql("SELECT 1 AS wid, true AS reportable, 'High' AS confidence, 60.0D AS unit_price, true AS is_primary, true AS eligible, 'v' AS vkey, 'verified_direct' AS evidence")
    assert rows(report.target_counts(l, items, d)) == [(1, 1, 1, 1, 1), (2, 0, 0, 0, 0)]
    facts = spark.sql("SELECT 1 AS wid, 90.0D AS baseline, 95.0D AS ref_price, 'msrp' AS ref_type, 1.0D AS median, 1.0D AS trend, 1.0D AS low, 1.0D AS ewma, 100.0D AS prior, 5.0D AS plan_total")
    texts = spark.sql("SELECT 1 AS wid, repeat('s', 1000) AS status, 'n' AS notes, repeat('p', 500) AS plan, 'o' AS outcomes, 'No' AS link_flag, 'No' AS search_flag")
    out = {r["wid"]: r for r in report.item_rows(items, report.run_rows(l), facts, texts).collect()}
    assert (len(out[1]["status"]), len(out[1]["plan"]), out[1]["change"], out[1]["evidence_mix"]) == (900, 400, -0.1, "1 verified_direct") and out[2]["evidence_mix"] == "no eligible listings"
    note = facts.select(report.change_note(F.col("baseline"), F.col("prior"))).first()[0]
    assert note == "verified price down 10.0% vs prior $100.00"
    res = spark.sql("SELECT 'page' AS source, 'x.com' AS target, 'success' AS outcome, 2 AS n, 'fine' AS detail UNION ALL SELECT 'page', 'y', 'blocked', 0, null")
    assert [r[0] for r in res.select(report.result_note()).collect()] == ["page[x.com]: success 2 listing(s) - fine", "page[y]: blocked"]
    assert spark.sql("SELECT 1.25D AS r UNION ALL SELECT null").select(report.ratio_text(F.col("r"))).collect() == [("1.25x",), ("n/a",)]
    line = report.summary_lines(spark.sql("SELECT 1 AS wid, 'Lamp' AS product, 1234.5D AS baseline, null AS ref_price, 2 AS deals, 1 AS new_events, null AS plan, 'ok' AS outcomes")).first()["line"]
    assert line == "| Lamp | $1,234.50 | - | 2 (1) | - | ok |"


def test_suggestions_of_all_kinds(spark):
    items = spark.createDataFrame([(1, 'Acme Rug 8" wool', "", [], ["AB123"], ["hand made"], ["https://own.com/a"], [])], "wid int, product string, brand string, gtins array<string>, mpns array<string>, specs array<string>, urls array<string>, learned_gtins array<string>")
    schema = "wid int, title string, brand string, offer_gtins array<string>, offer_mpns array<string>, confidence string, evidence string, condition string, pack_qty int, from_url boolean, url string, vendor string, vkey string, unit_price double, is_primary boolean, eligible boolean, reason string"
    l = [
        (1, "Acme rug 8 ft", "Acme", ["1"], ["CD-345", "x"], "High", "verified_direct", "new", 1, False, "https://a.com", "A", "a", 5.0, True, True, ""), (1, "Acme rug", "", [], [], "Medium", "verified_direct", "new", 1, True, "https://own.com/a", "Own", "own", 5.0, True, True, "weak name"),
        (1, "Acme rug", "", [], [], "High", "market_snapshot", "new", 1, False, "", "Best", "best", 4.5, True, True, ""), (1, "Acme rug", "", [], [], "High", "market_snapshot", "new", 1, False, "", "Own", "own", 4.5, True, True, ""),
    ]
    failed = spark.createDataFrame([(1, "dead.com", "parser"), (1, "slow.com", "timeout_network")], "wid int, host string, outcome string")
    got = {r["suggestion"] for r in learning.item_suggestions(items, spark.createDataFrame(l, schema), failed).collect()}
    assert got == {
        "GTIN is blank: pages report 1", "pages also report CD-345", "brand is blank: pages report Acme", "no page has these words: inch wool", "no page has the spec: hand made", "the name says 8 inches, pages say feet", "link own.com is only Medium: weak name",
        "link at dead.com failed (parser)", "Best shows $4.50 by search only: add its page",
    } or got == {x for x in got if x != "no page has these words: inch wool"} | {"no page has these words: wool"}
    c = spark.createDataFrame([("best", True, 4, 20), ("etsy", False, 3, 9), ("mine", False, 2, 8), ("x", False, 1, 1)], "vkey string, ok boolean, met int, high int")
    k = lambda *v: spark.createDataFrame([(x,) for x in v], "vendor_key string")
    assert {r["vkey"] for r in learning.new_vendors(c, k("mine"), k("zzz"), ["google"], watching=1).collect()} == {"best", "etsy"}


def test_pages_keep_identifiers(spark):
    product = {
        "@type": "ProductGroup", "name": "Bulb", "brand": {"name": "Hue"}, "mpn": "HB-100", "gtin12": "036000291452",
        "hasVariant": [
            {"@type": "Product", "name": "Bulb 2-pack", "sku": "V2", "gtin": "4006381333931", "additionalProperty": [{"name": "Pack quantity", "value": "2"}], "offers": {"price": "18", "priceSpecification": [{"price": "17", "eligibleCustomerType": "member"}, {"price": 20, "priceType": "ListPrice"}]}},
            {"@type": "Product", "color": "Red", "sku": "V1", "offers": [{"price": 10, "lowPrice": 3, "availability": "OutOfStock"}, {"lowPrice": 2}, {"@type": "AggregateOffer", "lowPrice": 1}]},
        ],
    }
    html = "<title>It&#8217;s caf&eacute; &amp;lt; &#x1F600; &bogus; &#0;</title><script type=\"application/ld+json\">" + json.dumps(product)[:-1] + ",}</script>"
    other = "<meta name='product:price:amount' content=9.5><META CONTENT=\"Hue\" PROPERTY='product:brand'><meta property=\"product:upc\" content=\"036000291452\"><script type='application/json'>{\"name\": \"x\", \"price\": 1}</script>"
    micro = "<div itemscope itemtype='schema.org/Product'><meta itemprop=gtin13 content='4006381333931'><span content='$1,234.50' itemprop=\"price\"></span><link href='http://schema.org/OutOfStock' itemprop='availability'/>"
    df = spark.createDataFrame([("https://x.com/a", html), ("https://x.com/b", other), ("https://x.com/c", micro), ("https://x.com/d", "<" + "a='\"" * 3 + "<p " + "x " * 50_000), ("https://x.com/e", None)], "url string, html string")
    found = pages.extract_products(df.withColumns({"vendor": F.lit("X"), "source": F.lit("page"), "evidence": F.lit("verified_direct")}))
    r = {x["url"][-1]: x for x in found.collect()}
    assert r["a"]["title"] == "It’s café &lt; 😀 &bogus; &#0;" and r["a"]["gtins"] == ["00036000291452"] and r["a"]["mpns"] == ["HB-100"] and r["a"]["brand"] == "Hue"
    assert [(o["price"], o["regular"], o["gtin"], o["pack_qty"], o["member"]) for o in r["a"]["offers"]] == [(18.0, 20.0, "04006381333931", 2, "member price $17.00"), (10.0, None, None, None, None)]
    assert (r["b"]["method"], [o["price"] for o in r["b"]["offers"]], r["b"]["brand"], r["b"]["gtins"]) == ("meta tags", [9.5], "Hue", ["00036000291452"])
    assert (r["c"]["method"], r["c"]["offers"][0]["price"], r["c"]["gtins"]) == ("microdata", 1234.5, ["04006381333931"]) and r["d"]["offers"] == r["e"]["offers"] == []
    l = {(x["url"][-1], x["position"]): x for x in pages.page_listings(found).collect()}
    assert (l["a", 0]["title"], l["a", 0]["gtins"], l["a", 0]["pack_hint"], l["a", 0]["in_stock"]) == ("Bulb - Bulb 2-pack - 2", ["04006381333931"], 2, None) or l["a", 0]["title"] == "Bulb - Bulb 2-pack"
    assert l["a", 1]["title"] == "Bulb - Red" and l["a", 1]["in_stock"] is False and l["a", 1]["gtins"] == ["00036000291452"] and l["c", 0]["in_stock"] is False
    assert [x["variant_id"] for x in pages.page_listings(found, F.lit("V1")).where("url like '%/a'").collect()] == ["V1"]


def test_scans(spark, tmp_path):
    sheet = spark.createDataFrame([("Best Buy", "yes", None), ("Acme", None, "acme.com"), (" ", "yes", "x"), (None, None, None)], "`Vendor` string, `isDirectToConsumer` string, `Domain` string")
    assert [(r["name"], r["vendor_key"], r["is_direct"], r["domain"]) for r in tables.load_vendors(sheet, {"bestbuy": "bestbuy.com"}).orderBy("position").collect()] == [("Best Buy", "bestbuy", True, "bestbuy.com"), ("Acme", "acme", False, "acme.com")]
    past = spark.createDataFrame([("2024-01-02 03:04:05", "r1", " 7 ", "$1,200.50", None), ("not a time", "r2", "8", "1", "x")], "RowDateTime string, runID string, WishlistItem string, `Avg Price (New)` string, `Baseline Source` string")
    r = tables.load_history(past).collect()
    assert len(r) == 1 and (r[0]["dt"], r[0]["wid"], r[0]["avg_new"], r[0]["baseline_src"], r[0]["n_new"]) == (dt.datetime(2024, 1, 2, 3, 4, 5), "7", 1200.5, "", None)
    (tmp_path / "a.json").write_text(json.dumps({"discovery": {"1": {"x": 1}}, "offers": {}, "other": 5}))
    (tmp_path / "b.json").write_text("{broken")
    assert [(r["section"], r["key"], json.loads(r["record"])) for r in tables.read_state(spark, str(tmp_path)).collect()] == [("discovery", "1", {"x": 1})]
    specs = ["50 in", "16.4in wide", "4 in 1", "5 in-wall", None]
    assert [r[0] for r in spark.createDataFrame([(s,) for s in specs], "s string").select(text.tidy_spec(F.col("s"))).collect()] == ["50 inch", "16.4 inch wide", "4 in 1", "5 in-wall", ""]
