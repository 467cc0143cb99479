import datetime as dt
import json

from pyspark.sql import functions as F

from larkspur.sources import feeds, pages, sitemaps, tables
from larkspur.streaming import offers

LD = {"@type": "Product", "name": "Bulb", "sku": "B1", "offers": [{"price": "9.99", "priceCurrency": "USD", "availability": "InStock"}, {"price": 5, "priceCurrency": "EUR"}]}
HTML = {
    "ld": f'<title>A &amp; B</title><link rel="canonical" href="https://x.com/b"><script type="application/ld+json">{json.dumps(LD)}</script>',
    "group": '<script type="application/ld+json">' + json.dumps({"@graph": [{"@type": "ProductGroup", "hasVariant": [{"@type": "Product", "name": "V", "offers": {"@type": "AggregateOffer", "lowPrice": "3"}}]}]}) + "</script>",
    "micro": '<span itemprop="price" content="219.00"></span><span itemprop="price" content="219.00">',
    "meta": '<meta content="12.50" property="product:price:amount"><meta property="og:title" content="Lamp">',
    "json": '<script type="application/json">{"a": {"name": "Lamp", "price": {"value": 30}, "sku": "L1"}}</script>',
    "dom": '<span class="was-price">$9.00</span><b class="price">$ 7.25</b>',
    "none": "<p>nothing</p>", "broken": '<script type="application/ld+json">{oops</script>',
}


def test_extract(spark):
    df = spark.createDataFrame([*HTML.items(), ("null", None)], "k string, html string")
    r = {x["k"]: x for x in pages.extract_products(df).collect()}
    got = {k: (x["method"], [o["price"] for o in x["offers"]]) for k, x in r.items()}
    assert got == {
        "ld": ("JSON-LD", [9.99]), "group": ("JSON-LD", [3.0]), "micro": ("microdata", [219.0]), "meta": ("meta tags", [12.5]), "json": ("embedded JSON", [30.0]), "dom": ("visible price", [7.25]),
        "none": (None, []), "broken": (None, []), "null": (None, []),
    }
    assert (r["ld"]["title"], r["ld"]["canonical"]) == ("A & B", "https://x.com/b")


def test_nested_json(spark):
    script = lambda *docs: "".join(f'<script type="application/ld+json">{d if isinstance(d, str) else json.dumps(d)}</script>' for d in docs)
    deep = {"@type": "Product", "name": "deep", "offers": {"price": 4}}
    for _ in range(7):
        deep = {"a": deep}
    variants = [{"@type": "Product", "sku": f"v{i}", "gtin13": "0036000291452", "size": "L", "offers": {"price": f"{i}.50", "shippingDetails": {"shippingRate": {"value": 3}}}} for i in (1, 2)]
    state = {"list": [{"name": "far", "price": 900}, {"title": "near", "currentPrice": "$30.00 /mo", "salePrice": 31, "wasPrice": {"raw": 40}, "stockStatus": "In stock"}, {"name": "coded", "price": 32, "upc": "036000291452"}]}
    html = {
        "deep": script(deep), "too deep": script({"a": {"a": deep}}), "variants": script({"@type": "ProductGroup", "name": "G", "hasVariant": variants, "offers": {"price": 9}}),
        "foreign variants": script({"@type": "Product", "name": "F", "hasVariant": [{"name": "x", "offers": {"price": 1, "priceCurrency": "EUR"}}], "offers": {"price": 9}}), "lowest": script({"@type": "Product", "offers": {"@type": "AggregateOffer", "lowPrice": "5", "offers": []}}),
        "both": script({"@type": "Product", "offers": [{"@type": "AggregateOffer", "lowPrice": "5"}, {"price": 6}]}), "texts": script("{oops", '{"@type": "Product",\n "name": "a\nb", "offers": [{"price": 7},],}', ""), "scalars": script(5, None, [], "[1, [2, {}]]"),
        "state": f'<script id="__NEXT_DATA__" x="y">{json.dumps(state)}</script>', "sold": '<i class="price">$ 19.25</i><p> Sold Out </p>',
    }
    df = pages.extract_products(spark.createDataFrame([*html.items()], "k string, html string"), F.lit(30.0))
    r = {x["k"]: x for x in df.collect()}
    got = {k: ([(o["price"], o["regular"], o["sku"], o["gtin"], o["variant"], o["shipping"], o["availability"], o["lowest"]) for o in x["offers"]], x["name"], x["unread"]) for k, x in r.items()}
    none = lambda p, **k: (p, k.get("regular"), k.get("sku", ""), k.get("gtin"), k.get("variant", ""), k.get("shipping"), k.get("stock", ""), k.get("lowest", False))
    gtin = "00036000291452"
    assert got == {
        "deep": ([none(4.0)], "deep", 0), "too deep": ([], "", 0), "variants": ([none(i + 0.5, sku=f"v{i}", gtin=gtin, variant="L", shipping=3.0) for i in (1, 2)], "G", 0), "foreign variants": ([none(9.0)], "F", 0),
        "lowest": ([none(5.0, lowest=True)], "", 0), "both": ([none(6.0)], "", 0), "texts": ([none(7.0)], "a b", 2), "scalars": ([], "", 0),
        "state": ([none(32.0, gtin=gtin, variant=None)], "coded", 0), "sold": ([none(19.25, sku=None, variant=None, stock="out_of_stock")], "", 0),
    }
    assert r["variants"]["gtins"] == [] and r["state"]["gtins"] == [gtin]
    assert not any(w in df._jdf.queryExecution().executedPlan().toString() for w in ("Python", "Arrow", "Pandas"))


def test_sitemap_frontier(spark):
    import collections
    import gzip
    import re

    urlset = lambda *links: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in links) + "</urlset>"
    index = lambda *links: "<sitemapindex>" + "".join(f"<sitemap><loc><![CDATA[{x}]]></loc></sitemap>" for x in links) + "</sitemapindex>"
    files = {
        "https://a.com/robots.txt": "Sitemap: https://a.com/one.xml\nsitemap:https://a.com/two.xml.gz", "https://a.com/one.xml": index("https://a.com/x.xml", "https://a.com/product.xml", "https://a.com/one.xml", "https://a.com/en-us/y.xml", "https://a.com/gone.xml"),
        "https://a.com/two.xml.gz": gzip.compress(urlset("https://a.com/2").encode()), "https://a.com/x.xml": urlset("https://a.com/x1", "https://a.com/x2?a=1&amp;b=2"), "https://a.com/product.xml": index("https://a.com/deep.xml", "https://a.com/one.xml"),
        "https://a.com/deep.xml": gzip.compress(urlset("https://a.com/deep").encode()), "https://a.com/en-us/y.xml": urlset(), "https://b.com/sitemap.xml": index("https://b.com/bad.gz", "https://b.com/plain.gz", "https://b.com/c.xml"), "https://b.com/bad.gz": b"\x1f\x8bnot",
        "https://b.com/plain.gz": urlset("https://b.com/no"), "https://b.com/c.xml": urlset("https://b.com/c"), "https://c.com/sitemap.xml": index(*(f"https://c.com/{i}.xml" for i in range(9))), **{f"https://c.com/{i}.xml": urlset(f"https://c.com/p{i}") for i in range(9)},
    }

    def brute(domain, limit=6):
        text = lambda u: None if u not in files else files[u] if isinstance(files[u], str) and not u.endswith(".gz") else gzip.decompress(files[u]).decode() if isinstance(files[u], bytes) and files[u][2:] != b"not" else None
        queue = collections.deque(re.findall(r"(?im)^\s*sitemap:\s*(\S+)", text(f"https://{domain}/robots.txt") or "") or [f"https://{domain}/sitemap.xml"])
        seen, visits, links = set(), [], []
        while queue and len(visits) < limit:
            u = queue.popleft()
            if u in seen:
                continue
            seen.add(u)
            visits.append((u, text(u) is not None))
            found = [x.replace("&amp;", "&") for x in re.findall(r"<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]\s]+)", text(u) or "")]
            if "<sitemapindex" in (text(u) or ""):
                queue.extendleft(reversed(sorted(found, key=lambda k: ("product" not in k, not re.search("en[-_]?us|/us/", k)))))
            else:
                links += [(u, x, len(visits), i) for i, x in enumerate(found)]
        return visits, links

    fetched = spark.createDataFrame([(u, b if isinstance(b, bytes) else b.encode()) for u, b in files.items()] + [(None, b"x"), ("https://d.com/sitemap.xml", None)], "url string, body binary")
    sites = ["a.com", "b.com", "c.com", "d.com"]
    found, visits = sitemaps.sitemap_pages(spark.createDataFrame([(d,) for d in [*sites, "a.com", None, ""]], "domain string"), fetched)
    got = sorted((r["domain"], r["visit"], r["map"], r["found"]) for r in visits.collect())
    assert got == sorted((d, i + 1, u, ok) for d in sites for i, (u, ok) in enumerate(brute(d)[0]))
    assert sorted((r["domain"], r["map"], r["link"], r["visit"], r["position"]) for r in found.collect()) == sorted((d, *x) for d in sites for x in brute(d)[1])


def test_page_kinds(spark):
    df = spark.createDataFrame([(200, "Access Denied"), (404, "x"), (None, None), (500, "x"), (200, "fine")], "s int, h string")
    assert [r[0] for r in df.select(pages.outcome(F.col("s"), F.col("h"))).collect()] == ["blocked", "unavailable", "timeout_network", "timeout_network", "success"]


def test_feeds(spark):
    store = {"product": {"title": "Bulb", "vendor": "Hue", "handle": "bulb", "variants": [{"id": 1, "title": "Blue", "sku": "S", "barcode": "036000291452", "price": 1299, "compare_at_price": "15.00", "available": True}, {"id": 2, "title": "Default Title", "price": "x"}]}}
    r = feeds.store_variants(spark.createDataFrame([("u", json.dumps(store)), ("v", "{broken")], "url string, payload string")).collect()
    assert [(x["title"], x["price"], x["regular_price"], x["gtin"]) for x in r] == [("Bulb Blue", 12.99, 15.0, "00036000291452")]
    shopping = {"shopping_results": [{"title": "Used lamp", "source": "Newegg.com - Shop", "price": "$10.00", "extracted_price": 10, "delivery": "Free"}, {"title": "b", "price": "€5"}]}
    r = feeds.shopping_rows(spark.createDataFrame([("q", json.dumps(shopping))], "query string, payload string")).collect()
    assert [(x["vendor"], x["price"], x["shipping"], x["condition"]) for x in r] == [("Newegg.com", 10.0, 0.0, "used")]
    market = {"itemSummaries": [{"itemId": "1", "title": "x", "price": {"value": "4.5", "currency": "USD"}, "seller": {"username": "s", "feedbackPercentage": "99.1", "feedbackScore": 50}, "shippingOptions": [{"shippingCostType": "FREE"}]}, {"price": {"value": "4", "currency": "GBP"}}]}
    r = feeds.market_rows(spark.createDataFrame([("q", json.dumps(market))], "query string, payload string")).collect()
    assert [(x["price"], x["shipping"], x["seller_ok"]) for x in r] == [(4.5, 0.0, True)]
    r = feeds.sitemap_links(spark.createDataFrame([("u", "<urlset><url><loc> https://x.com/a </loc></url><url><loc>https://x.com/b</loc></url></urlset>"), ("n", None)], "url string, xml string")).collect()
    assert [x["link"] for x in r] == ["https://x.com/a", "https://x.com/b"]


def test_tables(spark, tmp_path):
    sheet = spark.createDataFrame([("1", " Lamp ", "Black; !white", "RAYG1US1; cosy", "2.0", "yes", "2Pack"), ("2", " ", "", "", "x", None, None)], "ID string, `Product name` string, `Product Specifications` string, `Search Keywords` string, Quantity string, `Open to used` string, `Bulk Keywords` string")
    r = tables.load_items(sheet).collect()
    assert len(r) == 1 and (r[0]["product"], r[0]["specs"], r[0]["skus"], r[0]["exclude"], r[0]["qty_needed"], r[0]["open_used"], r[0]["bulk_sizes"]) == ("Lamp", ["Black"], ["RAYG1US1"], ["white"], 2, True, [2])
    path = f"file://{tmp_path}/runs"
    for _ in range(2):
        tables.overwrite_runs(spark.createDataFrame([("r1", 1), ("r2", 2)], "run string, v int"), path)
    tables.overwrite_runs(spark.createDataFrame([("r2", 3)], "run string, v int"), path)
    assert sorted((x["run"], x["v"]) for x in spark.read.parquet(path).collect()) == [("r1", 1), ("r2", 3)]
    (tmp_path / "o.jsonl").write_text('{"run": "a", "unit": 1.5}\nbroken\n{"run": "b"}\n')
    assert sorted(x["run"] for x in tables.read_observations(spark, f"file://{tmp_path}/o.jsonl").where("run is not null").collect()) == ["a", "b"]


def test_stream_of_offers(spark, tmp_path):
    t = lambda n: dt.datetime(2024, 1, n)
    schema = "offer_id string, ts timestamp, unit double, in_stock boolean"
    for n, rows in enumerate([[("a", t(1), 10.0, False)], [("a", t(2), 10.0, True), ("b", t(1), None, True)], [("a", t(3), 8.0, True), ("a", t(1), 99.0, True)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    q = offers.offer_events(stream).writeStream.format("memory").queryName("events_of_offers").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = [(r["ts"].day, r["event"]) for r in spark.sql("select * from events_of_offers order by ts").collect()]
    assert got == [(1, "new offer"), (2, "unchanged; back in stock"), (3, "price drop")]


def test_errors_are_rows(spark):
    ld = lambda x: f'<script type="application/ld+json">{x}</script>'
    good = ld('{"@type": "Product", "name": "Lamp", "offers": {"price": "5.00", "priceCurrency": "USD"}}')
    cases = [
        ("ok", 200, good), ("half", 200, ld("{broken") + good), ("bad", 200, ld("{broken") + ld("[1,")), ("none", 200, "<p>words</p>"), ("gone", 404, ld("{broken")),
        ("null", 200, None), ("lost", None, None), ("empty", 200, ""),
    ]
    df = spark.createDataFrame([(*c, "clash") for c in cases], "url string, code int, html string, detail string")
    rows = pages.page_outcomes(pages.extract_products(df), F.col("code"))
    assert {r["url"]: (r["outcome"], r["detail"]) for r in rows.collect()} == {
        "ok": ("success", None), "half": ("success", None), "bad": ("parser_failure", "2 of the page's JSON-LD texts not readable"), "none": ("no_match", "no offer on the page"),
        "gone": ("unavailable", "HTTP 404"), "null": ("no_match", "no offer on the page"), "lost": ("timeout_network", "HTTP none"), "empty": ("no_match", "no offer on the page"),
    }
