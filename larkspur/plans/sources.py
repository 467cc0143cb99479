"""Sources, identity and report operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import similarity, text
from larkspur.functions.tasks import spread
from larkspur.operators import identity, learning, links, reconcile
from larkspur.plans.offers import LISTINGS_SQL, candidates, listings, table
from larkspur.plans.offers import QUERIES as OFFERS
from larkspur.sources import feeds, pages, sitemaps
from larkspur.sources.structured import STATE_PRICES
from larkspur.sources.tables import load_items


def shopping(spark, sf):
    """Shopping results made of parts, read back from their JSON."""
    p = table(spark, sf, "part")
    result = F.struct(
        F.col("p_name").alias("title"), F.concat("p_brand", F.lit(" - seller")).alias("source"), F.concat(F.when(F.col("p_partkey") % 7 == 0, "CA$").otherwise("$"), F.col("p_retailprice").cast("decimal(10,2)").cast("string")).alias("price"),
        F.when(F.col("p_partkey") % 3 == 0, "Free delivery").otherwise("+ $4.50 shipping").alias("delivery"), F.when(F.col("p_partkey") % 5 == 0, "used").alias("second_hand_condition"), F.when(F.col("p_partkey") % 4 == 0, "Clip coupon").alias("tag"),
    )
    payloads = p.select(F.col("p_partkey").cast("string").alias("query"), F.to_json(F.struct(F.array(result).alias("shopping_results"))).alias("payload"))
    return feeds.shopping_rows(payloads).select("query", "title", "vendor", "price", "shipping", "condition", "conditional")


def store(spark, sf):
    """Store products made of parts, with one to four variants, read back from their JSON."""
    p = table(spark, sf, "part")
    variants = F.transform(F.sequence(F.lit(1), F.col("p_size") % 4 + 1), lambda i: F.struct(i.cast("string").alias("id"), F.when(i == 1, "Default Title").otherwise(F.concat(F.lit("Size "), i.cast("string"))).alias("title"), (F.floor(F.col("p_retailprice") * 100 + 0.5) * i).cast("string").alias("price"), (i % 2 == 0).alias("available")))
    payloads = p.select(F.col("p_partkey").cast("string").alias("url"), F.to_json(F.struct(F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("vendor"), variants.alias("variants")).alias("product"))).alias("payload"))
    return feeds.store_variants(payloads).select("url", "ord", "title", "vendor", "price", "in_stock")


def kinds(spark, sf):
    p = table(spark, sf, "part")
    words = F.array(*map(F.lit, ["with coupon", "Prime member", "subscribe", "$9/mo", "trade-in", "plain", "InStock", "sold out"]))
    t = F.concat("p_name", F.lit(" "), F.get(words, (F.col("p_partkey") % 8).cast("int")))
    return p.select("p_partkey", text.conditional_kind(t)["kind"].alias("kind"), text.availability(t)["label"].alias("availability"), text.schema_condition(t).alias("condition"))


def circuits(spark, sf):
    e = table(spark, sf, "events").where("event_type <> 'signup'")
    outcome = F.when(F.col("event_type") == "error", "blocked").when(F.col("event_type") == "view", "timeout_network").when(F.col("event_type") == "click", "no_match").otherwise("success")
    a = e.select(F.concat(F.lit("d"), (F.col("user_id") % 40).cast("string")).alias("domain"), "ts", F.col("event_id").alias("ord"), outcome.alias("outcome"))
    return learning.circuit_states(a).select("domain", "ord", "streak", "open")


def client(spark, sf):
    e = table(spark, sf, "events")
    a = e.select(F.concat(F.lit("d"), (F.col("user_id") % 40).cast("string")).alias("domain"), "ts", F.col("event_type").alias("client"), F.when(F.col("value") > 20, "success").otherwise("blocked").alias("outcome"))
    return learning.best_client(a)


def report(spark, sf):
    return learning.candidate_lines(candidates(spark, sf))


def ids(spark, sf):
    l = listings(spark, sf).withColumns({"vendor": F.col("vkey"), "merchant_item_id": F.concat(F.lit("m"), F.col("orderkey").cast("string")), "url": F.lit(None).cast("string"), "source": F.lit("page"), "title": F.lit("t"), "variant_id": F.lit(None).cast("string"), "variant": F.lit('Blue 4"')})
    return l.select("orderkey", "linenumber", "suppkey", reconcile.offer_id().alias("offer_id"))


def _pairs(spark, sf):
    p = table(spark, sf, "part")
    empty = F.array().cast("array<string>")
    name = F.concat_ws(" ", F.regexp_replace("p_brand", "#", "x"), "p_name")
    code = F.array(F.concat(F.lit("MDL"), (F.col("p_partkey") + 1000).cast("string")))
    items = p.select(F.col("p_partkey").alias("wid"), name.alias("product"), F.regexp_replace("p_brand", "#", "x").alias("brand"), empty.alias("specs"), code.alias("mpns"), empty.alias("gtins"), empty.alias("exclude"))
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("wid"), "l_suppkey").distinct()
    kind = F.when(F.col("l_suppkey") % 5 == 0, "case").when(F.col("l_suppkey") % 5 == 1, "Pro").when(F.col("l_suppkey") % 5 == 2, "MDL").otherwise("2-pack")
    offers = l.join(p, F.col("wid") == F.col("p_partkey")).select(
        "wid", "l_suppkey", F.concat_ws(" ", name, kind).alias("title"), F.when(F.col("l_suppkey") % 3 == 0, code).otherwise(empty).alias("offer_mpns"), empty.alias("offer_gtins"), F.lit(1).alias("pack_qty"), F.lit("").alias("color")
    )
    return items, offers


def identities(spark, sf):
    """Offers of parts against them; names are plain words, so only codes, accessory and variant words differ."""
    return identity.classify_offers(*_pairs(spark, sf)).select("wid", "l_suppkey", "confidence", "reason", "match_evidence")


def products(spark, sf):
    p = pages.extract_products(table(spark, sf, "pages"))
    return p.select("page_id", "title", "canonical", "method", F.size("offers").alias("n_offers"))


def ratio(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.floor(similarity.sequence_ratio(F.col("p_name"), F.col("p_type")) * 10000).cast("long").alias("ratio"))


def ranked_links(spark, sf):
    found = pages.links(table(spark, sf, "pages"))
    word = F.regexp_extract("link", r"/([^/?#]+)$", 1)
    return links.rank_links(found.select(F.col("url").alias("wid"), F.lit("site").alias("domain"), "link", word.alias("product"), F.lit(None).cast("array<string>").alias("codes")), 1).select("wid", "link")


def searches(spark, sf):
    p = table(spark, sf, "part")
    return links.search_query(p.select("p_partkey", F.col("p_name").alias("product"), F.array("p_type").alias("mpns"), F.array(F.regexp_replace("p_brand", "#", "")).alias("specs"))).select("p_partkey", "query")


def product_pages(spark, sf):
    """Listings of pages with JSON-LD products of three offers, two of them equal."""
    p = spread(table(spark, sf, "part"), "p_partkey")
    one = lambda price, sku, condition: F.struct(price.alias("price"), F.lit("USD").alias("priceCurrency"), F.lit("https://schema.org/InStock").alias("availability"), F.lit(sku).alias("sku"), F.lit(condition).alias("itemCondition"))
    price = F.col("p_retailprice")
    node = F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("brand"), F.lit("036000291452").alias("gtin12"), F.array(one(price, "A", "NewCondition"), one(price, "A", "NewCondition"), one(price + 1, "B", "UsedCondition")).alias("offers"))
    html = F.concat(F.lit("<title>T &eacute;&#8217;</title><script type='application/ld+json'>"), F.to_json(node), F.lit("</script>"))
    found = pages.extract_products(p.select(F.concat(F.lit("https://x.com/p/"), "p_partkey").alias("url"), F.lit("X").alias("vendor"), F.lit("page").alias("source"), F.lit("verified_direct").alias("evidence"), html.alias("html")))
    return pages.page_listings(found).select("url", "position", "title", "price", "condition", "in_stock", "merchant_item_id", F.array_join("gtins", ",").alias("gtins"), "brand", "method")


def structured(spark, sf):
    """The first offer of pages in six shapes: one offer, variants with packs, nested aggregates, list and member prices, a page state under each of its price keys, and JSON that can't be read."""
    p = spread(table(spark, sf, "part"), "p_partkey").select("p_partkey", "p_name", "p_brand", F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("price"), F.col("p_size").cast("string").alias("n"))
    keys = F.array(*map(F.lit, STATE_PRICES))
    key = F.element_at(keys, (F.col("p_partkey") % len(STATE_PRICES)).cast("int") + 1)
    text = lambda template, *cs: F.format_string(template, *cs)
    shapes = [
        text('{"@context": "x", "@graph": [{"@type": "WebSite"}, {"@type": ["Product", "Thing"], "name": "%s", "brand": {"name": "%s"}, "offers": {"price": "%s", "priceCurrency": "USD", "sku": "S%s"},}]}', "p_name", "p_brand", "price", "n"),
        text('{"@type": "ProductGroup", "name": "%s", "brand": "%s", "offers": {"price": 1}, "hasVariant": [{"@type": "Product", "sku": "V%s", "color": "red", "additionalProperty": [{"name": "Pack quantity", "value": "%s"}], "offers": [{"price": %s}]}]}', "p_name", "p_brand", "n", "n", "price"),
        text('{"mainEntity": {"@type": "Product", "name": "%s", "manufacturer": "%s", "offers": {"@type": "AggregateOffer", "lowPrice": 1, "offers": [{"@type": "AggregateOffer", "offers": [{"price": "$%s", "priceCurrency": "USD", "sku": "A%s"}]}, {"price": 2, "priceCurrency": "EUR"}]}}}', "p_name", "p_brand", "price", "n"),
        text('[{"@type": "Product", "name": "%s", "brand": [{"name": "%s"}], "sku": "no", "offers": {"sku": "P%s", "priceSpecification": [{"price": "99,999.00", "priceType": "https://schema.org/ListPrice"}, {"price": 0.5, "validForMemberTier": {"name": "gold"}}, {"price": %s, "priceCurrency": "USD"}]}}]', "p_name", "p_brand", "n", "price"),
    ]
    state = text('{"props": {"items": [{"price": 3}, {"productName": "%s", "skuId": "J%s", "%s": {"value": {"amount": "%s"}}, "msrp": "1,000,000", "clubPrice": 0.5}]}}', "p_name", "n", key, "price")
    shape = F.col("p_partkey") % 6
    ld = F.when(shape == 0, shapes[0]).when(shape == 1, shapes[1]).when(shape == 2, shapes[2]).when(shape == 3, shapes[3]).otherwise("{broken")
    html = F.when(shape == 4, F.concat(F.lit("<script>window.__STATE__ = "), state, F.lit(";</script>"))).otherwise(F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>")))
    found = pages.extract_products(p.withColumn("html", html))
    o = F.get("offers", F.lit(0))
    return found.select("p_partkey", "method", F.size("offers").alias("n_offers"), "name", "brand", o["price"].alias("price"), o["regular"].alias("regular"), o["sku"].alias("sku"), o["pack_qty"].alias("pack"), o["member"].alias("member"), "unread")


def site_maps(spark, sf):
    """Pages of a site for each region, found through its index of maps of nations, which names itself too; every second site has a robots file."""
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    domain = F.concat(F.lit("r"), "n_regionkey", F.lit(".com"))
    start = F.concat(F.lit("https://"), domain, F.when(F.col("n_regionkey") % 2 == 0, "/index.xml").otherwise("/sitemap.xml"))
    own = F.concat(F.lit("https://"), domain, F.when(F.col("n_nationkey") % 2 == 0, "/product-").otherwise("/n"), "n_nationkey", F.lit(".xml"))
    n = n.select("n_nationkey", "n_regionkey", domain.alias("domain"), start.alias("start"), own.alias("map"))
    loc = lambda c: F.concat(F.lit("<x><loc> "), c, F.lit("</loc></x>"))
    joined = lambda key, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), c.alias("c")))), lambda x: x["c"]), "")
    robots = n.where("n_regionkey % 2 = 0").select(F.concat(F.lit("https://"), "domain", F.lit("/robots.txt")).alias("url"), F.concat(F.lit("User-agent: *\nSitemap: "), "start", F.lit("\n")).alias("body")).distinct()
    index = n.groupBy(F.col("start").alias("url")).agg(F.concat(F.lit("<sitemapindex>"), loc(F.first("start")), joined("n_nationkey", loc(F.col("map"))), F.lit("</sitemapindex>")).alias("body"))
    maps = n.join(s, F.col("n_nationkey") == F.col("s_nationkey")).withColumn("page", F.concat(F.lit("https://"), "domain", F.lit("/p?a=1&amp;s="), "s_suppkey")).groupBy(F.col("map").alias("url")).agg(F.concat(F.lit("<urlset>"), joined("s_suppkey", loc(F.col("page"))), F.lit("</urlset>")).alias("body"))
    fetched = robots.unionByName(index).unionByName(maps).withColumn("body", F.col("body").cast("binary"))
    return sitemaps.sitemap_pages(n.select("domain"), fetched)[0]


#: Queries and their SQL; None where SQL can't express them, which tests then cover.
def item_sheet(spark, sf):
    """Parts as rows of a sheet of wanted items, with what was learned of those of more than size 10."""
    p, size, kind = table(spark, sf, "part"), F.col("p_size").cast("string"), F.col("p_type")
    wid = F.col("p_partkey").cast("string")
    sheet = spread(p, "p_partkey").select(
        wid.alias("WishlistItem"), F.concat(F.lit(" "), "p_name").alias("Product"), F.concat(size, F.lit(" in; "), size, F.lit(" inch; !"), "p_brand", F.lit("; ! "), F.lower("p_brand")).alias("Product Specifications"),
        F.concat(F.lit("X"), F.lpad(wid, 8, "0"), F.lit("; "), kind).alias("Search Keywords"), F.concat(F.lit("$"), F.col("p_retailprice").cast("decimal(10,2)").cast("string")).alias("Target Price"), size.alias("Quantity Needed"),
        F.when(kind.isin("PROMO", "LARGE"), "Yes").alias("Is Bulk Option"), F.when(kind == "PROMO", F.concat(size, F.lit("; 2Pack"))).alias("Bulk Keywords"), F.when(kind.isin("SMALL", "LARGE"), "yes").alias("Only Check Primary Links"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("https://X.com/p?utm_source=a&id="), wid, F.lit("; https://x.com/p?id="), wid)).alias("Product URLs"), F.when(kind == "SMALL", "4006381333931; 12345").alias("GTIN/UPC"), F.lit("m-5").alias("MPN"),
        F.when(kind != "PROMO", F.col("p_brand")).alias("Brand"), F.when(kind == "ECONOMY", "2.0").alias("Priority"),
    )
    known = p.select(wid.alias("wid"), F.when(F.col("p_size") > 10, F.upper("p_name")).otherwise("another name").alias("product"), F.array(F.lit("00000000000017")).alias("gtins"), F.array(F.concat(F.lit("M-"), size)).alias("mpns"), kind.alias("brand"))
    lists = ("specs", "keywords", "skus", "exclude", "mpns", "gtins", "urls")
    items = load_items(sheet, known)
    return items.select("wid", "product", *[F.array_join(c, "|").alias(c) for c in lists], "brand", "qty_needed", "target", "priority", F.array_join("packs", ",").alias("packs"), "only_links", "links_only_fallback")


QUERIES: dict[str, tuple] = {
    "shopping_feed": (shopping, """SELECT CAST(p_partkey AS VARCHAR) AS query, p_name AS title, p_brand AS vendor, CAST(CAST(p_retailprice AS DECIMAL(10, 2)) AS DOUBLE) AS price, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE 4.5 END::DOUBLE AS shipping,
      CASE WHEN p_partkey % 5 = 0 THEN 'used' ELSE 'new' END AS condition, CASE WHEN p_partkey % 4 = 0 THEN 'coupon' END AS conditional FROM part WHERE p_partkey % 7 <> 0"""),
    "store_feed": (store, """SELECT CAST(p_partkey AS VARCHAR) AS url, i - 1 AS ord, CASE WHEN i = 1 THEN p_name ELSE p_name || ' Size ' || i END AS title, p_brand AS vendor, floor(p_retailprice * 100 + 0.5) * i / 100 AS price, i % 2 = 0 AS in_stock
      FROM part, unnest(range(1, p_size % 4 + 2)) AS u(i)"""),
    "price_kinds": (kinds, """SELECT p_partkey, ['coupon', 'membership', 'subscription', 'financing', 'trade_in', '', '', ''][p_partkey % 8 + 1] AS kind, ['', '', '', '', '', '', 'in_stock', 'out_of_stock'][p_partkey % 8 + 1] AS availability, 'new' AS condition FROM part"""),
    "circuit_states": (circuits, """WITH a AS (SELECT 'd' || (user_id % 40) AS domain, ts, event_id AS ord, event_type IN ('error', 'view') AS failed, sum(CAST(event_type = 'purchase' AS INTEGER)) OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS run FROM events WHERE event_type <> 'signup')
      SELECT domain, ord, streak, streak >= 3 AS open FROM (SELECT *, sum(CAST(failed AS INTEGER)) OVER (PARTITION BY domain, run ORDER BY ts, ord) AS streak FROM a)"""),
    "best_client": (client, "SELECT 'd' || (user_id % 40) AS domain, arg_max(event_type, row(ts, event_type)) AS client FROM events WHERE value > 20 GROUP BY 1"),
    "candidate_report": (report, f"""WITH c AS ({OFFERS["vendor_candidates"][1]}) SELECT NOT ok AS rest, met, high,
      printf('%s: %d listings, %d items, %d runs; best %.2f; %s', vkey, high, items, runs, best, CASE WHEN ok THEN 'suggested' ELSE 'meets ' || met || ' of 4' END) AS line FROM c"""),
    "offer_ids": (ids, f"""WITH {LISTINGS_SQL} SELECT orderkey, linenumber, suppkey, substr(sha1(vkey || '|' || CASE WHEN evidence = 'market_snapshot' THEN 'snap:' ELSE '' END || 'm' || orderkey || '|' || condition || '|blue 4 inch|' || pack_qty), 1, 12) AS offer_id FROM listings"""),
    "identity_match": (identities, None),
    "page_products": (products, r"""SELECT page_id, trim(replace(replace(replace(replace(replace(replace(replace(replace(regexp_extract(coalesce(html, ''), '(?i)<title[^>]*>([^<]+)</title>', 1), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), ' ') AS title,
      regexp_extract(coalesce(html, ''), '(?i)<link[^>]+rel=["'']canonical["''][^>]+href=["'']([^"'']+)', 1) AS canonical, CAST(NULL AS VARCHAR) AS method, 0 AS n_offers FROM pages"""),
    "page_listings": (product_pages, """SELECT 'https://x.com/p/' || p_partkey AS url, i AS position, p_name AS title, p_retailprice + i // 2 AS price, CASE i WHEN 0 THEN 'new' ELSE 'used' END AS condition, true AS in_stock,
      CASE i WHEN 0 THEN 'A' ELSE 'B' END AS merchant_item_id, '00036000291452' AS gtins, p_brand AS brand, 'JSON-LD' AS method FROM part, (VALUES (0), (2)) AS t(i)"""),
    "structured_offers": (structured, """SELECT p_partkey, CASE WHEN p_partkey % 6 < 4 THEN 'JSON-LD' WHEN p_partkey % 6 = 4 THEN 'embedded JSON' END AS method, CAST(p_partkey % 6 < 5 AS INTEGER) AS n_offers, CASE WHEN p_partkey % 6 < 5 THEN p_name ELSE '' END AS name,
      CASE WHEN p_partkey % 6 < 4 THEN p_brand ELSE '' END AS brand, CASE WHEN p_partkey % 6 < 5 THEN CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS DOUBLE) END AS price, CASE p_partkey % 6 WHEN 3 THEN 99999.0 WHEN 4 THEN 1000000.0 END AS regular,
      ['S', 'V', 'A', 'P', 'J', NULL][p_partkey % 6 + 1] || p_size AS sku, CASE WHEN p_partkey % 6 = 1 AND p_size > 1 THEN p_size END AS pack, CASE p_partkey % 6 WHEN 3 THEN 'member price $0.50' WHEN 4 THEN 'membership price $0.50' END AS member,
      CAST(p_partkey % 6 = 5 AS INTEGER) AS unread FROM part"""),
    "sitemap_pages": (site_maps, """WITH m AS (SELECT n_nationkey, 'r' || n_regionkey || '.com' AS domain, CASE WHEN n_nationkey % 2 = 0 THEN '/product-' ELSE '/n' END AS kind, 1 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 2, n_nationkey) AS visit FROM nation)
      SELECT domain, 'https://' || domain || kind || n_nationkey || '.xml' AS map, 'https://' || domain || '/p?a=1&s=' || s_suppkey AS link, CAST(visit AS INTEGER) AS visit, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS position
      FROM m JOIN supplier ON s_nationkey = n_nationkey"""),
    "sequence_ratio": (ratio, None),
    "rank_links": (ranked_links, None),
    "search_query": (searches, "SELECT p_partkey, p_name || CASE WHEN list_contains(string_split(p_name, ' '), lower(p_type)) THEN '' ELSE ' ' || p_type END || ' ' || replace(p_brand, '#', '') AS query FROM part"),
    "item_sheet": (item_sheet, """SELECT CAST(p_partkey AS VARCHAR) AS wid, p_name AS product, p_size || ' inch' AS specs, p_type AS keywords, 'X' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS skus, p_brand AS exclude,
      'm-5' || CASE WHEN p_size > 10 THEN '|M-' || p_size ELSE '' END AS mpns, concat_ws('|', CASE WHEN p_size > 10 THEN '00000000000017' END, CASE WHEN p_type = 'SMALL' THEN '04006381333931' END) AS gtins,
      CASE WHEN p_size > 25 THEN 'https://x.com/p?id=' || p_partkey ELSE '' END AS urls, CASE WHEN p_type <> 'PROMO' THEN p_brand WHEN p_size > 10 THEN p_type ELSE '' END AS brand, CAST(greatest(1, p_size) AS INTEGER) AS qty_needed,
      CAST(CAST(p_retailprice AS DECIMAL(10, 2)) AS DOUBLE) AS target, CASE WHEN p_type = 'ECONOMY' THEN 2 ELSE 3 END AS priority,
      CASE p_type WHEN 'PROMO' THEN array_to_string(list_concat([1], list_sort(list_distinct(list_filter([2, p_size], lambda x: x > 1)))), ',') WHEN 'LARGE' THEN NULL ELSE '1' END AS packs,
      p_type IN ('SMALL', 'LARGE') AND p_size > 25 AS only_links, p_type IN ('SMALL', 'LARGE') AND p_size <= 25 AS links_only_fallback FROM part"""),
}
