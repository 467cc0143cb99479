"""Sourcing operators over the driver's tables, with SQL: suppliers stand in for vendors, line items for links, snapshots and search rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions.tasks import tasks_for
from larkspur.operators import cache, learning, report, sourcing
from larkspur.plans.offers import LISTINGS_SQL, NOW, ORDER, now, scored, table

_ORDER = ", ".join(ORDER)
MATCH = "({a} = {b} OR (least(length({a}), length({b})) >= 4 AND (starts_with({a}, {b}) OR starts_with({b}, {a}))))"
VENDORS_SQL = "v AS (SELECT s_suppkey, 'v' || s_suppkey AS vendor_key, s_acctbal > 4000 AS is_primary, s_nationkey >= 20 AS is_secondary FROM supplier)"
LINKS_SQL = """links AS (SELECT l_partkey AS wid, 'v' || l_suppkey AS vendor_key, 'https://www.v' || l_suppkey || '.com/p/' || l_orderkey || '-' || l_linenumber AS url, 'v' || l_suppkey || '.com' AS host, 'v' || l_suppkey AS vendor,
  l_returnflag = 'R' AS failed, l_orderkey AS position, l_shipdate AS dt FROM lineitem WHERE l_linestatus = 'F')"""


def vendors(spark, sf):
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(key, F.concat(F.lit("v"), key).alias("vendor_key"), (F.col("s_acctbal") > 4000).alias("is_primary"), (F.col("s_nationkey") >= 20).alias("is_secondary"))


def links(spark, sf):
    """Line items that are finished (status F) as product links of their items; returned ones have failed."""
    name = F.concat(F.lit("v"), "l_suppkey")
    return table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(
        F.col("l_partkey").alias("wid"), name.alias("vendor_key"), F.concat(F.lit("https://www."), name, F.lit(".com/p/"), "l_orderkey", F.lit("-"), "l_linenumber").alias("url"), F.concat(name, F.lit(".com")).alias("host"), name.alias("vendor"),
        (F.col("l_returnflag") == "R").alias("failed"), F.col("l_orderkey").alias("position"), F.col("l_shipdate").alias("dt"),
    )


def only(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("wid"), (F.col("p_size") % 4 < 2).alias("only_links"))


def snapshots(spark, sf):
    """Market snapshots, with addresses: one in three through an aggregator."""
    s = scored(spark, sf).where("evidence = 'market_snapshot'")
    n = F.col("suppkey")
    return s.select("wid", "vkey", F.concat("vkey", F.lit(".com")).alias("host_of_vendor"), F.when(F.col("orderkey") % 3 == 0, F.lit("https://www.google.com/x")).otherwise(F.concat(F.lit("https://"), "vkey", F.lit(".com/"), n)).alias("url"),
        "condition", "confidence", F.concat(F.lit("thing, pack of "), "pack_qty").alias("title"), "pack_qty", "unit_price", (F.col("condition") == "new").alias("allowed"), *ORDER)


SNAPSHOTS_SQL = """snaps AS (SELECT wid, vkey, vkey || '.com' AS host, (orderkey + 0) % 3 <> 0 AS direct, CASE WHEN orderkey % 3 = 0 THEN 'https://www.google.com/x' ELSE 'https://' || vkey || '.com/' || suppkey END AS url,
  condition, confidence, pack_qty, unit_price, orderkey, linenumber, suppkey, quantity, extended FROM scored WHERE evidence = 'market_snapshot')"""


def roles(spark, sf):
    v = vendors(spark, sf)
    s = scored(spark, sf).drop("is_primary", "is_resale").withColumn("source", F.when(F.col("linenumber") == 6, "ebay").otherwise("page"))
    out = sourcing.vendor_roles(s, v.where("is_primary"), v.where("is_secondary"), links(spark, sf), only(spark, sf))
    return out.groupBy("wid").agg(F.count_if("is_primary").alias("n_primary"), F.count_if("on_secondary").alias("n_secondary"), F.count_if("is_resale").alias("n_resale"), F.count(F.lit(1)).alias("n"))


def names(spark, sf):
    s = table(spark, sf, "supplier")
    primary = s.where("s_acctbal > 3000").select(F.col("s_name").alias("name"), F.concat(F.lit("shop"), "s_suppkey").alias("vendor_key"), F.concat(F.lit("www.s"), "s_suppkey", F.lit(".com")).alias("domain"), F.col("s_suppkey").alias("position"))
    hosts = s.select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "de.s").otherwise("shop"), "s_suppkey", F.lit(".com")).alias("host"))
    return sourcing.vendor_names(hosts, primary)


def anchor_titles(spark, sf):
    s = scored(spark, sf).withColumn("title", F.concat(F.lit("The Thing "), "suppkey", F.lit(" No. "), "orderkey"))
    return sourcing.anchors(s, ORDER)


def link_status(spark, sf):
    l = links(spark, sf).select("wid", "url", F.when(F.col("failed"), "blocked").otherwise("success").alias("outcome"), F.lit("no data").alias("detail"))
    rows = scored(spark, sf).where("conditional IS NULL").withColumn("url", F.concat(F.lit("https://www."), "vkey", F.lit(".com/p/"), "orderkey", F.lit("-"), "linenumber"))
    rows = rows.unionByName(rows.where("shipping IS NULL").withColumns({"pack_qty": F.col("pack_qty") + 1, "confidence": F.lit("Low")}))
    return sourcing.link_results(l, rows, ORDER)


def modes(spark, sf):
    return sourcing.search_modes(only(spark, sf), links(spark, sf))


def needed(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 1000).alias("wid"), "ts")
    out = sourcing.search_needed(only(spark, sf), scored(spark, sf), links(spark, sf).where("failed and dt >= '2001-07-01'"), e, now())
    return out.select("wid", "verified", F.floor(F.col("age_days") * 1000).cast("long").alias("age"), "needed")


def unworking(spark, sf):
    s = sourcing.without_working(snapshots(spark, sf), links(spark, sf).where("not failed"))
    return sourcing.without_answered(s, links(spark, sf).where("failed").select("wid", F.col("vendor_key").alias("vkey"))).groupBy("wid").agg(F.count(F.lit(1)).alias("n"), F.min("unit_price").alias("cheapest"))


def verification(spark, sf):
    s = table(spark, sf, "supplier")
    color = F.element_at(F.array(*map(F.lit, ["red", "blue", "green"])), (F.col("s_suppkey") % 3 + 1).cast("int"))
    primary = s.select(F.concat(color, F.lit(" Store Inc "), "s_suppkey").alias("name"), F.when(F.col("s_acctbal") > 1000, F.concat(F.lit("www.v"), "s_suppkey", F.lit(".com"))).otherwise("").alias("domain"), (F.col("s_suppkey") % 2 == 0).alias("is_direct"))
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("wid"), F.col("p_name").alias("product_text"))
    host = lambda *r: s.where(F.col("s_nationkey").isin(*r)).select(F.concat(F.lit("v"), "s_suppkey", F.lit(".com")).alias("host"))
    return sourcing.verification_targets(items, primary, links(spark, sf).where("not failed"), host(3), host(4, 5))


def targets(spark, sf):
    closed = table(spark, sf, "supplier").where("s_nationkey < 4").select(F.concat(F.lit("v"), "s_suppkey", F.lit(".com")).alias("host"))
    return sourcing.snapshot_targets(snapshots(spark, sf), links(spark, sf).where("not failed"), closed, ["unit_price", *ORDER]).select("wid", "host", "rank", "unit_price")


def stand_ins(spark, sf):
    parts = tasks_for(table(spark, sf, "lineitem"))
    return sourcing.fill_failed(links(spark, sf).where("failed"), snapshots(spark, sf), ["unit_price", *ORDER], parts).select("wid", F.col("failed_url").alias("url"), "vkey", "confidence", "pack_qty", "unit_price")


def fallback(spark, sf):
    l = links(spark, sf)
    cached = l.select("wid", "host", F.concat("url", F.when(F.col("position") % 2 == 0, "-new").otherwise("")).alias("url"), F.lit(True).alias("ok"), F.date_sub(now(), (F.col("position") % 60).cast("int")).cast("timestamp").alias("ts"))
    cached = cached.groupBy("wid", "host").agg(F.max("url").alias("url"), F.bool_and("ok").alias("ok"), F.max("ts").alias("ts"))
    return sourcing.link_fallback(l.where("failed"), l.where("not failed"), cached, snapshots(spark, sf), now(), ORDER)


def observations(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("wid"), "ts", F.concat(F.lit("run"), F.col("event_id") % 7).alias("run"), F.when(F.col("value") > 0, F.col("value")).alias("unit"), (F.col("event_type") != "error").alias("trusted"), F.when(F.col("event_type") == "view", "used").when(F.col("event_type") == "click", "new").alias("condition"))


def trusted(spark, sf):
    return cache.trusted_units(observations(spark, sf), now(), exclude_run="run3", days=20).groupBy("wid").agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("low"), F.max("ts").alias("last"))


def cached_rows(spark, sf):
    e = table(spark, sf, "events").select(F.concat_ws("/", "user_id", F.get_json_object("props", "$.k")).alias("query"), "ts", "event_id", "event_type")
    return cache.fresh(cache.put(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'"), ["query"]), now(), 30 * 24).drop("event_type")


def discovery(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 300).alias("wid"), F.concat(F.lit("d"), F.col("event_id") % 4).alias("domain"), F.when(F.col("event_type") == "click", F.concat(F.lit("https://x/"), "event_id")).otherwise("").alias("url"), (F.col("event_type") != "error").alias("ok"), "ts", "event_id")
    return cache.discovery_state(e, ["wid", "domain"], ["ts", "event_id"])


def learned(spark, sf):
    p = table(spark, sf, "part")
    items = p.select(F.col("p_partkey").alias("wid"), F.col("p_name").alias("product"))
    kept = p.select(F.col("p_partkey").alias("wid"), F.when(F.col("p_size") % 3 == 0, F.lit("another name")).otherwise(F.upper("p_name")).alias("product"), F.array(F.lpad(F.col("p_partkey").cast("string"), 14, "0")).alias("gtins"), F.array("p_brand").alias("mpns"), F.col("p_type").alias("brand"))
    found = p.where("p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("wid"), F.array(F.lit("00000000000017")).alias("gtins"), F.array(F.lower("p_brand"), F.lit("X1"), F.concat(F.lit("M-"), "p_size")).alias("mpns"), F.lit("other").alias("brand"))
    out = cache.learned_identity(items, cache.learn(kept, found))
    return out.select("wid", F.array_join("learned_gtins", ",").alias("gtins"), F.array_join("learned_mpns", ",").alias("mpns"), "learned_brand")


def stock(spark, sf):
    return scored(spark, sf).groupBy("wid").agg(*[F.count_if(report.stock_status() == x).alias(n) for n, x in (("yes", "Yes"), ("no", "No"), ("unknown", "N/A"))])


def flags(spark, sf):
    l = links(spark, sf).where("failed").groupBy("wid").agg(F.array_sort(F.collect_set("vendor")).alias("items"))
    e = table(spark, sf, "events").groupBy((F.col("user_id")).alias("wid")).agg((F.count_if(F.col("event_type") == "error") % 3).alias("streak"))
    rows = only(spark, sf).join(l, "wid", "left").join(e, "wid", "left")
    return rows.select("wid", report.flag_text(F.coalesce("items", F.array().cast("array<string>")), F.coalesce("streak", F.lit(0))).alias("flag"))


def run_rows(spark, sf):
    return report.run_rows(scored(spark, sf))


def vendor_seen(spark, sf):
    s = scored(spark, sf).where("eligible")
    rows = s.select("vkey", F.concat("vkey", F.when(F.col("linenumber") % 3 == 0, ".com - Seller").otherwise(".com")).alias("vendor"), F.when(F.col("orderkey") % 4 == 0, F.concat(F.lit("https://"), "vkey", F.lit("-store.org/x"))).alias("url"))
    return learning.vendor_identity(rows)


_ROLES = f"""WITH {LISTINGS_SQL}, {VENDORS_SQL}, {LINKS_SQL}, k AS (SELECT DISTINCT vkey FROM scored),
  p AS (SELECT DISTINCT vkey FROM k JOIN v ON {MATCH.format(a="vkey", b="vendor_key")} WHERE is_primary), x AS (SELECT DISTINCT vkey FROM k JOIN v ON {MATCH.format(a="vkey", b="vendor_key")} WHERE is_secondary),
  l AS (SELECT DISTINCT s.wid, s.vkey FROM scored s JOIN links k ON k.wid = s.wid AND {MATCH.format(a="s.vkey", b="k.vendor_key")}),
  r AS (SELECT s.wid, p.vkey IS NOT NULL OR (p_size % 4 < 2 AND l.vkey IS NOT NULL) AS pri, p_size % 4 >= 2 AND (x.vkey IS NOT NULL OR linenumber = 6) AS sec, condition = 'used' AS used
    FROM scored s JOIN part ON p_partkey = s.wid LEFT JOIN p ON p.vkey = s.vkey LEFT JOIN x ON x.vkey = s.vkey LEFT JOIN l ON l.wid = s.wid AND l.vkey = s.vkey)
  SELECT wid, count(*) FILTER (WHERE pri) AS n_primary, count(*) FILTER (WHERE sec) AS n_secondary, count(*) FILTER (WHERE used OR sec) AS n_resale, count(*) AS n FROM r GROUP BY wid"""

QUERIES: dict[str, tuple] = {
    "vendor_roles": (roles, _ROLES),
    "vendor_names": (names, f"""WITH p AS (SELECT s_name AS name, 'shop' || s_suppkey AS k, 's' || s_suppkey || '.com' AS d, s_suppkey AS pos FROM supplier WHERE s_acctbal > 3000),
      h AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 'de.s' ELSE 'shop' END || s_suppkey || '.com' AS host, CASE WHEN s_suppkey % 2 = 0 THEN 'des' ELSE 'shop' END || s_suppkey AS hk FROM supplier),
      m AS (SELECT host, arg_min(name, row(CASE WHEN host = d OR ends_with(host, '.' || d) THEN 0 ELSE 1 END, pos)) AS name FROM h JOIN p ON host = d OR ends_with(host, '.' || d) OR {MATCH.format(a="CASE WHEN starts_with(hk, 'des') THEN 'de' ELSE hk END", b="k")} GROUP BY host)
      SELECT host, coalesce(name, host) AS vendor FROM h LEFT JOIN m USING (host)"""),
    "anchor_titles": (anchor_titles, f"""WITH {LISTINGS_SQL} SELECT wid, arg_min('the thing ' || suppkey || ' no ' || orderkey, row(evidence NOT LIKE 'verified%', is_resale, NOT is_primary, {_ORDER})) AS anchor FROM scored
      WHERE match_evidence = 'gtin' AND confidence <> 'Low' GROUP BY wid"""),
    "link_status": (link_status, f"""WITH {LISTINGS_SQL}, {LINKS_SQL}, a AS (SELECT *, 'https://www.' || vkey || '.com/p/' || orderkey || '-' || linenumber AS url FROM scored WHERE conditional IS NULL),
      rows AS (SELECT wid, url, confidence, match_evidence, pack_qty, price, in_stock, row(pack_qty, {_ORDER}) AS r FROM a UNION ALL
        SELECT wid, url, 'Low', match_evidence, pack_qty + 1, price, in_stock, row(pack_qty + 1, {_ORDER}) FROM a WHERE shipping IS NULL),
      g AS (SELECT wid, url, count(*) AS offers, min(pack_qty) FILTER (WHERE confidence = 'High') AS best_pack, arg_min(match_evidence, r) FILTER (WHERE confidence = 'High') AS evidence, bool_and(confidence = 'Low') AS low,
        arg_min(price, r) AS price, arg_min(CASE WHEN in_stock IS NULL THEN 'stock unknown' WHEN in_stock THEN 'in stock' ELSE 'OUT OF STOCK' END, r) AS stock FROM rows GROUP BY wid, url),
      l AS (SELECT l.wid, l.url, l.host, CASE WHEN low THEN 'identity_mismatch' WHEN failed THEN 'blocked' ELSE 'success' END AS outcome, coalesce(offers, 0) AS offers, best_pack, evidence, coalesce(low, false) AS low, price, stock FROM links l LEFT JOIN g ON g.wid = l.wid AND g.url = l.url)
      SELECT wid, url, outcome, 'no data' AS detail, offers = 0 OR low AS failed, offers, best_pack, evidence, CASE WHEN best_pack = 1 THEN 'all' WHEN best_pack > 1 THEN 'codes' END AS teaches,
        host || ': [' || outcome || '] ' || CASE WHEN offers > 0 THEN '$' || format('{{:,.2f}}', price) || ' ' || stock || '; ' || CASE WHEN best_pack IS NOT NULL THEN 'identity validated (' || evidence || ')' WHEN low THEN 'IDENTITY MISMATCH' ELSE 'identity unconfirmed' END
          || CASE WHEN offers > 1 THEN ' (+' || (offers - 1) || ' variants)' ELSE '' END ELSE 'FAILED - no data' END AS status FROM l"""),
    "search_modes": (modes, f"""WITH {LINKS_SQL}, w AS (SELECT wid, count(DISTINCT vendor_key) FILTER (WHERE NOT failed) AS working FROM links GROUP BY wid)
      SELECT p_partkey AS wid, coalesce(working, 0) AS working, CASE WHEN p_size % 4 >= 2 OR working IS NULL THEN 'search' WHEN working >= 3 THEN 'links only' ELSE 'links and search' END AS mode FROM part LEFT JOIN w ON wid = p_partkey"""),
    "search_needed": (needed, f"""WITH {LISTINGS_SQL}, {LINKS_SQL}, n AS (SELECT wid, count(*) AS verified FROM scored WHERE evidence LIKE 'verified%' AND coalesce(in_stock, true) GROUP BY wid), e AS (SELECT user_id % 1000 AS wid, max(ts) AS t FROM events GROUP BY 1),
      f AS (SELECT DISTINCT wid FROM links WHERE failed AND dt >= '2001-07-01'), a AS (SELECT p_partkey AS wid, coalesce(verified, 0) AS verified, (floor(epoch({NOW})) - floor(epoch(t))) / 86400 AS age, f.wid IS NOT NULL AS failed FROM part LEFT JOIN n ON n.wid = p_partkey LEFT JOIN e ON e.wid = p_partkey LEFT JOIN f ON f.wid = p_partkey)
      SELECT wid, verified, CAST(floor(age * 1000) AS BIGINT) AS age, NOT (verified >= 2 AND NOT failed AND coalesce(age < 6, false)) AS needed FROM a"""),
    "unworking_snapshots": (unworking, f"""WITH {LISTINGS_SQL}, {LINKS_SQL}, {SNAPSHOTS_SQL} SELECT wid, count(*) AS n, min(unit_price) AS cheapest FROM snaps s
      WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.wid = s.wid AND NOT failed AND {MATCH.format(a="l.vendor_key", b="s.vkey")}) AND NOT EXISTS (SELECT 1 FROM links l WHERE l.wid = s.wid AND failed AND l.vendor_key = s.vkey) GROUP BY wid"""),
    "verification_targets": (verification, f"""WITH {LINKS_SQL}, s AS (SELECT *, ['red', 'blue', 'green'][1 + s_suppkey % 3] AS color, 'v' || s_suppkey || '.com' AS host FROM supplier WHERE s_acctbal > 1000)
      SELECT p_partkey AS wid, color || ' Store Inc ' || s_suppkey AS vendor, host, CASE WHEN s_suppkey % 2 = 0 THEN 'direct' ELSE 'retailer' END AS kind FROM part, s
      WHERE (s_suppkey % 2 = 1 OR list_contains(string_split(p_name, ' '), color)) AND NOT EXISTS (SELECT 1 FROM links l WHERE l.wid = p_partkey AND l.host = s.host AND NOT failed) AND s_nationkey <> 3 AND (s_suppkey % 2 = 0 OR s_nationkey NOT IN (4, 5))"""),
    "snapshot_targets": (targets, f"""WITH {LISTINGS_SQL}, {LINKS_SQL}, {SNAPSHOTS_SQL}, o AS (SELECT * FROM snaps s WHERE direct AND confidence <> 'Low' AND suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 4) AND NOT EXISTS (SELECT 1 FROM links l WHERE l.wid = s.wid AND l.host = s.host AND NOT failed)
        QUALIFY row_number() OVER (PARTITION BY wid, host ORDER BY unit_price, {_ORDER}) = 1)
      SELECT wid, host, row_number() OVER (PARTITION BY wid ORDER BY unit_price, {_ORDER}) AS rank, unit_price FROM o QUALIFY rank <= 3"""),
    "failed_stand_ins": (stand_ins, f"""WITH {LISTINGS_SQL}, {LINKS_SQL}, {SNAPSHOTS_SQL} SELECT l.wid, l.url, s.vkey, confidence, pack_qty, unit_price FROM links l JOIN snaps s ON s.wid = l.wid AND {MATCH.format(a="l.vendor_key", b="s.vkey")}
      WHERE failed AND condition = 'new' AND confidence <> 'Low' QUALIFY row_number() OVER (PARTITION BY l.wid, l.url ORDER BY confidence <> 'High', pack_qty, unit_price, {_ORDER}) = 1"""),
    "link_fallback": (fallback, f"""WITH {LISTINGS_SQL}, {LINKS_SQL}, {SNAPSHOTS_SQL}, c AS (SELECT wid, host, max(url || CASE WHEN position % 2 = 0 THEN '-new' ELSE '' END) AS link, min(position % 60) AS age FROM links GROUP BY wid, host),
      f AS (SELECT l.wid, l.vendor_key AS key, l.host, l.url AS failed_url FROM links l WHERE failed AND NOT EXISTS (SELECT 1 FROM links o WHERE o.wid = l.wid AND o.vendor_key = l.vendor_key AND NOT o.failed) QUALIFY row_number() OVER (PARTITION BY l.wid, l.vendor_key ORDER BY position, l.url) = 1),
      g AS (SELECT f.*, CASE WHEN age <= 30 AND replace(link, 'www.', '') <> replace(failed_url, 'www.', '') THEN link END AS link FROM f LEFT JOIN c ON c.wid = f.wid AND c.host = f.host),
      m AS (SELECT g.wid, g.key, g.failed_url, s.url, s.pack_qty, s.unit_price, direct, row(confidence <> 'High', s.pack_qty <> 1, NOT direct, s.unit_price, {", ".join("s." + c for c in ORDER)}) AS r
        FROM g JOIN snaps s ON s.wid = g.wid AND {MATCH.format(a="g.key", b="s.vkey")} WHERE link IS NULL AND condition = 'new' AND confidence <> 'Low')
      SELECT wid, key, failed_url, 'cached' AS step, link AS url, 1 AS rank, NULL::INTEGER AS pack_qty, NULL::DOUBLE AS unit_price FROM g WHERE link IS NOT NULL
      UNION ALL SELECT * FROM (SELECT wid, key, failed_url, 'fetch', url, row_number() OVER (PARTITION BY wid, key ORDER BY r) AS n, pack_qty, unit_price FROM m WHERE direct) WHERE n <= 2
      UNION ALL SELECT * FROM (SELECT wid, key, failed_url, 'snapshot', url, row_number() OVER (PARTITION BY wid, key, pack_qty ORDER BY r) AS n, pack_qty, unit_price FROM m) WHERE n = 1
      UNION ALL SELECT wid, key, failed_url, 'none', NULL, NULL, NULL, NULL FROM g WHERE link IS NULL AND NOT EXISTS (SELECT 1 FROM m WHERE m.wid = g.wid AND m.key = g.key)"""),
    "trusted_units": (trusted, f"""SELECT user_id AS wid, count(*) AS n, min(value) AS low, max(ts) AS last FROM events WHERE event_type <> 'error' AND event_type <> 'view' AND value > 0 AND event_id % 7 <> 3 AND ts >= {NOW} - INTERVAL 20 DAYS GROUP BY user_id"""),
    "cached_rows": (cached_rows, f"""WITH e AS (SELECT user_id || '/' || (props->>'$.k') AS query, ts, event_id, event_type FROM events), n AS (SELECT * FROM e WHERE event_type = 'purchase'),
      a AS (SELECT * FROM n UNION ALL SELECT * FROM e WHERE event_type <> 'purchase' AND query NOT IN (SELECT query FROM n)) SELECT query, ts, event_id FROM a WHERE epoch({NOW}) - floor(epoch(ts)) <= 30 * 24 * 3600"""),
    "discovery_state": (discovery, """WITH e AS (SELECT user_id % 300 AS wid, 'd' || (event_id % 4) AS domain, CASE WHEN event_type = 'click' THEN 'https://x/' || event_id ELSE '' END AS url, event_type <> 'error' AS ok, ts, event_id FROM events),
      g AS (SELECT *, sum(CASE WHEN ok AND url = '' THEN 0 ELSE 1 END) OVER (PARTITION BY wid, domain ORDER BY ts, event_id) AS grp FROM e), l AS (SELECT *, first_value(url) OVER (PARTITION BY wid, domain, grp ORDER BY ts, event_id) AS held FROM g)
      SELECT wid, domain, CASE WHEN grp > 0 THEN held ELSE '' END AS url, ok, ts FROM l QUALIFY row_number() OVER (PARTITION BY wid, domain ORDER BY ts DESC, event_id DESC) = 1"""),
    "learned_identity": (learned, """SELECT p_partkey AS wid, CASE WHEN p_size % 3 = 0 THEN '' ELSE array_to_string(list_sort(list_distinct(list_concat([lpad(CAST(p_partkey AS VARCHAR), 14, '0')], CASE WHEN p_type <> 'ECONOMY' THEN ['00000000000017'] ELSE [] END))), ',') END AS gtins,
      CASE WHEN p_size % 3 = 0 THEN '' ELSE array_to_string(list_sort(list_concat([p_brand], CASE WHEN p_type <> 'ECONOMY' AND length('M-' || p_size) >= 4 THEN ['M-' || p_size] ELSE [] END)), ',') END AS mpns, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS learned_brand FROM part"""),
    "stock_status": (stock, f"""WITH {LISTINGS_SQL} SELECT wid, count(*) FILTER (WHERE evidence LIKE 'verified%' AND in_stock) AS yes, count(*) FILTER (WHERE evidence LIKE 'verified%' AND NOT in_stock) AS no,
      count(*) FILTER (WHERE evidence NOT LIKE 'verified%' OR in_stock IS NULL) AS unknown FROM scored GROUP BY wid"""),
    "flag_text": (flags, f"""WITH {LINKS_SQL}, l AS (SELECT wid, array_to_string(list_sort(list(DISTINCT vendor)), '; ') AS x FROM links WHERE failed GROUP BY wid), e AS (SELECT user_id AS wid, count(*) FILTER (WHERE event_type = 'error') % 3 AS n FROM events GROUP BY 1)
      SELECT p_partkey AS wid, CASE WHEN x IS NULL THEN 'No' ELSE 'Yes' || CASE WHEN coalesce(n, 0) > 0 THEN ' (run ' || (n + 1) || ' in a row)' ELSE '' END || ': ' || x END AS flag FROM part LEFT JOIN l ON l.wid = p_partkey LEFT JOIN e ON e.wid = p_partkey"""),
    "run_rows": (run_rows, f"""WITH {LISTINGS_SQL} SELECT wid, count(*) AS listings, count(*) FILTER (WHERE eligible) AS matching, count(DISTINCT vkey) AS websites, min(unit_price) FILTER (WHERE reportable AND confidence = 'High') AS lowest,
      CASE WHEN count(*) FILTER (WHERE eligible) = 0 THEN 'no eligible listings' ELSE array_to_string(list_filter([CASE WHEN count(*) FILTER (WHERE eligible AND evidence = 'verified_direct') > 0 THEN count(*) FILTER (WHERE eligible AND evidence = 'verified_direct') || ' verified_direct' END,
        CASE WHEN count(*) FILTER (WHERE eligible AND evidence = 'verified_discovered') > 0 THEN count(*) FILTER (WHERE eligible AND evidence = 'verified_discovered') || ' verified_discovered' END,
        CASE WHEN count(*) FILTER (WHERE eligible AND evidence = 'market_snapshot') > 0 THEN count(*) FILTER (WHERE eligible AND evidence = 'market_snapshot') || ' market_snapshot' END], lambda x: x IS NOT NULL), ', ') END AS evidence_mix FROM scored GROUP BY wid"""),
    "vendor_identity": (vendor_seen, f"""WITH {LISTINGS_SQL}, s AS (SELECT vkey, vkey || CASE WHEN linenumber % 3 = 0 THEN '.com - Seller' ELSE '.com' END AS vendor, orderkey % 4 = 0 AS linked FROM scored WHERE eligible),
      n AS (SELECT vkey, vendor, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT vkey, arg_min(vendor, row(-n, vendor)) AS vendor FROM n GROUP BY vkey), h AS (SELECT vkey, bool_or(linked) AS linked FROM s GROUP BY vkey)
      SELECT vkey, regexp_replace(vendor, ' - .*', '') AS name, contains(vendor, ' - ') AS marketplace, CASE WHEN linked THEN vkey || '-store.org' ELSE lower(regexp_replace(vendor, ' - .*', '')) END AS domain, CASE WHEN linked THEN 'merchant link' ELSE 'vendor name' END AS domain_how FROM m JOIN h USING (vkey)"""),
}
