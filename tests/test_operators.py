import datetime as dt
from itertools import combinations_with_replacement

import pytest
from pyspark.sql import functions as F

from larkspur.operators import history, identity, learning, links, pricing, reconcile

LISTING = "wid string, ord int, vendor string, source string, price double, shipping double, pack_qty int, condition string, in_stock boolean, evidence string, confidence string, is_primary boolean, is_resale boolean"


def listings(spark, rows):
    return pricing.normalize_prices(spark.createDataFrame(rows, LISTING))


def row(wid="a", ord=0, price=10.0, pack=1, stock=True, evidence="verified_direct", confidence="High", condition="new", resale=False, primary=True, shipping=None, source="page"):
    return (wid, ord, "V", source, price, shipping, pack, condition, stock, evidence, confidence, primary, resale)


def eligible(spark, rows):
    items = spark.createDataFrame([("a", None, None, True)], "wid string, packs array<int>, target double, open_used boolean")
    return pricing.score_eligibility(listings(spark, rows), items)


def test_normalize(spark):
    r = listings(spark, [row(price=10.0, shipping=2.5, pack=3), row(price=1.0, pack=None, stock=None)]).orderBy(F.desc("price")).collect()
    assert (r[0]["effective_price"], r[0]["unit_price"], r[0]["availability"]) == (12.5, 4.17, "in_stock")
    assert (r[1]["pack_qty"], r[1]["unit_price"], r[1]["availability"]) == (1, 1.0, "unknown")


def test_baseline_prefers_single_units_in_stock(spark):
    rows = [row(price=10.0), row(price=12.0), row(price=99.0, stock=False), row(price=4.0, pack=2), row(price=1.0, evidence="market_snapshot")]
    assert pricing.verified_baseline(eligible(spark, rows)).first()["baseline"] == 11.0
    assert pricing.verified_baseline(eligible(spark, [row(price=99.0, stock=False), row(price=4.0, pack=2)])).first()["baseline"] == 99.0
    assert pricing.verified_baseline(eligible(spark, [row(confidence="Low")])).count() == 0


def test_trimmed_mean_borders_count(spark):
    df = spark.createDataFrame([("a", v) for v in (4.0, 10.0, 10.0, 25.0, 26.0)] + [("b", None)], "k string, v double")
    r = pricing.trimmed_mean(df, ["k"], "v").collect()
    assert len(r) == 1 and r[0]["n"] == 4 and r[0]["avg"] == 12.25


def test_quantity_plan_against_enumeration(spark):
    import random

    rng = random.Random(3)
    for _ in range(30):
        options = [(p, round(rng.uniform(1, 9) * p**0.8, 2), rng.randint(0, 1), False) for p in rng.sample([1, 2, 3, 4, 6], 3)]
        need = rng.randint(1, 7)
        best = min((round(sum(o[1] for o in c), 2), sum(o[2] for o in c), sum(o[0] for o in c)) for k in range(1, 8) for c in combinations_with_replacement(options, k) if sum(o[0] for o in c) >= need)
        found = pricing.cheapest_cover(options, need)
        assert found[0] == pytest.approx(best[0]) and found[1:] == best[1:]
    assert pricing.cheapest_cover([(2, 3.0, 0, True)], 3) is None  # one of a kind
    assert pricing.cheapest_cover([(2, 3.0, 0, True), (1, 4.0, 0, False)], 3) == (7.0, 0, 3)


def test_deal_reasons(spark):
    s = eligible(spark, [row(ord=1, price=50.0), row(ord=2, price=90.0), row(ord=3, price=10.0), row(ord=4, price=60.0, stock=False)])
    facts = spark.createDataFrame([("a", 100.0, 100.0, None, 0, None, 0, 80.0, 3, 55.0, None, {})], "wid string, ref_price double, baseline double, new_avg double, new_n int, res_avg double, res_n int, median double, median_n int, low double, trend double, packs map<int,double>")
    r = pricing.find_deals(s, facts, ["ord"]).collect()
    assert [(x["ord"], x["reasons"]) for x in r] == [(1, ["below reference", "below trend", "new verified low"])]


def test_merge_and_twins(spark):
    rows = [row(ord=1, evidence="market_snapshot", price=9.0), row(ord=2), row(ord=3, evidence="verified_discovered")]
    merged = reconcile.merge_duplicates(listings(spark, rows), ["wid", "pack_qty"], ["ord"]).first()
    assert merged["ord"] == 2 and merged["corroborated_by"] == ["page/market_snapshot", "page/verified_discovered"]
    offers = listings(spark, rows).withColumn("vkey", F.lit("vendor"))
    stay, gone = reconcile.merge_twins(offers, ["wid", "condition", "pack_qty"], ["ord"])
    assert sorted(r["ord"] for r in stay.collect()) == [2, 3] and [(r["ord"], r["note"]) for r in gone.collect()] == [(1, "stale")]


def test_history(spark):
    d = lambda n: dt.datetime(2024, 1, n)
    s = spark.createDataFrame([("a", d(1), 10.0, True), ("a", d(2), 10.005, False), ("a", d(3), 8.0, True), ("a", d(4), 9.0, None)], "wid string, dt timestamp, v double, in_stock boolean")
    e = history.price_events(s, ["dt"]).orderBy("dt").collect()
    assert [r["event"] for r in e] == ["new offer", "unchanged", "price drop; back in stock", "price increase"] and e[1]["since"] == d(1)
    st = history.history_stats(s, F.lit(d(5))).first()
    assert (st["prior"], st["median"], st["low"]) == (9.0, 9.5, 8.0) and st["ewma"] == pytest.approx(9.28, abs=0.01)
    flags = spark.createDataFrame([("a", 1, "Yes"), ("a", 2, "No"), ("a", 3, "Yes: x"), ("a", 4, "Yes"), ("b", 1, "Not run")], "wid string, n int, flag string")
    assert {r["wid"]: r["streak"] for r in history.flag_streak(flags, F.startswith("flag", F.lit("Yes")), ["n"]).collect()} == {"a": 2, "b": 0}


def test_writes_are_idempotent(spark):
    old = spark.createDataFrame([("r1", "a", 1), ("r2", "a", 2), (None, "b", 3)], "run string, wid string, v int")
    new = spark.createDataFrame([("r2", "a", 9, "x"), (None, "b", 8, "y")], "run string, wid string, v int, extra string")
    once = history.replace_rows(old, new, ["run", "wid"])
    twice = history.replace_rows(once, new, ["run", "wid"])
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect())) and sorted(r["v"] for r in once.collect()) == [1, 8, 9]


def test_yield_and_codes(spark):
    t = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([("d", "1", "r1", "blocked", 0, t), ("d", "1", "r1", "success", 2, t + dt.timedelta(hours=1)), ("d", "2", "r1", "skipped", 0, t), ("", "1", "r", "success", 1, t)], "domain string, wid string, run string, outcome string, n_listings int, ts timestamp")
    r = learning.retailer_yield(a).collect()
    assert [(x["domain"], x["attempts"], x["found"], x["blocked"]) for x in r] == [("d", 1, 1, 0)]
    learned = spark.createDataFrame([("a", ["X1"])], "wid string, codes array<string>")
    found = spark.createDataFrame([("a", c) for c in "FEDCBA"] + [("b", "Z")], "wid string, code string")
    assert {x["wid"]: x["codes"] for x in learning.union_codes(learned, found).collect()} == {"a": ["X1", "A", "B", "C", "D", "E"], "b": ["Z"]}


ITEM = ("Sonos Ray Soundbar", "Sonos", ["Black"], ["RAYG1US1BLK"], ["00036000291452"], ["stand alone"])


@pytest.mark.parametrize("title, mpns, confidence, reason", [
    ("Sonos Ray Soundbar - Black", [], "High", "exact name"), ("Sonos Ray Soundbar RAYG1US1BLK", [], "Medium", "code"), ("Sonos Ray Soundbar Black RAYG1US1BLK", [], "High", "code and specs"),
    ("Sonos Ray Soundbar", ["RAYG1US1BLK"], "Medium", "code"), ("Sonos Ray Soundbar 036000291452", [], "High", "gtin"), ("Sonos Ray Soundbar White", [], "Low", "colour"),
    ("Sonos Ray Soundbar", ["RAYG1US1WHT"], "Low", "variant"), ("Sonos Beam Soundbar Black", [], "Low", "model"), ("Wall Mount for Sonos Ray Soundbar", [], "Low", "accessory mount"),
    ("Sonos Ray Soundbar stand alone", [], "Low", "exclusion"), ("Sonos Ray Soundbar Black UK plug", [], "Low", "region"), ("Sonos Ray Soundbar Black + Sub Mini", [], "Low", "bundle + sub"),
    ("Garden hose", [], "Low", "weak name"), (None, [], "Low", "weak name"), ("Sonos Ray Soundbar bundle Black", [], "Low", "bundle"),
])
def test_identity(spark, title, mpns, confidence, reason):
    item = spark.createDataFrame([ITEM], "product string, brand string, specs array<string>, mpns array<string>, gtins array<string>, exclude array<string>")
    offer = spark.createDataFrame([(title, mpns, None, 1, None)], "title string, offer_mpns array<string>, offer_gtins array<string>, pack_qty int, color string")
    r = identity.classify(identity.item_features(item).crossJoin(offer)).first()
    assert (r["confidence"], r["reason"]) == (confidence, reason)


def test_validate_page(spark):
    item = spark.createDataFrame([ITEM], "product string, brand string, specs array<string>, mpns array<string>, gtins array<string>, exclude array<string>")
    offer = spark.createDataFrame([("Ray Compact", [], None, 1, None, "ray-soundbar", "sonos.com", "Sonos", ""), ("Something else", [], None, 1, None, "", "x.com", "X", "")], "title string, offer_mpns array<string>, offer_gtins array<string>, pack_qty int, color string, slug string, host string, vendor string, offer_brand string")
    r = {x["title"]: (x["confidence"], x["match_evidence"]) for x in identity.validate_page(identity.item_features(item).crossJoin(offer)).collect()}
    assert r["Ray Compact"][0] == "High" and r["Something else"][0] == "Medium"


def test_links(spark):
    urls = ["https://x.com/products/ray-soundbar", "https://x.com/p/ray-soundbar-black-edition", "https://x.com/collections/ray", "https://x.com/p/ray-wall-mount", "https://x.com/de-de/p/ray-soundbar", "https://x.com/p/RAYG1US1"]
    df = spark.createDataFrame([("a", "x.com", u, "X Ray Soundbar", ["RAYG1US1"]) for u in urls], "wid string, domain string, link string, product string, codes array<string>")
    assert [r["link"] for r in links.rank_links(df, 2).orderBy("rank").collect()] == [urls[5], urls[0]]
    item = spark.createDataFrame([("Ray Soundbar", ["RAYG1US1", "ray"], ["Black"]), ("word " * 60, None, None)], "product string, mpns array<string>, specs array<string>")
    q = [r["query"] for r in links.search_query(item).collect()]
    assert q[0] == "Ray Soundbar RAYG1US1 Black" and len(q[1]) <= 150 and q[1].endswith("word")


def test_suggestions_and_circuits(spark):
    items = spark.createDataFrame([("a", "Ray Lamp Deluxe", "", None, ["M1"]), ("b", "Bulb", "Hue", [], [])], "wid string, product string, brand string, gtins array<string>, mpns array<string>")
    seen = spark.createDataFrame([("a", "ray lamp", "Sonos", ["2", "1"], ["M1"])], "wid string, title string, brand string, offer_gtins array<string>, offer_mpns array<string>")
    got = sorted(tuple(r) for r in learning.item_suggestions(items, seen).collect())
    assert got == [("a", "GTIN is blank: pages report 1, 2"), ("a", "brand is blank: pages report Sonos"), ("a", "no page has these words: deluxe"), ("b", "no GTIN or MPN known yet")]
    rows = [("d", i, i, o) for i, o in enumerate(["blocked", "no_match", "timeout_network", "blocked", "success", "blocked"])]
    df = spark.createDataFrame(rows, "domain string, ts int, ord int, outcome string")
    assert [(r["streak"], r["open"]) for r in learning.circuit_states(df).orderBy("ord").collect()] == [(1, False), (1, False), (2, False), (3, True), (0, False), (1, False)]


def test_moving_average_over_blocks(spark):
    import random

    from larkspur.operators import history

    rng = random.Random(3)
    rows = [(w, i, None if rng.random() < 0.05 else rng.uniform(-5, 100)) for w, n in (("hot", 3000), ("few", 7), ("one", 1), ("none", 0)) for i in range(n)] + [("null", 0, None), ("few", 99, 3.0)]
    for alpha, block in ((0.3, 512), (0.01, 64), (0.9, 5)):
        want, means = {}, {}
        for w, i, v in rows:
            if v is not None:
                means[w] = v if w not in means else alpha * v + (1 - alpha) * means[w]
            want[w, i] = means[w] if v is not None else None
        got = {(r["wid"], r["i"]): r["ewma"] for r in history.moving_average(spark.createDataFrame(rows, "wid string, i int, v double").repartition(5), ["i"], alpha, block).collect()}
        assert got.keys() == want.keys() and all((g is None) == (want[k] is None) and (g is None or abs(g - want[k]) < 1e-9 * max(1, abs(want[k]))) for k, g in got.items())


def test_trusted_units_enter_the_low(spark):
    from larkspur.operators import history

    stats = spark.createDataFrame([("a", 5.0, None, 1, 5.0, 5.0), ("b", 4.0, None, 1, 4.0, 4.0)], "wid string, prior double, median double, median_n long, ewma double, low double")
    units = spark.createDataFrame([("a", 4.994), ("a", 9.0), ("b", None), ("b", -1.0), ("c", 2.0), (None, 1.0)], "wid string, unit double")
    assert {r["wid"]: (r["prior"], r["median_n"], r["low"]) for r in history.with_trusted_low(stats, units).collect()} == {"a": (5.0, 1, 4.99), "b": (4.0, 1, 4.0), "c": (None, 0, 2.0)}
