import pytest
from pyspark.sql import functions as F

from larkspur.functions import ids, text, urls
from larkspur.functions.similarity import sequence_ratio


@pytest.fixture
def value(spark):
    def of(function, *args):
        df = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
        return df.select(function(*[F.col(c) for c in df.columns]).alias("v")).first()["v"]

    return of


@pytest.mark.parametrize("title, normal", [
    ('Smart Plug 4" Gen 3', "smart plug 4 inch gen3"), ("4-inch 2nd Gen Wi-Fi", "4 inch gen2 wifi"), ("2.4ghz radio. Fine.", "2.4 ghz radio fine"),
    ("generation 2 a.b 1.5", "gen2 a b 1.5"), (None, ""), ("Été, ça", "t a"),
])
def test_norm_text(value, title, normal):
    assert value(text.norm_text, title) == normal


@pytest.mark.parametrize("title, n", [
    ("Bulb (pack of 4)", 4), ("Set of three bulbs", 3), ("2-Pack plug", 2), ("twin pack", 2), ("a bulb", 1), ("4 pack, set of 2", 4), ("12 ct", 12), ("1st lot of twelve", 12), (None, 1), ("", 1),
])
def test_pack_qty(value, title, n):
    assert value(text.pack_qty, title) == n


def test_prices_and_packs(value):
    assert value(text.parse_price, "$1,299.00") == 1299.0
    assert value(text.parse_price, "junk") is None and value(text.parse_price, None) is None
    assert value(text.bulk_sizes, "2Pack; 4 Pack, 1, 6") == [2, 4, 6]
    assert value(text.strip_pack_phrases, "Plug 2-Pack white").split() == ["Plug", "white"]
    assert value(text.shipping_of, "Free delivery") == 0 and value(text.shipping_of, "+ $5.99 shipping") == 5.99 and value(text.shipping_of, "soon") is None


@pytest.mark.parametrize("title, hint, kind", [
    ("Phone for parts", "", "parts"), ("Renewed phone", "", "refurbished"), ("Phone", "Very Good", "used"), ("Open-box phone", "", "used"), ("Phone", None, "new"), (None, "Refurbished", "refurbished"),
])
def test_condition(value, title, hint, kind):
    assert value(text.condition, title, hint) == kind


@pytest.mark.parametrize("name, key", [("Amazon.com - Seller", "amazon"), ("The Home Depot", "homedepot"), ("from Best Buy, Inc", "bestbuy"), ("B&H Photo", "bhphoto"), (None, ""), ("https://www.x.co/y", "x")])
def test_vendor_key(value, name, key):
    assert value(text.vendor_key, name) == key


@pytest.mark.parametrize("a, b, ok", [("amazon", "amazonmarket", True), ("amazon", "amazon", True), ("abc", "abcd", False), ("", "", False), (None, "amazon", False), ("walmart", "target", False)])
def test_keys_match(value, a, b, ok):
    assert value(text.keys_match, a, b) is ok and value(text.keys_match, b, a) is ok


@pytest.mark.parametrize("a, b, ok", [("RAYG1US1BLK", "RAYG1US1WHT", True), ("RAYG1US1BLK", "RAYG1EU1BLK", True), ("RAYG1US1", "RAYG1US1", False), ("ABCDEF1", "GHIJKL2", False), ("AB1", "AB2", False)])
def test_near_variant(value, a, b, ok):
    assert value(text.near_variant, a, b) is ok


def test_attributes(value):
    assert value(text.colors, "White and color ambiance, Rose Gold, black") == ["black", "gold", "rose gold"]
    assert value(text.sizes_mm, "4 inch 2 ft 10 cm") == [100.0, 101.6, 609.6]
    assert value(text.generations, "gen2 mk 3 v4") == ["2", "3", "4"]
    assert value(text.volts, "120V or 12 VDC, 900v") == [12, 120]
    assert value(text.model_codes, "RAYG1US1BLK soundbar ABC-1234 100MM") == ["ABC1234", "RAYG1US1BLK"]
    assert [value(text.looks_like_sku, x) for x in ("RAYG1US1BLK", "609404", "gen33", "4 inch", "2.4ghz", None)] == [True, True, False, False, False, False]


@pytest.mark.parametrize("code, valid", [("036000291452", True), ("036000291453", False), ("4006381333931", True), ("96385074", True), ("12345", False), (None, False)])
def test_gtin(value, code, valid):
    assert value(ids.gtin_valid, code) is valid
    assert value(ids.normalize_gtin, code) == (code.rjust(14, "0") if valid else None)


def test_ids(value):
    assert value(ids.gtins_in_text, "UPC 036000291452, EAN 4006381333931, 1036000291452999") == ["00036000291452", "04006381333931"]
    assert value(ids.fingerprint, "a", None, "b") == __import__("hashlib").sha1(b"a||b").hexdigest()[:12]
    assert value(ids.upc, "00036000291452") == "036000291452" and value(ids.upc, "1234567890123") == "1234567890123"


@pytest.mark.parametrize("url, normal", [
    ("HTTPS://WWW.Shop.com//a//b/?utm_source=x&b=2&a=1&empty=#top", "https://www.shop.com/a/b?a=1&b=2"), ("http://x.com", "http://x.com/"), ("not a url", "not a url"), (None, ""),
    ("https://x.com/p?variant=12&gclid=1&REF=z", "https://x.com/p?variant=12"),
])
def test_normalize_url(value, url, normal):
    assert value(urls.normalize_url, url) == normal


def test_urls(value):
    assert [value(urls.host_of, u) for u in ("https://www2.Shop.com:80/x", "https://m.x.com", "https://shop.x.com/", None)] == ["shop.com", "x.com", "x.com", ""]
    assert value(urls.merchant_item_id, "https://www.amazon.com/dp/B0ABCDEFGH/ref=x") == "B0ABCDEFGH"
    assert value(urls.merchant_item_id, "https://x.com/products/Blue-Bulb?variant=77") == "v77" and value(urls.merchant_item_id, "https://x.com/products/Blue-Bulb") == "h:blue-bulb"
    assert [value(urls.is_listing_page, u) for u in ("https://x.com/", "https://x.com/search?q=a", "https://x.com/products/a", "https://x.com/collections/all", "https://x.com/en-us/")] == [True, True, False, True, True]
    assert [value(urls.us_locale_ok, u) for u in ("https://x.com/en-gb/a", "https://x.com/en_us/a", "https://x.com/a")] == [False, True, True]
    assert value(urls.urls_in, "see https://a.com/x, https://b.com and https://a.com/x") == ["https://a.com/x", "https://b.com"]


def test_similarity(value):
    assert value(sequence_ratio, "abcd", "bcde") == 0.75 and value(sequence_ratio, None, None) == 1.0
