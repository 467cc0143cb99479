"""Products and offers in a page's JSON, read as VARIANT inside the JVM.

A JSON text becomes a variant; its nested objects are gathered level by level,
and what they say is taken by tables of properties. All are
expressions of one page, so nothing leaves its row and no Python runs; steps
are columns of their own, so that the analyzer needn't nest them all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of nested objects and lists that are looked into.
DEPTH = 8

# Properties and types of schema.org, and keys of shops' page states. Earlier ones count first.
PRODUCT_TYPES = ["Product", "ProductGroup", "IndividualProduct", "ProductModel"]
GTIN_PROPERTIES = ["gtin", "gtin8", "gtin12", "gtin13", "gtin14", "upc", "ean", "isbn"]
PRODUCT_ID_SCHEMES = ["gtin", "upc", "ean"]
LIST_PRICE_TYPES = ["listprice", "strikethroughprice", "msrp", "srp", "minimumadvertisedprice"]
VARIANT_PROPERTIES = ["color", "size", "pattern", "material"]
PACK_WORDS = ["pack", "quantity", "count", "qty"]
STATE_NAMES = ["name", "title", "productName"]
STATE_CODES = ["sku", "skuId", "upc", "gtin", "modelNumber", "mpn"]
STATE_PRICES = ["customerPrice", "currentPrice", "salePrice", "finalPrice", "dellPrice", "sellingPrice", "offerPrice", "priceValue", "price", "amount"]
STATE_REGULAR_PRICES = ["regularPrice", "listPrice", "wasPrice", "originalPrice", "compareAtPrice", "compare_at_price", "msrp", "MSRP", "strikePrice", "strikethroughPrice", "basePrice"]
STATE_AMOUNTS = ["value", "amount", "price", "current", "raw"]
STATE_STOCK = ["availability", "stockStatus", "buttonState", "inStock", "available"]
STATE_CONDITIONAL_PRICES = {
    "memberPrice": "membership", "clubPrice": "membership", "plusPrice": "membership", "primePrice": "membership", "couponPrice": "coupon", "priceWithCoupon": "coupon", "subscriptionPrice": "subscription",
    "subscribeAndSavePrice": "subscription", "snsPrice": "subscription", "tradeInPrice": "trade_in", "priceWithTradeIn": "trade_in", "monthlyPrice": "financing", "financePrice": "financing", "installmentPrice": "financing",
    "activationPrice": "carrier_activation",
}
STATE_SCRIPTS = r"""(?is)<script[^>]+(?:id=["']__NEXT_DATA__["']|type=["']application/json["'])[^>]*>(.*?)</script>"""
STATE_VARIABLES = r"(?s)window\.(?:__INITIAL_STATE__|__PRELOADED_STATE__|__APOLLO_STATE__|__STATE__|__NUXT__|__PRODUCT__|productData|__data)\s*=\s*(\{.*?\})\s*;?\s*</script>"
MONTHLY = r"(?i)/\s*mo|per month|apr"

_VARIANTS, _TEXTS = "array<variant>", "array<string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def field(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$['{key}']", kind)


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def listed(v: Column, key: str) -> Column:
    """The values of a property: those of its list, or its one value."""
    return F.coalesce(field(v, key, _VARIANTS), F.array_compact(F.array(field(v, key))))


def things(v: Column, key: str) -> Column:
    """The objects among the values of a property."""
    return F.filter(listed(v, key), is_object)


def plain(v: Column) -> Column:
    """A value as text: a list's first, an object's name or @id; empty without one."""
    one = F.coalesce(F.try_variant_get(v, "$[0]", "variant"), v)
    named = lambda x: F.when(is_object(x), F.coalesce(F.nullif(field(x, "name", "string"), F.lit("")), field(x, "@id", "string"))).otherwise(F.try_variant_get(x, "$", "string"))
    return F.trim(F.coalesce(let(one, named), F.lit("")))


def text(v: Column, *keys: str) -> Column:
    """The first of some properties that has a text; empty without one."""
    return F.coalesce(*[F.nullif(plain(field(v, k)), F.lit("")) for k in keys], F.lit(""))


def amount(t: Column) -> Column:
    """The first number of a text."""
    return F.replace(F.nullif(F.regexp_extract(t, r"(\d[\d,]*\.?\d*)", 1), F.lit("")), F.lit(","), F.lit("")).try_cast("double")


def types(v: Column) -> Column:
    return F.coalesce(field(v, "@type", _TEXTS), F.array_compact(F.array(field(v, "@type", "string"))))


def read(t: Column) -> Column:
    """A JSON text as a variant, forgiving commas before closing brackets and raw line ends; null if it can't be read."""
    return F.coalesce(F.try_parse_json(t), F.try_parse_json(F.replace(F.regexp_replace(t, r",\s*([}\]])", "$1"), F.lit("\n"), F.lit(" "))))


def nested(docs: Column, skip: str = "") -> Column:
    """The objects in variants, level by level, lists in order and an object's properties in the order of their names; what the property `skip` holds is left out."""
    inside = lambda m: F.map_values(F.map_filter(m, lambda k, _: k != skip) if skip else m)
    children = lambda v: F.coalesce(F.try_variant_get(v, "$", _VARIANTS), inside(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast(_VARIANTS))
    level = lambda a: F.flatten(F.transform(F.slice(a["all"], a["at"] + 1, F.greatest(F.size(a["all"]), F.lit(1))), children))
    step = lambda a, _: F.struct(F.concat(a["all"], level(a)).alias("all"), F.size(a["all"]).alias("at"))
    start = F.struct(docs.alias("all"), F.lit(0).alias("at"))
    return F.filter(F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), start, step, lambda a: a["all"]), is_object)


def gtins(v: Column) -> Column:
    """A node's GTINs as written, and that of its product id where its scheme is one."""
    own = F.flatten(F.array(*[F.transform(listed(v, k), plain) for k in GTIN_PROPERTIES]))
    pid = F.coalesce(field(v, "productID", "string"), F.lit(""))
    scheme = F.exists(F.array(*map(F.lit, PRODUCT_ID_SCHEMES)), lambda s: F.startswith(F.lower(pid), s))
    return F.filter(F.concat(own, F.when(scheme, F.array(F.substring_index(pid, ":", -1))).otherwise(F.array().cast(_TEXTS))), lambda x: x != "")


def _units(products: Column) -> Column:
    """(i, own, v, o) of the offers o of products by number, with the variant v that has them (an empty one for the product's own)."""
    unit = lambda i, own, v: lambda o: F.struct(i.alias("i"), F.lit(own).alias("own"), v.alias("v"), o.alias("o"))
    empty = F.try_parse_json(F.lit("{}"))
    return F.flatten(F.transform(products, lambda p, i: F.concat(
        F.flatten(F.transform(things(p, "hasVariant"), lambda v: F.transform(things(v, "offers"), unit(i, True, v)))), F.transform(things(p, "offers"), unit(i, False, empty)),
    )))


def _unfolded(units: Column) -> Column:
    """units with the offers inside aggregate ones instead of these."""
    inner = lambda u: F.transform(things(u["o"], "offers"), lambda o: F.struct(u["i"].alias("i"), u["own"].alias("own"), u["v"].alias("v"), o.alias("o")))
    return F.flatten(F.transform(units, lambda u: F.when(F.array_contains(types(u["o"]), "AggregateOffer") & (F.size(things(u["o"], "offers")) > 0), inner(u)).otherwise(F.array(u))))


def _told(u: Column) -> Column:
    """u with its price specifications, and the further properties of its variant."""
    spec = lambda s: F.struct(
        amount(field(s, "price", "string")).alias("amount"), F.lower(F.substring_index(F.coalesce(field(s, "priceType", "string"), F.lit("")), "/", -1)).alias("kind"),
        (field(s, "validForMemberTier").isNotNull() | field(s, "eligibleCustomerType").isNotNull()).alias("tied"), field(s, "priceCurrency", "string").alias("currency"),
    )
    pair = lambda p: F.struct(F.lower(text(p, "name")).alias("name"), text(p, "value").alias("value"))
    specs = F.filter(F.transform(things(u["o"], "priceSpecification"), spec), lambda s: s["amount"].isNotNull())
    more = F.filter(F.transform(things(u["v"], "additionalProperty"), pair), lambda p: p["value"] != "")
    return F.struct(u["i"].alias("i"), u["own"].alias("own"), u["v"].alias("v"), u["o"].alias("o"), specs.alias("specs"), more.alias("more"))


def _priced(u: Column) -> Column:
    """u with its prices, and with what tells its variant from others."""
    o, v, specs, more = u["o"], u["v"], u["specs"], u["more"]
    member = lambda s: s["tied"] | F.contains(s["kind"], F.lit("member"))
    usual = lambda s: s["kind"].isin(LIST_PRICE_TYPES)
    end = lambda found, none: F.element_at(F.concat(F.array(none), found), -1)
    last = lambda keep: end(F.transform(F.filter(specs, keep), lambda s: s["amount"]), F.lit(None).cast("double"))
    named = lambda words: end(F.transform(F.filter(more, lambda p: p["name"].rlike("|".join(words))), lambda p: p["value"]), F.lit(""))
    first = F.get(F.filter(specs, lambda s: ~member(s) & ~usual(s)), F.lit(0))["amount"]
    price = F.coalesce(amount(field(o, "price", "string")), first)
    lowest = price.isNull() & F.array_contains(types(o), "AggregateOffer")
    currency = F.coalesce(F.nullif(field(o, "priceCurrency", "string"), F.lit("")), F.get(F.filter(F.transform(specs, lambda s: s["currency"]), lambda c: c != ""), F.lit(0)), F.lit("USD"))
    parts = F.concat(F.array(*[text(v, k) for k in VARIANT_PROPERTIES]), F.transform(more, lambda p: p["value"]))
    return F.struct(
        u["i"].alias("i"), u["own"].alias("own"), v.alias("v"), o.alias("o"), F.when(lowest, amount(field(o, "lowPrice", "string"))).otherwise(price).alias("price"), last(lambda s: ~member(s) & usual(s)).alias("regular"),
        F.upper(currency).alias("currency"), last(member).alias("tied"), lowest.alias("lowest"), F.array_join(_some(parts), " / ").alias("label"), named(PACK_WORDS).alias("pack"), named(["color", "colour"]).alias("color"),
    )


def _offer(u: Column) -> Column:
    """What an offer says; identifiers are its own or its variant's, never the product's, since a multipack has its own."""
    o, v = u["o"], u["v"]
    rate = F.get(F.flatten(F.transform(things(o, "shippingDetails"), lambda s: things(s, "shippingRate"))), F.lit(0))
    either = lambda *keys: F.coalesce(F.nullif(text(o, *keys), F.lit("")), text(v, *keys))
    return F.struct(
        u["i"].alias("i"), u["own"].alias("own"), u["price"].alias("price"), F.when(u["regular"] > u["price"], u["regular"]).alias("regular"), u["currency"].alias("currency"), text(o, "availability").alias("availability"),
        text(o, "itemCondition").alias("condition"), either("sku").alias("sku"), F.coalesce(F.array_min(F.concat(gtins(o), gtins(v))), F.lit("")).alias("gtin"), either("mpn").alias("mpn"), text(v, "name").alias("name"),
        amount(field(rate, "value", "string")).alias("shipping"), u["label"].alias("variant"), text(v, "sku", "productID").alias("variant_id"), either("url").alias("url"), F.coalesce(F.nullif(u["color"], F.lit("")), text(v, "color")).alias("color"),
        F.when(u["pack"].rlike(r"^\d+$"), F.concat(F.lit("pack of "), u["pack"])).otherwise(u["pack"]).alias("pack"),
        F.when(u["tied"].isNotNull(), F.concat(F.lit("member price $"), F.format_number(u["tied"], 2))).alias("member"), u["lowest"].alias("lowest"),
    )


def _product(v: Column) -> Column:
    return F.struct(text(v, "name").alias("name"), text(v, "brand", "manufacturer").alias("brand"), text(v, "color").alias("color"), gtins(v).alias("gtins"), F.array(text(v, "mpn"), text(v, "model")).alias("mpns"), text(v, "sku").alias("sku"))


def _some(c: Column) -> Column:
    return F.array_distinct(F.filter(c, lambda x: x != ""))


def _then(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column set; through explode of one value, so that the optimizer doesn't write the steps into each other, which would make plans of a size that is exponential in them."""
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def with_json_ld(pages: DataFrame, blocks: Column, out: str) -> DataFrame:
    """pages with a struct `out` of their products by JSON-LD texts (blocks, an array): name, brand, color, gtins, mpns, skus as written, offers in dollars, and unread, the number of texts that aren't JSON.

    A variant is no product of its own; a product without variants' offers has
    its own. The lowest price of an aggregate counts only without other offers.
    """
    docs, products, units, found = (f"{out}_{x}" for x in ("docs", "products", "units", "found"))
    kinds = F.array(*map(F.lit, PRODUCT_TYPES))
    p = _then(pages, docs, F.transform(blocks, lambda t: read(F.trim(t))))
    p = _then(p, products, F.filter(nested(F.filter(docs, lambda d: d.isNotNull()), skip="hasVariant"), lambda v: F.arrays_overlap(types(v), kinds)))
    p = _then(p, units, _units(F.col(products)))
    for _ in range(2):  # aggregate offers inside aggregate ones
        p = _then(p, units, _unfolded(F.col(units)))
    for step in (_told, _priced, _offer):
        p = _then(p, units, F.transform(units, step))
    p = _then(p, units, F.filter(units, lambda u: (u["price"] > 0) & (u["currency"] == "USD")))
    p = _then(p, units, F.filter(units, lambda u: u["own"] | ~F.exists(units, lambda w: w["own"] & (w["i"] == u["i"]))))
    p = _then(p, found, F.transform(products, _product))
    first = lambda n: F.coalesce(F.get(F.filter(F.transform(found, lambda x: x[n]), lambda x: x != ""), F.lit(0)), F.lit(""))
    every = lambda n: F.flatten(F.transform(found, lambda x: x[n]))
    real = F.filter(units, lambda o: ~o["lowest"])
    page = F.struct(
        first("name").alias("name"), first("brand").alias("brand"), first("color").alias("color"), _some(every("gtins")).alias("gtins"), _some(F.concat(every("mpns"), F.transform(units, lambda o: o["mpn"]))).alias("mpns"),
        _some(F.transform(found, lambda x: x["sku"])).alias("skus"), F.when(F.size(real) > 0, real).otherwise(F.col(units)).alias("offers"), F.size(F.filter(docs, lambda x: x.isNull())).alias("unread"),
    )
    return _then(p, out, page).drop(docs, products, units, found)


def _number(v: Column) -> Column:
    """A price of a page state: a number, a text that is no monthly rate, or the first of STATE_AMOUNTS in an object."""
    scalar = lambda t: F.when(~t.rlike(MONTHLY), amount(t))
    inside = F.coalesce(*[field(v, k) for k in STATE_AMOUNTS])
    value = F.when(is_object(v), F.when(is_object(inside), F.coalesce(*[field(inside, k, "string") for k in STATE_AMOUNTS])).otherwise(F.try_variant_get(inside, "$", "string"))).otherwise(F.try_variant_get(v, "$", "string"))
    return let(value, lambda t: let(scalar(t), lambda x: F.when(x > 0, x)))


def with_state_offer(pages: DataFrame, html: Column, target: Column, out: str) -> DataFrame:
    """pages with a struct `out` of the best product in their embedded states: an object with a name or identifier beside a price between 0.25 and 4 times the target (null: any); identifiers first, then the first. Null without one."""
    found = f"{out}_found"
    texts = F.concat(F.regexp_extract_all(html, F.lit(STATE_SCRIPTS), 1), F.regexp_extract_all(html, F.lit(STATE_VARIABLES), 1))
    has = lambda v, keys: F.coalesce(*[field(v, k) for k in keys]).isNotNull()
    first = lambda v, keys: F.coalesce(*[_number(field(v, k)) for k in keys])
    p = _then(pages, found, F.array_compact(F.transform(texts, lambda t: F.try_parse_json(F.trim(t)))))
    p = _then(p, found, F.filter(nested(F.col(found)), lambda v: has(v, STATE_NAMES + STATE_CODES) & has(v, STATE_PRICES)))
    p = _then(p, found, F.transform(found, lambda v: F.struct(v.alias("v"), first(v, STATE_PRICES).alias("price"), has(v, STATE_CODES).alias("coded"))))
    fits = lambda x: (x["price"] > 0) & (target.isNull() | x["price"].between(target * 0.25, target * 4))
    p = _then(p, found, F.filter(found, fits))
    p = _then(p, found, F.coalesce(F.get(F.filter(found, lambda x: x["coded"]), F.lit(0)), F.get(found, F.lit(0))))
    v, price, regular = F.col(found)["v"], F.col(found)["price"], first(F.col(found)["v"], STATE_REGULAR_PRICES)
    tied = F.coalesce(*[F.concat(F.lit(f"{kind} price $"), F.format_number(_number(field(v, k)), 2)) for k, kind in STATE_CONDITIONAL_PRICES.items()])
    offer = F.struct(
        price.alias("price"), F.when(regular > price, regular).alias("regular"), text(v, *STATE_NAMES).alias("name"), text(v, "sku", "skuId").alias("sku"), text(v, "upc", "gtin").alias("gtin"),
        text(v, "modelNumber", "mpn").alias("mpn"), text(v, *STATE_STOCK).alias("availability"), tied.alias("member"),
    )
    return _then(p, out, F.when(F.col(found).isNotNull(), offer)).drop(found)
