"""Text of offers as column expressions: titles, packs, prices, conditions, vendor names. Null text is empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words, pack phrases, spellings, conditions, vendor stop words, attribute words and units.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twelve": 12}
_NUMBER = r"(\d{1,3}|one|two|three|four|five|six|seven|eight|nine|ten|twelve)"
PACK_PATTERNS = [
    rf"(?i)\bpack\s+of\s+{_NUMBER}\b",
    rf"(?i)\b(?:set|lot|bundle|case|box)\s+of\s+{_NUMBER}\b",
    rf"(?i)\b{_NUMBER}\s*[- ]?\s*(?:pack|pk|pcs|pc|pieces|piece|count|ct)\b",
    r"(?i)\b(?:twin|double)\s*[- ]?\s*pack\b",
]
VENDOR_STOP_WORDS = ["the", "inc", "llc", "ltd", "co", "corp", "com", "net", "us", "usa", "official", "store", "shop", "direct", "online", "seller", "from", "www"]
COLORS = [
    "black", "white", "silver", "gray", "grey", "gold", "blue", "red", "green", "pink", "purple", "yellow", "orange", "brown", "beige",
    "navy", "charcoal", "graphite", "titanium", "bronze", "copper", "champagne", "ivory", "cream", "teal", "rose", "walnut", "oak", "chrome", "nickel",
]
LIGHT_COLOR_PHRASES = (
    r"\b(?:white and colou?r|white ambiance|colou?r ambiance|tunable white|soft white|warm white|cool white|bright white|"
    r"daylight white|full colou?r|white colou?r|rgbw?w?|rgbic|colou?r changing|multicolou?r)\b"
)
CONDITIONAL_KINDS = {
    "coupon": r"coupon|promo code|with code|clip", "membership": r"member|prime\b|club price|plus price|my best buy|walmart\+|circle", "subscription": r"subscribe|subscription|auto[- ]?ship",
    "financing": r"/\s*mo\b|per month|monthly|apr\b|affirm|klarna|afterpay|installment", "trade_in": r"trade[- ]?in", "carrier_activation": r"activation|with carrier|unlock", "in_cart": r"in cart|add to cart to see",
}
UNIT_MM = {"inch": 25.4, "in": 25.4, "ft": 304.8, "feet": 304.8, "foot": 304.8, "mm": 1.0, "cm": 10.0, "m": 1000.0, "meter": 1000.0, "meters": 1000.0, "metre": 1000.0, "metres": 1000.0}
STRAIGHT_QUOTES = ("’″”“", "'\"\"\"")
SPELLINGS = [
    (r'(\d+(?:\.\d+)?)\s*(?:"|-?\s*inch(?:es)?\b|-?\s*in\.(?=\s|$))', "$1 inch "),
    (r"\b(\d)(?:st|nd|rd|th)[\s-]*gen(?:eration)?\b", "gen$1"),
    (r"\bgeneration\s*(\d+)\b", "gen$1"),
    (r"\bgen\s*-?\s*(\d+)\b", "gen$1"),
    (r"\bwi[\s-]?fi\b", "wifi"),
    (r"(\d)(ghz|mhz|ft)\b", "$1 $2"),
    (r"[^a-z0-9.]+", " "),
    (r"(?<!\d)\.|\.(?!\d)", " "),
    (r"\s+", " "),
]
BROKEN_TEXTS, REFURBISHED_TEXTS, USED_TEXTS = "for parts|not working|broken|damaged|as[- ]is|defective", "refurb|renewed|reconditioned|recertified", r"open[- ]box|pre-?owned|\bused\b|like[- ]new"
USED_HINTS = r"open[- ]box|pre-?owned|\bused\b|like new|new other|very good|acceptable|\bgood\b|excellent"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def chain(c: Column, *steps: tuple[str, str]) -> Column:
    """c with regular expressions replaced one after another."""
    return reduce(lambda x, step: F.regexp_replace(x, *step), steps, c)


def words_of(c: Column) -> Column:
    """The non-empty words between spaces."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def norm_text(c: Column) -> Column:
    """Lower case with one spelling for inches, generations, wi-fi and numbers before units; only letters, digits and decimal points stay."""
    return F.trim(chain(F.translate(F.lower(text_of(c)), *STRAIGHT_QUOTES), *SPELLINGS))


def _number(c: Column) -> Column:
    """A digit string or number word as an integer, 1 if neither."""
    words = F.create_map(*[x for k, v in NUMBER_WORDS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.expr("try_cast(1 AS INT)") * c.try_cast("int"), F.try_element_at(words, F.lower(c)), F.lit(1))


def pack_qty(c: Column) -> Column:
    """Units in an offer: from the pack phrase that begins first; 1 without one."""
    t = text_of(c)
    found = []
    for order, pattern in enumerate(PACK_PATTERNS):
        at = F.regexp_instr(t, F.lit(pattern))
        quantity = F.lit(2) if order == 3 else F.greatest(F.lit(1), _number(F.regexp_extract(t, pattern, 1)))
        found.append(F.when(at > 0, F.struct(at.alias("at"), F.lit(order).alias("order"), quantity.alias("quantity"))))
    first = F.array_min(F.array_compact(F.array(*found)))
    return F.coalesce(first["quantity"], F.lit(1))


def strip_pack_phrases(c: Column) -> Column:
    return chain(text_of(c), *[(p, " ") for p in PACK_PATTERNS])


def bulk_sizes(c: Column) -> Column:
    """The pack sizes above 1 in a list set apart by commas or semicolons, distinct and sorted."""
    size = lambda p: F.when(pack_qty(p) > 1, pack_qty(p)).otherwise(F.regexp_extract(p, r"\d+", 0).try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text_of(c), "[;,]"), lambda p: size(F.trim(p))), lambda n: n > 1)))


def parse_price(c: Column) -> Column:
    """The first number of a text, commas dropped; null without one."""
    return F.replace(F.regexp_extract(text_of(c), r"(\d[\d,]*\.?\d*)", 1), F.lit(","), F.lit("")).try_cast("double")


def money(c: Column) -> Column:
    """Rounded half up to cents, alike in every engine."""
    return F.floor(c * 100 + 0.5000001) / 100


def condition(title: Column, hint: Column) -> Column:
    """parts, refurbished, used or new, by a title and the source's own condition field."""
    t, h = F.lower(text_of(title)), F.lower(text_of(hint))
    return (
        F.when(t.rlike(BROKEN_TEXTS) | h.contains("parts"), "parts").when(h.contains("refurb") | t.rlike(REFURBISHED_TEXTS), "refurbished")
        .when(h.rlike(USED_HINTS) | t.rlike(USED_TEXTS), "used")
        .otherwise("new")
    )


def vendor_key(c: Column) -> Column:
    """A vendor's name as a key: without scheme, domain ending and common words."""
    s = chain(F.translate(F.lower(text_of(c)), "&'’", ""), (r"^from\s+", ""), ("^https?://", ""), (r"\.(com|net|org|co)\b.*$", ""))
    return F.array_join(F.filter(F.split(s, "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(VENDOR_STOP_WORDS)), "")


def keys_match(a: Column, b: Column) -> Column:
    """Equal keys, or one of four characters or more that the other begins with. Not transitive; empty keys match nothing."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return F.coalesce((a != "") & (b != "") & ((a == b) | ((F.length(short) >= 4) & F.startswith(long, short))), F.lit(False))


def split_multi(c: Column) -> Column:
    return F.filter(F.transform(F.split(text_of(c), "[;；\r\n]"), lambda x: F.trim(x)), lambda x: x != "")


def truthy(c: Column) -> Column:
    return F.lower(F.trim(text_of(c))).isin("yes", "y", "true", "1", "1.0")


def entries(c: Column) -> Column:
    """The entries of a cell as structs (neg, text): neg for those that begin with !, which the text leaves out; specifications are tidied, model numbers stay.

    Of entries with the same words, whatever their order and spelling of inches, the first stays.
    """
    parts = F.transform(split_multi(c), lambda p: F.struct(p.startswith("!").alias("neg"), F.trim(F.ltrim(p, F.lit("!"))).alias("t")))
    tidied = F.transform(parts, lambda p: F.struct(p["neg"].alias("neg"), F.when(looks_like_sku(p["t"]), p["t"]).otherwise(tidy_spec(p["t"])).alias("text")))
    words = lambda t: F.array_join(F.array_sort(F.array_distinct(F.split(norm_text(t), " "))), " ")
    keyed = F.transform(F.filter(tidied, lambda p: p["text"] != ""), lambda p: F.struct(p["neg"].alias("neg"), p["text"].alias("text"), F.coalesce(F.nullif(words(p["text"]), F.lit("")), F.lower(p["text"])).alias("key")))
    # One array a row, so that each entry is normalised once and not anew for each comparison.
    once = F.aggregate(keyed, F.filter(keyed, lambda _: F.lit(False)), lambda seen, p: F.when(F.exists(seen, lambda q: (q["neg"] == p["neg"]) & (q["key"] == p["key"])), seen).otherwise(F.concat(seen, F.array(p))))
    return F.transform(once, lambda p: F.struct(p["neg"].alias("neg"), p["text"].alias("text")))


def wanted(c: Column) -> Column:
    """The texts of entries that don't exclude."""
    return F.transform(F.filter(c, lambda p: ~p["neg"]), lambda p: p["text"])


def exclusions(c: Column) -> Column:
    """The texts of entries that exclude."""
    return F.transform(F.filter(c, lambda p: p["neg"]), lambda p: p["text"])


def norm_code(c: Column) -> Column:
    return F.upper(F.regexp_replace(text_of(c), "[^A-Za-z0-9]", ""))


def looks_like_sku(c: Column) -> Column:
    """Five characters or more of a model number: a digit, no space, no plain measure."""
    t = F.trim(text_of(c))
    measure = t.rlike(r"(?i)^(?:gen\d+|v\d+|\d+(?:\.\d+)?(?:ghz|inch|ft|w|v|mm|cm|k|pack|pk))$")
    return (F.length(t) >= 5) & t.rlike(r"\d") & t.rlike(r"^[A-Za-z0-9\-_/.]+$") & ~measure


def model_codes(c: Column) -> Column:
    """Distinct codes of six characters or more with letters and digits that aren't measures."""
    codes = F.transform(F.regexp_extract_all(text_of(c), F.lit(r"([A-Za-z0-9][A-Za-z0-9\-]{4,}[A-Za-z0-9])"), 1), norm_code)
    measure = r"^(?:GEN\d+|\d+(?:GHZ|MHZ|MM|CM|FT|IN|INCH|W|V|K|MAH|PACK|PK))$"
    return F.array_sort(F.array_distinct(F.filter(codes, lambda x: (F.length(x) >= 6) & x.rlike(r"\d") & x.rlike("[A-Z]") & ~x.rlike(measure))))


def code_shape(c: Column) -> Column:
    return chain(c, ("[A-Z]", "A"), (r"\d", "9"))


def near_variant(a: Column, b: Column) -> Column:
    """Codes that differ in a colour or region part only: as long, at most three characters apart, the rest a shared start and end."""
    a, b = norm_code(a), norm_code(b)
    n = F.length(a)
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y)
    apart = F.size(F.filter(same, lambda s: ~s))
    first, last = F.array_position(same, False), F.array_position(F.reverse(same), False)
    return F.coalesce((a != b) & (n >= 6) & (n == F.length(b)) & (apart <= 3) & (first - 1 + last - 1 >= n - 3) & ((code_shape(a) == code_shape(b)) | (first - 1 >= 4)), F.lit(False))


def sizes_mm(normal: Column) -> Column:
    """Distinct lengths of a normalised text in millimetres, to one place."""
    found = F.regexp_extract_all(normal, F.lit(r"\b(\d+(?:\.\d+)?\s*(?:inch|in(?!\s+\d)|ft|feet|foot|mm|cm|m(?!\s+\d)|meters?|metres?))\b"), 1)
    units = F.create_map(*[x for k, v in UNIT_MM.items() for x in (F.lit(k), F.lit(v))])
    mm = lambda s: F.round(F.regexp_extract(s, r"^[\d.]+", 0).try_cast("double") * F.try_element_at(units, F.regexp_extract(s, r"[a-z]+$", 0)), 1)
    return F.array_sort(F.array_distinct(F.transform(found, mm)))


def generations(normal: Column) -> Column:
    both = F.concat(F.regexp_extract_all(normal, F.lit(r"\bgen(\d+)\b"), 1), F.regexp_extract_all(normal, F.lit(r"\b(?:v|mk|mark|version)\s?(\d)\b"), 1))
    return F.array_sort(F.array_distinct(both))


def colors(c: Column) -> Column:
    """Colour words, those of light colours apart; "rose" counts in "rose gold" only."""
    t = F.regexp_replace(norm_text(c), LIGHT_COLOR_PHRASES, " ")
    plain = F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w.isin([x for x in COLORS if x != "rose"])))
    return F.array_sort(F.when(t.contains("rose gold"), F.array_append(plain, F.lit("rose gold"))).otherwise(plain))


def volts(c: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text_of(c), F.lit(r"(?i)\b(\d{2,3})\s*(?:-\s*\d{2,3}\s*)?v(?:olts?|ac|dc)?\b"), 1), lambda v: v.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda v: v.between(3, 480))))


def shipping_of(c: Column) -> Column:
    """0 for free shipping, the amount before or after "shipping" or "delivery", else null."""
    t = F.lower(text_of(c))
    patterns = (r"\$\s*([\d,]+(?:\.\d{2})?)\s*(?:delivery|shipping)", r"(?:shipping|delivery)\s*\$\s*([\d,]+(?:\.\d{2})?)")
    amount = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in patterns])
    return F.when(t.rlike(r"free (?:delivery|shipping)|free\s*$|\$0(?:\.00)? (?:delivery|shipping)"), F.lit(0.0)).otherwise(parse_price(amount))


def conditional_kind(c: Column) -> Column:
    """The first kind of condition that a price text names, and up to 30 characters around it, as a struct; both empty without one."""
    t = text_of(c)
    kind, detail = F.lit(""), F.lit("")
    for name, pattern in reversed(CONDITIONAL_KINDS.items()):
        kind = F.when(t.rlike(f"(?i){pattern}"), name).otherwise(kind)
        detail = F.when(t.rlike(f"(?i){pattern}"), F.trim(F.regexp_extract(t, rf"(?is)(.{{0,30}}(?:{pattern}).{{0,30}})", 1))).otherwise(detail)
    return F.struct(kind.alias("kind"), detail.alias("detail"))


def foreign_price(c: Column) -> Column:
    """Whether a price text names another currency than the dollar of the US."""
    return text_of(c).rlike(r"[£€¥₹₩]|(?<![A-Za-z])(?!US\$)[A-Za-z]{1,3}\$")


def availability(c: Column) -> Column:
    """A schema.org or free text as a struct of label and in_stock: null where it says neither."""
    a = F.regexp_replace(F.lower(text_of(c)), "[ _-]", "")
    negative = a.rlike("unavailable|notavailable")
    label = (
        F.when(a.rlike("preorder|presale"), "preorder").when(a.contains("backorder"), "backorder").when(a.contains("limitedavailability"), "limited")
        .when(a.rlike("instock|onlineonly|instoreonly|available|addtocart|true") & ~negative, "in_stock").when(negative | a.rlike("outofstock|soldout|discontinued|false"), "out_of_stock").otherwise("")
    )
    return F.struct(label.alias("label"), F.when(label.isin("limited", "in_stock"), True).when(label == "out_of_stock", False).alias("in_stock"))


def schema_condition(c: Column) -> Column:
    t = F.lower(text_of(c))
    return F.when(t.contains("refurb"), "refurbished").when(t.rlike("used|damaged"), "used").otherwise("new")


def vendor_display(c: Column) -> Column:
    """The market place of "Market - seller"."""
    return F.trim(F.get(F.split(text_of(c), " - "), F.lit(0)))


def tidy_spec(c: Column) -> Column:
    """A specification with "inch" where a bare "in" follows a number; "4 in 1" and "in-wall" stay."""
    return F.regexp_replace(text_of(c), r"(?i)(?<=\d)\s*in\b(?![-\s]*\d)(?!-)", " inch")
