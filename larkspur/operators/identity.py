"""Whether an offer is the wanted product: hard conflicts first, then identifiers, then names, as column expressions.

Pairs are items joined with their offers on the item. Item columns: product,
brand, specs, mpns, gtins, exclude (arrays; null: empty). Offer columns: title,
offer_gtins, offer_mpns, pack_qty, color.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions.ids import gtins_in_text
from larkspur.functions.similarity import is_similar
from larkspur.functions.tasks import spread

# The vocabulary of variants, and how much of a title counts.
HEAD_CHARS, HEAD_EXTRA = 70, 40
ACCESSORIES = [
    "case", "cover", "skin", "stand", "bracket", "mount", "mounting", "holder", "protector", "sticker", "decal", "replacement", "cable", "adapter",
    "charger", "sleeve", "faceplate", "trim", "bezel", "remote", "battery", "batteries", "filter", "strap", "pouch",
]
HARD_VARIANTS = ["pro", "plus", "max", "mini", "lite", "ultra", "xl", "se", "duo"]
SOFT_VARIANTS = ["ambiance", "essential", "essentials", "outdoor", "portable", "slim", "flex", "dual"]
COLOR_CODES = {
    "BLK": "black", "WHT": "white", "WH": "white", "BK": "black", "SLV": "silver", "GRY": "gray",
    "GRAY": "gray", "BLU": "blue", "RED": "red", "GRN": "green", "PNK": "pink", "GLD": "gold",
}
GENERIC = [
    "smart", "new", "the", "a", "an", "official", "wireless", "wifi", "zigbee", "bluetooth", "matter", "thread", "z", "wave", "zwave", "compact", "all", "in",
    "one", "home", "and", "with", "for", "by", "of", "premium", "original", "genuine", "brand", "latest", "version", "edition", "model", "series", "led",
    "colour", "color", "ambiance", "works", "alexa", "google", "assistant", "apple", "homekit", "hub", "required", "free", "us", "usa", "certified", "inch",
    "pack", "set", "gen", "generation", "system", "kit", "philips", "signify", "ghz", "mhz", "ft", "w", "v", "mm", "cm", "watt", "watts", "volt", "lumens", "k",
    *T.COLORS,
]
CATEGORIES = [
    "soundbar", "speaker", "speakers", "plug", "plugs", "outlet", "bulb", "bulbs", "downlight", "downlights", "light", "lights", "lamp", "strip", "bridge",
    "gateway", "switch", "dimmer", "sensor", "camera", "doorbell", "lock", "thermostat", "controller", "button", "router", "extender", "display", "tv",
    "television", "subwoofer", "sub", "fixture", "panel", "fan", "vacuum", "purifier", "receiver", "dongle", "adapter", "recessed", "can", "retrofit",
    "voice", "assistant", "satellite", "repeater", "module", "relay", "hub", "lightbulb",
]
BUNDLE_NOUNS = [
    "sub", "subwoofer", "speaker", "speakers", "soundbar", "bulb", "bulbs", "bridge", "hub", "mount", "stand", "remote", "camera", "plug", "plugs", "switch",
    "sensor", "lamp", "strip", "controller", "dimmer", "beam", "arc", "era", "move", "roam", "echo", "dot", "tv",
]
FAMILIES = {
    "sonos": ["ray", "beam", "arc", "era", "five", "move", "roam", "sub", "ace", "amp", "port", "playbar", "playbase", "symfonisk"],
    "hue": ["lightstrip", "bloom", "iris", "signe", "gradient", "centris", "festavia", "datura", "filament", "candle", "dimmer"],
    "thirdreality": ["nightlight", "button", "e2", "zp1", "zp2"],
}
REGION = (
    r"(?i)\b(?:eu|uk|au|nz|jp|cn|euro(?:pean)?|international|intl|imported|import|asian|asia|japan(?:ese)?|china|chinese|global|india|german|french|canadian|ca)"
    r"\s*[-/]?\s*(?:version|model|plug|spec|specs|edition|import|only|socket|standard)\b|\b(?:220|230|240)\s*-?\s*(?:240)?\s*v(?:olts?|ac)?\b|\bnon[- ]us\b|\btype[- ]g\b|\buk plug\b"
)
UNIVERSAL_SUPPLY = r"(?i)\b1[0-2]0\s*[-~/]\s*2[2-4]0\s*v(?:ac)?\b"
BUNDLE = r"(?i)\b(?:bundle|combo|starter\s+(?:kit|set|pack)|value\s+kit)\b"
WITH = (
    r"(?i)(?:(?<=\s)\+|\+(?=\s)|\bw/|\bbundled?\s+with|\bincludes?|\bplus|(?<!compatible )(?<!works )(?<!work )(?<!requires )(?<!require )(?<!use )(?<!connects )(?<!pairs )\bwith)"
    r"\s*(?:(?:a|an|the|\d+|two|three|four)\s*x?\s+)?([A-Za-z][A-Za-z\- ]{0,30})"
)
FOR_PRODUCT = r"\b(?:compatible with|for use with|designed for|fits|replacement for|made for|for)\s+(?:the\s+)?(?:\w+\s+){0,2}?(?:"


def _texts(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _lit(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _compact(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def _first(c: Column) -> Column:
    return F.get(F.array_sort(c), F.lit(0))


def _subset(words: Column, of: Column) -> Column:
    return F.size(F.array_except(words, of)) == 0


def code_colors(codes: Column) -> Column:
    """Colours that model codes end in, after a part with a digit; the longest ending counts."""
    ends = sorted(COLOR_CODES, key=len, reverse=True)

    def color(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for end in reversed(ends):
            out = F.when((F.length(c) >= 6) & F.endswith(c, F.lit(end)) & c.rlike(rf"\d.*{end}$"), COLOR_CODES[end]).otherwise(out)
        return out

    return F.array_distinct(F.array_compact(F.transform(codes, color)))


def item_features(items: DataFrame) -> DataFrame:
    """items with what matching needs of them, computed once for an item and not for each pair, in a struct `i`."""
    plain = F.concat(F.array("product"), _texts("specs"))
    name = T.norm_text(F.col("product"))
    words = T.words_of(name)
    brand_words = T.words_of(T.norm_text(F.col("brand")))
    brand = F.when(F.size(brand_words) == 0, F.get(words, F.lit(0))).when(F.array_contains(words, F.get(brand_words, F.lit(0))), F.get(brand_words, F.lit(0))).otherwise(F.coalesce(F.get(words, F.lit(0)), F.get(brand_words, F.lit(0))))
    out = items.withColumn("_f", F.struct(name.alias("name"), words.alias("words"), F.coalesce(brand, F.lit("")).alias("brand"), F.array_join(plain, " ").alias("text")))
    f = F.col("_f")
    rest = F.when(F.get(f["words"], F.lit(0)) == f["brand"], F.slice(f["words"], F.lit(2), F.greatest(F.size(f["words"]), F.lit(1)))).otherwise(f["words"])
    coded = F.get(F.filter(rest, lambda w: w.rlike("[a-z]") & w.rlike(r"\d")), F.lit(0))
    special = F.get(F.filter(rest, lambda w: ~w.isin(GENERIC) & ~w.isin(CATEGORIES) & ~w.rlike(r"^\d+$") & (F.length(w) >= 2)), F.lit(0))
    codes = F.array_distinct(F.filter(F.transform(_texts("mpns"), T.norm_code), lambda c: F.length(c) >= 4))
    color_words = F.array_distinct(F.flatten(F.transform(_texts("specs"), T.colors)))
    normal = T.norm_text(f["text"])
    return out.withColumn("i", F.struct(
        f["name"].alias("name"), f["words"].alias("words"), f["brand"].alias("brand"), f["text"].alias("text"), F.coalesce(coded, special).alias("model"), codes.alias("codes"),
        normal.alias("normal"), F.array_distinct(T.words_of(normal)).alias("all_words"), T.generations(normal).alias("gens"), T.volts(f["text"]).alias("volts"), T.sizes_mm(normal).alias("sizes"),
        F.array_union(color_words, code_colors(codes)).alias("colors"), T.colors(F.col("product")).alias("name_colors"), _texts("gtins").alias("gtins"),
        F.greatest(F.lit(HEAD_CHARS), F.length(f["name"]) + HEAD_EXTRA).alias("head"),
        f["text"].rlike(BUNDLE).alias("bundle"), F.regexp_replace(f["text"], UNIVERSAL_SUPPLY, " ").rlike(REGION).alias("regional"),
    )).drop("_f")


def offer_features(pairs: DataFrame) -> DataFrame:
    """pairs (with i) with a struct `o` of the title's features."""
    normal = T.norm_text(T.strip_pack_phrases(F.col("title")))
    pairs = pairs.withColumn("_n", normal).withColumn("_h", F.substr(F.col("_n"), F.lit(1), F.col("i.head")))
    codes = F.array_union(F.filter(F.transform(_texts("offer_mpns"), T.norm_code), lambda c: c != ""), T.model_codes(F.col("title")))
    return pairs.withColumn("o", F.struct(
        F.col("_n").alias("normal"), F.array_distinct(T.words_of(F.col("_n"))).alias("words"), _compact(F.col("_n")).alias("compact"),
        F.col("_h").alias("head"), T.words_of(F.col("_h")).alias("head_words"), _compact(F.col("_h")).alias("head_compact"),
        F.array_union(_texts("offer_gtins"), gtins_in_text(F.col("title"))).alias("gtins"),
        F.filter(F.transform(_texts("offer_mpns"), T.norm_code), lambda c: c != "").alias("mpns"), codes.alias("codes"),
    )).drop("_n", "_h")


def _after(words: Column, word: Column, n: int) -> Column:
    """Up to n words after the first place of word."""
    return F.slice(words, F.greatest(F.array_position(words, word), F.lit(0)).cast("int") + 1, n)


def excluded() -> Column:
    """The first exclusion that stands in the title, in order and as whole words, or as a code; null if none. Phrases of the name's own words don't count."""
    padded = F.concat(F.lit(" "), T.norm_text(F.col("title")), F.lit(" "))
    title_code = T.norm_code(F.col("title"))

    def hits(phrase: Column) -> Column:
        normal, code = T.norm_text(phrase), T.norm_code(phrase)
        stands = F.contains(padded, F.concat(F.lit(" "), normal, F.lit(" ")))
        as_code = T.looks_like_sku(phrase) & (F.array_contains(F.col("o.mpns"), code) | ((F.length(code) >= 5) & F.contains(title_code, code)))
        return (normal != "") & ~_subset(T.words_of(normal), F.col("i.words")) & (stands | as_code)

    return F.get(F.filter(_texts("exclude"), hits), F.lit(0))


def conflict() -> Column:
    """The first hard conflict of a pair, in fixed order; null if none."""
    i, o, title = F.col("i"), F.col("o"), T.text_of(F.col("title"))
    both = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0)
    apart = lambda a, b: both(a, b) & ~F.arrays_overlap(a, b)
    long_codes = F.filter(i["codes"], lambda c: F.length(c) >= 6)
    strange = F.array_except(o["codes"], long_codes)
    missing = F.filter(long_codes, lambda c: ~F.array_contains(o["codes"], c) & ~F.contains(T.norm_code(title), c))
    variant = F.exists(missing, lambda c: F.exists(strange, lambda x: T.near_variant(c, x)))
    accessory = F.array_except(F.array_intersect(o["head_words"], _lit(ACCESSORIES)), i["all_words"])
    keys = F.array_join(F.array_compact(F.array(F.nullif(i["brand"], F.lit("")), i["model"])), "|")
    worded = F.lower(title).rlike("for|fits|compatible")  # else no phrase of FOR_PRODUCT stands there
    aimed = F.when(worded, F.regexp_instr(T.norm_text(title), F.concat(F.lit(FOR_PRODUCT), keys, F.lit(r")\b")))).otherwise(0)
    lead = T.words_of(F.substr(T.norm_text(title), F.lit(1), F.greatest(aimed - 1, F.lit(0))))
    for_product = (keys != "") & (aimed > 0) & (~F.arrays_overlap(F.slice(lead, 1, 3), F.array(i["brand"], F.coalesce(i["model"], F.lit("")))) | F.arrays_overlap(lead, _lit(ACCESSORIES)))
    parts = F.flatten(F.transform(F.regexp_extract_all(F.substring(title, 1, 140), F.lit(WITH), 1), lambda p: F.slice(T.words_of(T.norm_text(p)), 1, 3)))
    extra = F.array_except(F.array_intersect(parts, _lit(BUNDLE_NOUNS)), i["all_words"])
    region = F.regexp_replace(title, UNIVERSAL_SUPPLY, " ").rlike(REGION) & ~i["regional"]
    offer_colors = F.array_union(F.array_union(F.array_except(T.colors(title), i["name_colors"]), T.colors(F.col("color"))), code_colors(o["codes"]))
    near = F.exists(i["sizes"], lambda a: F.exists(T.sizes_mm(o["normal"]), lambda b: F.abs(a - b) <= F.greatest(F.lit(1.0), a * 0.04)))
    hard = F.array_except(F.array_intersect(o["head_words"], _lit(HARD_VARIANTS)), i["all_words"])
    unnamed = F.array_contains(o["head_words"], i["brand"]) & ~F.array_contains(o["head_words"], i["model"]) & ~((F.length(i["model"]) >= 6) & F.contains(o["head_compact"], i["model"]))
    others = F.filter(_after(o["head_words"], i["brand"], 4), lambda w: ~w.isin(GENERIC) & ~w.isin(CATEGORIES) & ~w.rlike(r"^\d+$") & (F.length(w) >= 2) & ~F.array_contains(i["all_words"], w))
    family = F.lit(False)
    for name, models in FAMILIES.items():
        of = F.array_contains(i["words"], name) | F.contains(_compact(i["name"]), F.lit(name))
        family = family | (of & (F.size(F.array_except(F.array_intersect(o["head_words"], _lit(models)), i["all_words"])) > 0))
    rules = [
        (excluded().isNotNull(), F.lit("exclusion")), (apart(i["gtins"], o["gtins"]) & (F.col("pack_qty") == 1), F.lit("gtin")), (variant, F.lit("variant")),
        (F.size(accessory) > 0, F.concat(F.lit("accessory "), _first(accessory))), (for_product, F.lit("for another product")), (title.rlike(BUNDLE) & ~i["bundle"], F.lit("bundle")),
        (F.size(extra) > 0, F.concat(F.lit("bundle + "), F.get(extra, F.lit(0)))), (region, F.lit("region")), (apart(i["gens"], T.generations(o["normal"])), F.lit("generation")),
        (apart(i["colors"], offer_colors), F.lit("colour")), (apart(i["volts"], T.volts(title)), F.lit("voltage")), (both(i["sizes"], T.sizes_mm(o["normal"])) & ~near, F.lit("size")),
        (F.size(hard) > 0, F.concat(F.lit("configuration "), _first(hard))), ((i["brand"] != "") & i["model"].isNotNull() & unnamed & (F.size(others) > 0), F.lit("model")), (family, F.lit("family")),
    ]
    return reduce(lambda c, rule: c.when(*rule), rules[1:], F.when(*rules[0]))


def _in_order(names: Column, head: Column, compact: Column) -> Column:
    """Whether the names follow each other among the head's words; a name of six characters or more may also stand inside others."""
    step = lambda at, w: F.when(at < 0, at).when(
        F.array_position(F.slice(head, at + 1, 1000), w) > 0, (at + F.array_position(F.slice(head, at + 1, 1000), w)).cast("int")
    ).when(F.array_contains(head, w) | ((F.length(w) >= 6) & F.contains(compact, w)), at).otherwise(F.lit(-1))
    return F.aggregate(names, F.lit(0), step) >= 0


def classify(pairs: DataFrame, anchor: str | None = None) -> DataFrame:
    """pairs with confidence (High, Medium, Low), reason and match_evidence; anchor names a column with the head of a verified title.

    Null titles are empty and weak; pairs with a null product match nothing.
    """
    p = offer_features(pairs)
    i, o = F.col("i"), F.col("o")
    present = F.filter(i["words"], lambda w: F.array_contains(o["head_words"], w) | ((F.length(w) >= 6) & F.contains(o["head_compact"], w)))
    p = p.withColumns({
        "_conflict": conflict(), "_gtin": F.arrays_overlap(i["gtins"], o["gtins"]), "_coverage": F.when(F.size(i["words"]) > 0, F.size(present) / F.size(i["words"])).otherwise(0.0),
        "_listed": F.arrays_overlap(i["codes"], o["mpns"]),
        "_mpn": F.exists(i["codes"], lambda c: F.array_contains(o["mpns"], c) | F.contains(o["compact"], F.lower(c))),
        "_specs": F.forall(_texts("specs"), lambda s: F.forall(T.words_of(T.norm_text(s)), lambda w: F.array_contains(o["words"], w) | ((F.length(w) >= 5) & F.contains(o["compact"], w)))),
    })
    open_ = F.col("_conflict").isNull() & ~F.coalesce("_gtin", F.lit(False)) & ~F.coalesce("_mpn", F.lit(False))  # neither a conflict nor a code decides
    strong = F.col("_coverage") >= 0.75
    p = p.withColumns({
        "_close": F.coalesce(is_similar(i["name"], F.substr(o["head"], F.lit(1), F.length(i["name"]) + 10), 0.85, open_ & ~strong), F.lit(False)),
        "_mirror": F.coalesce(is_similar(F.substr(F.col(anchor), F.lit(1), i["head"]), o["head"], 0.8, open_ & strong & F.col("_specs")), F.lit(False)) if anchor else F.lit(False),
    })
    exact = (F.col("_coverage") == 1.0) & _in_order(i["words"], o["head_words"], o["head_compact"])
    swapped = (F.col("_coverage") < 1.0) & (F.size(F.array_except(F.array_intersect(o["head_words"], _lit(HARD_VARIANTS + SOFT_VARIANTS)), i["words"])) > 0)
    model_gone = F.exists(i["words"], lambda w: w.rlike("[a-z]") & w.rlike(r"\d") & ~F.array_contains(o["words"], w) & ~F.contains(o["compact"], w))
    result = lambda c, r, e: F.struct(F.lit(c).alias("c"), F.lit(r).alias("r") if isinstance(r, str) else r.alias("r"), F.lit(e).alias("e") if isinstance(e, str) else e.alias("e"))
    by_code = F.when(F.col("_listed"), "page_metadata").otherwise("mpn")
    verdict = (
        F.when(F.col("_conflict").isNotNull(), result("Low", F.col("_conflict"), ""))
        .when(F.col("_gtin"), result("High", "gtin", "gtin"))
        .when(swapped, result("Low", "variant word", "")).when(model_gone & ~F.col("_mpn"), result("Low", "model missing", ""))
        .when(F.col("_mpn") & F.col("_specs"), result("High", "code and specs", by_code)).when(F.col("_mpn"), result("Medium", "code", by_code))
        .when(exact & F.col("_specs"), result("High", "exact name", "title")).when(exact, result("Medium", "exact name", "title"))
        .when(F.col("_specs") & strong & F.col("_mirror"), result("High", "mirrors verified", "title"))
        .when(strong | F.col("_close"), result("Medium", "strong name", "title"))
        .otherwise(result("Low", "weak name", "title"))
    )
    out = p.withColumn("_v", verdict).withColumns({"confidence": F.col("_v.c"), "reason": F.col("_v.r"), "match_evidence": F.col("_v.e")})
    return out.drop("_v", "_conflict", "_gtin", "_coverage", "_listed", "_mpn", "_specs", "_close", "_mirror")


#: What an offer says that `classify` reads, beside its item.
TOLD = ["title", "offer_gtins", "offer_mpns", "pack_qty", "color"]


def classify_offers(items: DataFrame, offers: DataFrame) -> DataFrame:
    """offers (wid, TOLD and others) of items with confidence, reason and match_evidence: what several offers of an item say alike is classified once, in tasks of equal numbers of items."""
    once = offers.select("wid", *TOLD).distinct().join(item_features(spread(items, "wid")), "wid")
    found = classify(spread(once, "wid")).select("wid", *TOLD, "confidence", "reason", "match_evidence")
    on = [offers["wid"] == found["wid"], *[offers[c].eqNullSafe(found[c]) for c in TOLD]]
    return offers.join(found, on).select(offers["*"], "confidence", "reason", found["match_evidence"])


def validate_page(pairs: DataFrame) -> DataFrame:
    """pairs, also with slug and host, with the verdict on an own product link: classify's, or High where title and slug carry three quarters of the distinctive name, or the page is on the brand's own site."""
    p = classify(pairs)
    i, o = F.col("i"), F.col("o")
    words = F.array_distinct(F.concat(o["words"], T.words_of(T.norm_text(F.col("slug")))))
    compact = F.concat(o["compact"], _compact(T.norm_text(F.col("slug"))))
    implied = T.words_of(T.norm_text(F.concat_ws(" ", "host", "vendor", "offer_brand")))
    wanted = F.filter(i["words"], lambda w: ~F.array_contains(implied, w) & ~w.isin([*CATEGORIES, "smart", "the", "and", "new"]))
    wanted = F.when(F.size(wanted) > 0, wanted).otherwise(i["words"])
    have = F.filter(wanted, lambda w: F.array_contains(words, w) | ((F.length(w) >= 4) & F.contains(compact, w)))
    coded = F.forall(wanted, lambda w: ~(w.rlike(r"\d") & w.rlike("[a-z]")) | F.array_contains(have, w))
    named = coded & (F.size(wanted) > 0) & (F.size(have) / F.size(wanted) >= 0.75)
    brand = _compact(T.norm_text(F.col("brand")))
    own_site = (F.length(brand) >= 4) & F.contains(F.regexp_replace(F.lower(T.text_of(F.col("host"))), "[^a-z0-9]", ""), brand)
    hopeless = (F.col("confidence") == "Low") & ~F.col("reason").isin("weak name")
    raised = ~hopeless & (F.col("confidence") != "High") & (named | own_site)
    return p.withColumns({
        "match_evidence": F.when(raised, F.when(named, "product_url").otherwise("brand_site")).otherwise(F.col("match_evidence")),
        "confidence": F.when(raised, "High").when(~hopeless & (F.col("confidence") == "Low"), "Medium").otherwise(F.col("confidence")),
    })
