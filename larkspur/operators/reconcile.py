"""One offer seen through several sources: ids, merging with provenance, cross-source twins, promotion on independent agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.ids import fingerprint
from larkspur.functions.similarity import is_similar
from larkspur.functions.tasks import dealt, spread
from larkspur.functions.text import keys_match, norm_code, norm_text, strip_pack_phrases, text_of, vendor_key
from larkspur.functions.urls import merchant_item_id, normalize_url
from larkspur.operators.pricing import BIN_RATIO, BIN_REACH, VERIFIED, verified

# Order of evidence and confidence, agreement of prices.
EVIDENCE_RANK = {"verified_direct": 0, "verified_discovered": 1, "market_snapshot": 2}
CONFIDENCE_RANK = {"High": 0, "Medium": 1}
PRICE_AGREE, STALE = 0.15, 0.02
TITLE_CHARS, TITLE_RATIO = 90, 0.85
#: Keys of one code that meet others' in one task.
PAIR_KEYS = 2000


def offer_id() -> Column:
    """A stable id from vendor, merchant id or URL, condition, variant and pack size."""
    known = F.coalesce(F.nullif(F.col("merchant_item_id"), F.lit("")), F.lit(""))
    url = normalize_url(F.col("url"))
    snapshot = F.concat(F.lit("snap:"), F.when(known != "", known).otherwise(F.substring(norm_text(strip_pack_phrases(F.col("title"))), 1, 60)))
    page = F.coalesce(F.nullif(known, F.lit("")), F.nullif(merchant_item_id(F.col("url")), F.lit("")), url)
    place = F.when(F.col("source") == "ebay", F.when(known != "", known).otherwise(url)).when(F.col("evidence") == "market_snapshot", snapshot).otherwise(page)
    vendor = F.coalesce(F.nullif(vendor_key(F.col("vendor")), F.lit("")), F.lit("unknown"))
    variant = F.coalesce(F.nullif(text_of(F.col("variant_id")), F.lit("")), F.substring(norm_text(F.col("variant")), 1, 30))
    return fingerprint(vendor, place, F.coalesce(F.nullif(F.col("condition"), F.lit("")), F.lit("new")), variant, F.col("pack_qty"))


def rank_of(column: str, ranks: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for value, rank in ranks.items():
        out = F.when(F.col(column) == value, rank).otherwise(out)
    return out


def authority() -> list[Column]:
    """Order of trust: own links, evidence, confidence, known stock."""
    return [~F.coalesce("from_url", F.lit(False)), rank_of("evidence", EVIDENCE_RANK, 9), rank_of("confidence", CONFIDENCE_RANK, 2), F.col("in_stock").isNull()]


def merge_duplicates(listings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, of the highest authority (`order` breaks ties), with corroborated_by: the distinct "source/evidence" of the other rows that differ from it.

    A partial aggregation on each task, so a hot offer meets as one row a task.
    """
    rank = F.struct(*[c.alias(f"a{i}") for i, c in enumerate(authority())], *order)
    rest = [c for c in listings.columns if c not in keys]
    seen = F.concat_ws("/", "source", "evidence")
    merged = listings.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("best"), F.collect_set(seen).alias("seen"))
    own = F.concat_ws("/", F.col("best.source"), F.col("best.evidence"))
    return merged.select(*keys, "best.*", F.array_sort(F.filter("seen", lambda s: s != own)).alias("corroborated_by"))


def merge_twins(offers: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(offers that stay, twins): a snapshot whose merchant's verified offer with equal keys is there goes, noted as agreeing or stale in twins (keys, both prices).

    Vendors match loosely (keys_match), so vendor keys are a condition of the join on `keys`, which must be narrow (item, condition, pack, fingerprint).
    """
    sure = F.col("confidence") != "Low"
    v = offers.where(verified() & sure).select(*keys, F.col("vkey").alias("_vkey"), F.col("unit_price").alias("verified_price"), F.struct(*authority(), *order).alias("_rank"))
    snaps = offers.where((F.col("evidence") == "market_snapshot") & sure)
    pairs = snaps.join(v, keys).where(keys_match(F.col("vkey"), F.col("_vkey")))
    first = pairs.groupBy(*keys, "vkey", *[c for c in order if c not in keys and c != "vkey"], "unit_price").agg(F.min_by("verified_price", "_rank").alias("verified_price"))
    differs = F.abs(F.col("unit_price") - F.col("verified_price")) / F.col("verified_price")
    twins = first.withColumn("note", F.when(F.coalesce(differs, F.lit(0.0)) > STALE, "stale").otherwise("agrees"))
    gone = twins.select(*keys, "vkey", *[c for c in order if c not in keys and c != "vkey"], "unit_price")
    on = [offers[c].eqNullSafe(gone[c]) for c in gone.columns]
    stay = offers.join(gone, [*on, offers["evidence"] == "market_snapshot", offers["confidence"] != "Low"], "left_anti")
    return stay, twins


def price_bin(price: Column) -> Column:
    """The bin of a positive price; prices within PRICE_AGREE of each other are BIN_REACH bins apart at most."""
    return F.floor(F.log(price) / F.log(F.lit(BIN_RATIO))).cast("int")


def title_head(title: Column) -> Column:
    """What titles are compared by."""
    return F.substring(norm_text(strip_pack_phrases(title)), 1, TITLE_CHARS)


def promote(offers: DataFrame, order: list[str]) -> DataFrame:
    """offers with promoted, for a Medium offer with an ordinary price: null, or the first that holds of
    "identifier" - identifier evidence, and the price of an independent High offer of its item and pack is within PRICE_AGREE,
    "title" - its title mirrors that of such an offer that is verified, and
    "shared code" - it is verified itself and shares a GTIN or code with an independent High offer of its item.
    Independent: another vendor, or other evidence. Columns title, gtins and mpns (arrays) may be missing.

    Distinct (item, pack, vendor, evidence, price, title, codes) are made once, with a mark of what they are, and every way starts from them; only
    Medium rows with an ordinary price are joined with the outcome, once. Prices meet by bins, and whether a code's or an identifier's offer is there
    is asked without making the pairs; titles are normalised only where such prices agree, each pair of titles once, and compared by bounds before Python sees them.
    """
    kinds = {"title": "string", "gtins": "array<string>", "mpns": "array<string>"}
    full = offers.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in offers.columns})
    codes = F.array_distinct(F.concat(F.coalesce("gtins", F.array().cast("array<string>")), F.transform(F.coalesce("mpns", F.array().cast("array<string>")), norm_code)))
    full = full.withColumn("_codes", F.filter(codes, lambda c: c != ""))
    ordinary = F.col("conditional").isNull()
    able = F.coalesce((F.col("confidence") == "Medium") & ordinary, F.lit(False))
    mark = F.when((F.col("confidence") == "High") & (F.col("condition") == "new") & ordinary, 1).when(able, 2).otherwise(0)
    own = ["wid", "pack_qty", "vkey", "evidence", "unit_price", "match_evidence", "title", "_codes"]
    seen = full.withColumn("_mark", mark).where("_mark > 0").groupBy(*own).agg(F.bit_or("_mark").alias("_mark"))
    seen = seen.select(F.explode(F.array(F.struct(*own, "_mark"))).alias("_s")).select("_s.*")  # filters stay above this, so all ways have one exchange of these rows
    high, medium = (seen.where(F.col("_mark").bitwiseAND(bit) > 0).select(*own) for bit in (1, 2))
    independent = ~keys_match(F.col("vkey"), F.col("h_vkey")) | (F.col("evidence") != F.col("h_evidence"))
    reach = F.array(*[price_bin(F.col("h_price")) + i for i in range(-BIN_REACH, BIN_REACH + 1)])
    agree = F.abs(F.col("unit_price") - F.col("h_price")) / F.col("h_price") <= PRICE_AGREE

    def agreeing(mine: DataFrame, theirs: DataFrame, how: str, *titles: str) -> DataFrame:
        """Medium rows with the independent High ones whose prices agree and the titles asked for, or only those that have one."""
        wanted = mine.where("unit_price > 0").withColumn("_bin", price_bin(F.col("unit_price")))
        priced = theirs.where("unit_price > 0").select(F.col("wid").alias("h_wid"), F.col("pack_qty").alias("h_pack"), F.col("vkey").alias("h_vkey"), F.col("evidence").alias("h_evidence"), F.col("unit_price").alias("h_price"), *(F.col(t).alias(f"h_{t}") for t in titles)).distinct()
        near = priced.withColumn("h_bin", F.explode(reach))
        return wanted.join(near, (F.col("wid") == F.col("h_wid")) & (F.col("pack_qty") == F.col("h_pack")) & (F.col("_bin") == F.col("h_bin")) & independent & agree, how)

    coded = F.coalesce(F.col("match_evidence").isin("gtin", "mpn", "page_metadata"), F.lit(False))
    by_code = agreeing(medium.where(coded), high, "left_semi").select(*own, F.lit(0).alias("_way"))
    titles = agreeing(medium.where(~coded & (F.col("title") != "")), high.where(F.col("evidence").isin(VERIFIED) & (F.col("title") != "")), "inner", "title").select(*own, "h_title").distinct()
    once = titles.groupBy("title", "h_title").agg(F.max("h_title").alias("_a"), F.max("title").alias("_b"))  # a filter on what is aggregated stays above, so each pair is normalised once
    mirrored = once.withColumns({"_a": title_head(F.col("_a")), "_b": title_head(F.col("_b"))})
    mirrored = mirrored.where((F.col("_a") != "") & (F.col("_b") != "") & is_similar(F.col("_a"), F.col("_b"), TITLE_RATIO)).select("title", "h_title")
    by_title = titles.join(mirrored, ["title", "h_title"], "left_semi").select(*own, F.lit(1).alias("_way"))
    h = high.select(F.col("wid").alias("h_wid"), F.col("vkey").alias("h_vkey"), F.col("evidence").alias("h_evidence"), F.explode("_codes").alias("h_code")).distinct()
    m = medium.where(verified()).select(*own, F.explode("_codes").alias("_code"))
    by_shared = m.join(h, (F.col("wid") == F.col("h_wid")) & (F.col("_code") == F.col("h_code")) & independent, "left_semi").select(*own, F.lit(2).alias("_way"))
    ways = by_code.unionByName(by_title).unionByName(by_shared).groupBy(*own).agg(F.min("_way").alias("_way"))
    mine = full.where(able)
    why = F.when(F.col("_way") == 0, "identifier").when(F.col("_way") == 1, "title").when(F.col("_way") == 2, "shared code")
    told = mine.join(ways, [mine[c].eqNullSafe(ways[c]) for c in own], "left").select(*[mine[c] for c in offers.columns], why.alias("promoted"))
    return told.unionByName(full.where(~able).select(*offers.columns, F.lit(None).cast("string").alias("promoted")))


def share_identifier(left: DataFrame, right: DataFrame, key: str, codes: str) -> DataFrame:
    """The distinct (left key, right key) that share a code: an equi-join on exploded codes, not a test of all pairs.

    A pair is made at the first code that both have, so none is made twice and pairs aren't exchanged. Of a code that
    many left keys have, each PAIR_KEYS of them meet the right ones in another task.
    """
    coded = lambda df: df.select(key, F.explode(codes).alias("code"))
    a, b = coded(left), coded(right)
    shared = a.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / PAIR_KEYS).cast("int").alias("parts")).join(b.select("code").distinct(), "code", "left_semi")

    def first_codes(df: DataFrame) -> DataFrame:
        """A row for each key and shared code, with the key's shared codes before it."""
        one = df.join(shared, "code").groupBy(key).agg(F.array_sort(F.collect_set(F.struct("code", "parts"))).alias("all")).select(key, "all", F.posexplode("all").alias("at", "c"))
        return one.select(key, "c.code", "c.parts", F.slice("all.code", F.lit(1), F.col("at")).alias("before"))

    l = first_codes(a).select(F.col(key).alias(f"left_{key}"), "code", F.pmod(F.xxhash64(key), "parts").cast("int").alias("part"), F.col("before").alias("_l"))
    r = first_codes(b).select(F.col(key).alias(f"right_{key}"), "code", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("before").alias("_r"))
    l, r = (spread(df, "code", "part") for df in (l, r))
    return l.join(r, ["code", "part"]).where(~F.arrays_overlap("_l", "_r")).select(f"left_{key}", f"right_{key}")


def _starts(keys: DataFrame, vendors: DataFrame, shortest: int, on: tuple[str, ...], parts: int | None) -> tuple[DataFrame, ...]:
    """Distinct keys and vendors that aren't empty; the keys' beginnings as vendor_key, whole ones with them, and the vendors' shorter beginnings as vkey."""
    a, b = (dealt(df.select(*on, c).where(f"{c} <> ''"), parts, *on, c).distinct() for df, c in ((keys, "vkey"), (vendors, "vendor_key")))
    whole = F.length("vkey")
    starts = a.select(*on, "vkey", F.explode(F.sequence(F.least(F.lit(shortest), whole), whole)).alias("n")).select(*on, "vkey", F.expr("left(vkey, n)").alias("vendor_key"))
    longer = b.where(F.length("vendor_key") > shortest)
    longer = longer.select(*on, "vendor_key", F.explode(F.sequence(F.lit(shortest), F.length("vendor_key") - 1)).alias("n")).select(*on, "vendor_key", F.expr("left(vendor_key, n)").alias("vkey"))
    return a, b, dealt(starts, parts, *on, "vendor_key"), dealt(longer, parts, *on, "vkey")


def match_vendors(keys: DataFrame, vendors: DataFrame, shortest: int = 4, on: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """The pairs (on, vkey, vendor_key) of distinct keys that keys_match, with equal `on`: an equi-join on all beginnings of four characters or more, both ways, in so many parts if given.

    A key meets the vendors that it begins with or equals, and those that are longer than it; no pair is both, so none is made twice.
    """
    a, b, starts, longer = _starts(keys, vendors, shortest, on, parts)
    return starts.join(b, [*on, "vendor_key"]).select(*on, "vkey", "vendor_key").unionByName(longer.join(a, [*on, "vkey"]).select(*on, "vkey", "vendor_key"))


def of_vendors(df: DataFrame, vendors: DataFrame, on: tuple[str, ...] = (), keep: bool = True, parts: int | None = None) -> DataFrame:
    """The rows of df (with vkey) whose key matches a vendor_key of vendors, or the others; within equal `on` where given. Null and empty keys match none. No pair is made."""
    _, b, starts, longer = _starts(df, vendors, 4, on, parts)
    matched = starts.join(b, [*on, "vendor_key"], "left_semi").select(*on, "vkey").unionByName(longer.select(*on, "vkey"))
    return dealt(df, parts, *on, "vkey").join(matched, [*on, "vkey"], "left_semi" if keep else "left_anti").select(*df.columns)
