"""URLs as column expressions: canonical form, host, merchant item ids, kinds of page. Null and malformed URLs give empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import text_of

# Parameters that only track a visit, merchants' item ids, paths of listing pages.
TRACKING = [
    "gclid", "gclsrc", "gbraid", "wbraid", "dclid", "fbclid", "msclkid", "yclid", "twclid", "ttclid", "srsltid", "gad_source", "gad_campaignid",
    "_ga", "_gl", "mc_cid", "mc_eid", "igshid", "si", "ref", "ref_", "refid", "referrer", "extstoreid", "loc", "irclickid", "irgwc", "clickid",
    "click_id", "affid", "aff_id", "affiliate", "tag", "linkcode", "creative", "creativeasin", "ascsubtag", "cmp", "intcmp", "icid", "cid", "scid",
    "spm", "ved", "ei", "_pos", "_sid", "_ss", "_psq", "_fid", "_v", "pf_rd_p", "pf_rd_r", "pd_rd_r", "pd_rd_w", "pd_rd_wg", "pd_rd_i", "content-id",
    "qid", "sr", "keywords", "crid", "sprefix", "dib", "dib_tag", "s_kwcid", "ef_id", "veh", "cjevent", "cjdata", "rrid", "mkcid", "mkrid", "campid",
    "toolid", "customid", "mkevt", "epik", "lgeo", "acqchannel", "athcpid", "athpgid", "athznid", "athieid", "athena", "adid", "adgroupid",
    "campaignid", "feeditemid", "targetid", "matchtype", "network", "device", "devicemodel", "placement", "adposition", "hsa_acc",
]
TRACKING_PREFIXES = ["utm_", "pk_", "mtm_", "hsa_", "_hs", "gad_", "ga_", "pd_rd", "pf_rd", "oly_", "vero_"]
MERCHANT_IDS = [
    ("bestbuy.com", r"(?:skuId=|/sku/|/)(\d{7})(?:\.p\b|\b)"),
    ("amazon.", r"/(?:dp|gp/product|gp/aw/d|product)/([A-Z0-9]{10})(?:[/?]|$)"),
    ("walmart.com", r"/ip/(?:[^/]+/)?(\d{6,})"),
    ("target.com", r"/A-(\d{6,})"),
    ("homedepot.com", r"/p/(?:[^/]+/)?(\d{9})"),
    ("dell.com", r"(?i)/apd/([a-z0-9-]{5,})"),
    ("microcenter.com", r"/product/(\d{6,})"),
    ("ebay.com", r"/itm/(?:[^/]+/)?(\d{9,})"),
]
LISTING_PATHS = (
    r"/(?:search|s|blog|blogs|support|help|compare|collections?|category|categories|c|cat|stories|press|news|account|cart|login|"
    r"signin|sign-in|deals|brands?|shop-all|all-products|sitemap|pages|faq|contact)(?:/|$)"
)
PRODUCT_PATHS = r"/products/|/product/|/p/|/pd/|/apd/|/dp/|/ip/|/sku/|/itm/|/a-\d{6,}|\d{7}\.p$"


def part(c: Column, pattern: str) -> Column:
    return F.regexp_extract(text_of(c), pattern, 1)


def host_of(c: Column) -> Column:
    """The host in lower case, without port and a leading www, m, shop or store label."""
    host = F.split_part(F.lower(part(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)")), F.lit(":"), F.lit(1))
    return F.regexp_replace(host, r"^(?:www\d?|m|shop|store)\.", "")


def path_of(c: Column) -> Column:
    return part(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)")


def query_of(c: Column) -> Column:
    return part(c, r"^[^?#]*\?([^#]*)")


def normalize_url(c: Column) -> Column:
    """Lower-case scheme and host; no fragment, tracking or empty parameters; the others sorted; no doubled or final slash.

    Parameters are decoded and coded anew, so "a%20b" and "a+b" are one; codes that can't be decoded count as written, and paths keep theirs. A text that
    has no scheme and host stays as it is, trimmed.
    """
    u = F.trim(text_of(c))
    scheme, host = part(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://[^/?#]+"), part(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)")
    path = F.regexp_replace(path_of(u), "/{2,}", "/")
    path = F.when(F.length(path) > 1, F.rtrim(path, F.lit("/"))).otherwise(F.lit("/"))
    name = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    tracks = lambda p: name(p).isin(TRACKING) | name(p).rlike("^(?:" + "|".join(TRACKING_PREFIXES) + ")")
    kept = F.filter(F.split(query_of(u), "&"), lambda p: p.rlike("^[^=]+=.") & ~tracks(p))
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    coded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.array_sort(F.transform(kept, lambda p: F.struct(plain(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), plain(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"))))
    query = F.array_join(F.transform(pairs, lambda s: F.concat(coded(s["k"]), F.lit("="), coded(s["v"]))), "&")
    return F.when(scheme == "", u).otherwise(F.concat(F.lower(scheme), F.lit("://"), F.lower(host), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def same_site(host: Column, domain: Column) -> Column:
    return (host != "") & (domain != "") & ((host == domain) | F.endswith(host, F.concat(F.lit("."), domain)))


def merchant_item_id(c: Column) -> Column:
    """A merchant's own id, else v and the variant, an sku parameter, h: and the product handle, or empty."""
    u = text_of(c)
    found = [F.when(F.lower(u).contains(site), F.nullif(F.regexp_extract(u, pattern, 1), F.lit(""))) for site, pattern in MERCHANT_IDS]
    variant = F.nullif(F.regexp_extract(u, r"[?&]variant=(\d+)", 1), F.lit(""))
    sku = F.nullif(F.regexp_extract(u, r"(?i)[?&](?:skuid|sku|pid|productid|itemid)=([A-Za-z0-9_-]{4,})", 1), F.lit(""))
    handle = F.nullif(F.lower(F.regexp_extract(u, r"/products/([^/?#]+)", 1)), F.lit(""))
    return F.coalesce(*found, F.concat(F.lit("v"), variant), sku, F.concat(F.lit("h:"), handle), F.lit(""))


def store_handle(c: Column) -> Column:
    return F.nullif(F.regexp_extract(path_of(c), r"/products/([^/?#.]+)", 1), F.lit(""))


def store_variant(c: Column) -> Column:
    return F.nullif(F.regexp_extract(text_of(c), r"[?&]variant=(\d+)", 1), F.lit(""))


def is_listing_page(c: Column) -> Column:
    """Home, category and search pages."""
    path = F.lower(path_of(c))
    home = path.isin("", "/") | path.rlike("^/[a-z]{2}[-_][a-z]{2}/?$")
    return home | (~path.rlike(PRODUCT_PATHS) & (path.rlike(LISTING_PATHS) | F.concat(F.lit("?"), query_of(c)).rlike("(?i)[?&](?:q|query|searchterm|ntt|k)=")))


def us_locale_ok(c: Column) -> Column:
    """No path segment names another country."""
    return ~F.exists(F.split(F.lower(path_of(c)), "/"), lambda s: s.rlike("^[a-z]{2}[-_][a-z]{2}$") & (F.replace(s, F.lit("_"), F.lit("-")) != "en-us"))


def urls_in(c: Column) -> Column:
    """Distinct http URLs of a text, in order, without closing punctuation; semicolons part them, commas are theirs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text_of(c), F.lit(r"(?i)(https?://[^\s;；<>\"']+)"), 1), lambda u: F.rtrim(u, F.lit(").,"))))
