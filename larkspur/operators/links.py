"""Product links: which of a site's links shows an item, and what to search for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions.urls import is_listing_page, path_of, us_locale_ok
from larkspur.operators.identity import ACCESSORIES

# How much of a name a path must have, what a known code in it adds, the length of a search.
MIN_COVERAGE, CODE_BONUS, QUERY_CHARS = 0.5, 2.0, 150


def rank_links(links: DataFrame, limit: int = 2) -> DataFrame:
    """The best links of each item and site: links (wid, domain, link, product, codes) with score and rank.

    A path must have half of the name's words (those of the domain apart) or one of the codes; shorter paths win ties. Home, category,
    foreign and accessory pages don't count.
    """
    path = F.lower(path_of(F.col("link")))
    words = T.words_of(T.norm_text(F.regexp_replace(path, "[-_/]", " ")))
    compact = F.replace(T.norm_text(path), F.lit(" "), F.lit(""))
    brand = F.split(F.lower("domain"), "[^a-z0-9]+")
    name = T.words_of(T.norm_text(F.col("product")))
    wanted = F.filter(name, lambda w: ~F.array_contains(brand, w))
    wanted = F.when(F.size(wanted) > 0, wanted).otherwise(name)
    have = F.filter(wanted, lambda w: F.array_contains(words, w) | ((F.length(w) >= 4) & F.contains(compact, w)))
    code = F.exists(F.coalesce("codes", F.array().cast("array<string>")), lambda c: (F.length(T.norm_code(c)) >= 5) & F.contains(compact, F.lower(T.norm_code(c))))
    coverage = F.when(F.size(wanted) > 0, F.size(have) / F.size(wanted)).otherwise(0.0)
    accessory = F.size(F.array_except(F.array_intersect(words, F.array(*map(F.lit, ACCESSORIES))), wanted)) > 0
    rows = links.where(us_locale_ok(F.col("link")) & ~is_listing_page(F.col("link")) & ~accessory & ((coverage >= MIN_COVERAGE) | code)).dropDuplicates(["wid", "domain", "link"])
    rows = rows.withColumn("score", coverage + F.when(code, CODE_BONUS).otherwise(0.0))
    w = Window.partitionBy("wid", "domain").orderBy(F.desc("score"), F.length(path_of(F.col("link"))), F.desc("link"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def search_query(items: DataFrame) -> DataFrame:
    """items with query: the name, then codes and specifications with words that it lacks, cut at a word to QUERY_CHARS."""
    name = T.words_of(T.norm_text(F.col("product")))
    extras = F.concat(F.coalesce("mpns", F.array().cast("array<string>")), F.coalesce("specs", F.array().cast("array<string>")))
    new = F.filter(F.array_distinct(extras), lambda e: F.size(F.array_except(T.words_of(T.norm_text(e)), name)) > 0)
    core = F.concat_ws(" ", "product", F.array_join(new, " "))
    cut = F.substring(core, 1, QUERY_CHARS)
    return items.withColumn("query", F.trim(F.when(F.length(core) <= QUERY_CHARS, core).otherwise(F.regexp_replace(cut, r"\s\S*$", ""))))
