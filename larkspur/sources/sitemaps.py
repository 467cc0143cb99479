"""Sitemaps as a frontier: robots files name the first maps, an index names others, a URL set names pages.

A site's maps are visited in a fixed order, an index's own maps before what was
waiting, and at most so many of them. Each round takes one map of every site,
so rounds are bounded by that limit, whatever the number of sites; a visited map
is not taken again, which also ends circles.
"""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larkspur.functions.urls import us_locale_ok
from larkspur.sources.pages import unescape

# Maps of a site that are visited, and how maps, locations and preferred ones look.
MAX_MAPS = 6
ROBOTS_LINE = r"(?im)^\s*sitemap:\s*(\S+)"
LOCATION = r"<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]\s]+)"
INDEX_MARK = "<sitemapindex"
US_MARK = r"en[-_]?us|/us/"


@F.pandas_udf(StringType())
def _unzipped(body: pd.Series) -> pd.Series:
    """The text of gzip bodies; null where one is damaged."""

    def text(b) -> str | None:
        try:
            return None if b is None else gzip.decompress(b).decode("utf-8", "ignore")
        except (OSError, EOFError, zlib.error):
            return None

    return body.map(text)


def documents(fetched: DataFrame) -> DataFrame:
    """(url, text) of fetched files (url, body binary); only gzip bodies go through Python. A damaged one, or one named .gz that isn't gzip, has no text."""
    zipped = F.coalesce(F.hex(F.substring("body", 1, 2)) == "1F8B", F.lit(False))
    plain = fetched.where(~zipped).select("url", F.when(~F.col("url").endswith(".gz"), F.make_valid_utf8(F.col("body").cast("string"))).alias("text"))
    return plain.unionByName(fetched.where(zipped).select("url", _unzipped("body").alias("text"))).where("text IS NOT NULL").groupBy("url").agg(F.min("text").alias("text"))


def _locations(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(LOCATION), 1), unescape)


def _after(url: Column) -> list[Column]:
    """Maps of products first, then those of the US, then as they stand."""
    lower = F.lower(url)
    return [~F.contains(lower, F.lit("product")), ~lower.rlike(US_MARK)]


def sitemap_pages(sites: DataFrame, fetched: DataFrame, limit: int = MAX_MAPS) -> tuple[DataFrame, DataFrame]:
    """(pages, visits): the page locations (domain, map, link, visit, position) of each site, and the maps that were visited for it (domain, map, visit, found).

    sites: (domain); fetched: (url, body), robots files and maps as they came.
    A site without a map in its robots file has https://domain/sitemap.xml. A map
    that wasn't fetched or can't be read counts as visited and has found false.
    Visits count from 1; of maps that wait, those of the index visited last come
    first, preferred ones before others.

    Nulls and repeated domains count once; repeated files with one url, the
    smallest text; an index with foreign-locale maps skips these; empty tables
    give no rows. The maps that wait of one site are as many as its indexes name.
    """
    docs = documents(fetched)
    sites = sites.select("domain").where("domain IS NOT NULL AND domain <> ''").distinct()
    robots = sites.withColumn("url", F.concat(F.lit("https://"), "domain", F.lit("/robots.txt"))).join(docs, "url", "left")
    named = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(ROBOTS_LINE), 1)
    first = F.when(F.size(named) > 0, named).otherwise(F.array(F.concat(F.lit("https://"), "domain", F.lit("/sitemap.xml"))))
    waiting = robots.select("domain", F.posexplode(first).alias("place", "map")).select("domain", "map", F.array(F.col("place").cast("long")).alias("order"))
    done, places = None, None
    for visit in range(1, limit + 1):
        known = waiting if done is None else waiting.join(done.select("domain", "map"), ["domain", "map"], "left_anti")
        chosen = known.groupBy("domain").agg(F.min(F.struct("order", "map")).alias("_next")).select("domain", F.col("_next.map").alias("map"))
        read = chosen.join(docs.withColumnRenamed("url", "map"), "map", "left").select("domain", "map", F.lit(visit).alias("visit"), F.col("text").isNotNull().alias("found"), "text")
        if sites.sparkSession.sparkContext.getCheckpointDir():
            read = read.checkpoint()  # a round reads what the ones before it found, not all of their work
        index = F.contains("text", F.lit(INDEX_MARK))
        listed = read.where("found").select("domain", "map", "visit", index.alias("index"), F.posexplode(_locations(F.col("text"))).alias("position", "link"))
        done = read.drop("text") if done is None else done.unionByName(read.drop("text"))
        pages = listed.where("NOT index").drop("index")
        places = pages if places is None else places.unionByName(pages)
        kids = listed.where(F.col("index") & us_locale_ok(F.col("link")))
        by = Window.partitionBy("domain", "map").orderBy(*_after(F.col("link")), "position")
        kids = kids.select("domain", F.col("link").alias("map"), F.array(F.lit(-visit).cast("long"), F.row_number().over(by).cast("long")).alias("order"))
        waiting = known.unionByName(kids)
    return places, done
