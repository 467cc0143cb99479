"""What runs teach: retailers' yield, vendor candidates, outcomes, suggestions for an item's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import norm_text, vendor_display, vendor_key, words_of
from larkspur.functions.urls import host_of

# Outcomes in report order, those that say nothing about a retailer, and the limits of skips and suggestions.
OUTCOMES = ["success", "no_match", "identity_mismatch", "blocked", "timeout_network", "parser_failure", "unavailable", "api_unavailable", "skipped"]
NO_EVIDENCE = ["skipped", "timeout_network", "parser_failure", "api_unavailable"]
KEEP_ATTEMPTS = 40
# A domain in a vendor's name; lengths in feet and inches.
DOMAIN = r"([a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.(?:com|net|org|co|us|shop|store))\b"
FEET = r"(?i)(\d+(?:\.\d+)?)\s*(?:ft|feet|foot)\b"
INCHES = r"(?i)(\d+(?:\.\d+)?)\s*(?:[\"”″]|in\b|inch(?:es)?\b)"


def attempt_kinds(attempts: DataFrame) -> DataFrame:
    """attempts (domain, wid, run, outcome, n_listings, ts) that say something, with kind: found, blocked or empty."""
    found = (F.coalesce("n_listings", F.lit(0)) > 0) & F.col("outcome").isin("success", "unavailable")
    kind = F.when(found, "found").when(F.col("outcome") == "blocked", "blocked").otherwise("empty")
    return attempts.where((F.coalesce("domain", F.lit("")) != "") & ~F.col("outcome").isin(NO_EVIDENCE)).withColumn("kind", kind)


def retailer_yield(attempts: DataFrame) -> DataFrame:
    """(domain, attempts, items, found, blocked, empty, last_try): the last attempt of each run and item counts."""
    last = attempt_kinds(attempts).groupBy("domain", "run", "wid").agg(F.max_by("kind", F.struct("ts", "kind")).alias("kind"), F.max("ts").alias("ts"))
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("found", "blocked", "empty")]
    return last.groupBy("domain").agg(F.count(F.lit(1)).alias("attempts"), F.count_distinct("wid").alias("items"), *counts, F.max("ts").alias("last_try"))


def skips(yields: DataFrame, now: Column, min_attempts: int, min_items: int, retry_days: int) -> DataFrame:
    """yields with skip: never found anything, tried often enough on enough items, and not due for another try."""
    tired = (F.col("found") == 0) & (F.col("attempts") >= min_attempts) & (F.col("items") >= min_items)
    return yields.withColumn("skip", tired & (F.timestamp_diff("SECOND", F.col("last_try"), now) < retry_days * 86400))


def vendor_candidates(best: DataFrame, min_high: int, min_items: int, min_runs: int, max_ratio: float) -> DataFrame:
    """(vkey, high, items, runs, verified, best, best_ratio, avg_ratio, met, ok) of observations (vkey, wid, run, confidence, unit, ref, is_verified) of high confidence."""
    high = best.where(F.col("confidence") == "High")
    ratio = F.when(F.col("ref") > 0, F.col("unit") / F.col("ref"))
    out = high.groupBy("vkey").agg(
        F.count(F.lit(1)).alias("high"), F.count_distinct("wid").alias("items"), F.count_distinct("run").alias("runs"), F.count_if("is_verified").alias("verified"),
        F.min("unit").alias("best"), F.min(ratio).alias("best_ratio"), (F.sum(ratio.cast("decimal(18,6)")).cast("double") / F.count(ratio)).alias("avg_ratio"),
    )
    criteria = [F.col("high") >= min_high, F.col("items") >= min_items, F.col("runs") >= min_runs, F.col("best_ratio").isNull() | (F.col("best_ratio") <= max_ratio)]
    met = sum((c.cast("int") for c in criteria[1:]), criteria[0].cast("int"))
    return out.withColumns({"best_ratio": F.floor(F.col("best_ratio") * 1000 + 0.5) / 1000, "avg_ratio": F.floor(F.col("avg_ratio") * 1000 + 0.5) / 1000, "met": met, "ok": met == 4})


def best_of_vendor(listings: DataFrame, order: list[str]) -> DataFrame:
    """One listing for each (wid, vkey): High before Medium, verified first, then the cheapest."""
    rank = F.struct((F.col("confidence") != "High").alias("a"), (~F.col("is_verified")).alias("b"), "unit_price", *order)
    rest = [c for c in listings.columns if c not in ("wid", "vkey")]
    return listings.groupBy("wid", "vkey").agg(F.min_by(F.struct(*rest), rank).alias("x")).select("wid", "vkey", "x.*")


def outcome_summary(results: DataFrame) -> DataFrame:
    """(outcome, n, targets) in report order; targets: the distinct ones, sorted, joined, cut to 80 characters."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome")), F.lit(0)), F.lit(len(OUTCOMES) + 1))
    out = results.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("target")), ", ").alias("targets"))
    return out.select("outcome", "n", F.substring("targets", 1, 80).alias("targets")).orderBy(order)


def missing_words(items: DataFrame, titles: DataFrame) -> DataFrame:
    """(wid, missing): words of three characters or more of items (wid, product) that no title (wid, title) has, sorted."""
    words = lambda df, c: df.select("wid", F.explode(F.array_distinct(F.split(norm_text(F.col(c)), " "))).alias("w")).where("w <> ''")
    wanted = words(items.join(titles.select("wid").distinct(), "wid", "left_semi"), "product").where(F.length("w") >= 3)
    return wanted.join(words(titles, "title").distinct(), ["wid", "w"], "left_anti").groupBy("wid").agg(F.array_join(F.array_sort(F.collect_set("w")), " ").alias("missing"))


def union_codes(learned: DataFrame, found: DataFrame, cap: int = 6) -> DataFrame:
    """(wid, codes): learned codes first, then new ones in sorted order, no more than cap."""
    new = found.groupBy("wid").agg(F.array_sort(F.collect_set("code")).alias("new"))
    both = learned.select("wid", "codes").join(new, "wid", "full")
    empty = F.array().cast("array<string>")
    return both.select("wid", F.slice(F.array_union(F.coalesce("codes", empty), F.coalesce("new", empty)), 1, cap).alias("codes"))


def cheapest_snapshots(listings: DataFrame, per_item: int, order: list[str]) -> DataFrame:
    """The cheapest snapshot of each vendor, then the per_item cheapest vendors of each item, with rank."""
    rest = [c for c in listings.columns if c not in ("wid", "vkey")]
    cheapest = listings.groupBy("wid", "vkey").agg(F.min_by(F.struct(*rest), F.struct("unit_price", *order)).alias("x")).select("wid", "vkey", "x.*")
    w = Window.partitionBy("wid").orderBy("unit_price", "vkey", *order)
    return cheapest.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_item)


def circuit_states(attempts: DataFrame, failures: int = 3) -> DataFrame:
    """attempts (domain, ts, ord, outcome) with streak, the blocked or failed fetches in a row up to it, and open from `failures` on; only a success ends a streak.

    One retailer's attempts are put in order together; they are what one polite client made.
    """
    w = Window.partitionBy("domain").orderBy("ts", "ord")
    runs = attempts.withColumn("_run", F.sum((F.col("outcome") == "success").cast("int")).over(w))
    failed = F.col("outcome").isin("blocked", "timeout_network").cast("int")
    streak = F.sum(failed).over(Window.partitionBy("domain", "_run").orderBy("ts", "ord"))
    return runs.withColumn("streak", streak).withColumn("open", F.col("streak") >= failures).drop("_run")


def best_client(attempts: DataFrame) -> DataFrame:
    """(domain, client): the one that last succeeded."""
    return attempts.where("outcome = 'success'").groupBy("domain").agg(F.max_by("client", F.struct("ts", "client")).alias("client"))


def vendor_identity(listings: DataFrame) -> DataFrame:
    """(vkey, name, marketplace, domain, domain_how): the name a vendor is seen under most (ties: the first in order), without a market place's seller, and its domain.

    listings: vkey, vendor, url. The domain is the most frequent host that rows link to, else the one in the name, else a guess from the key.
    """
    names = listings.groupBy("vkey", "vendor").agg(F.count(F.lit(1)).alias("n")).groupBy("vkey").agg(F.min_by("vendor", F.struct(-F.col("n"), "vendor")).alias("raw"))
    hosts = listings.select("vkey", host_of(F.col("url")).alias("host")).where((F.col("host") != "") & ~F.contains("host", F.lit("google.")))
    hosts = hosts.groupBy("vkey", "host").agg(F.count(F.lit(1)).alias("n")).groupBy("vkey").agg(F.min_by("host", F.struct(-F.col("n"), "host")).alias("host"))
    display = vendor_display(F.regexp_replace("raw", r"(?i)^from\s+", ""))
    in_name = F.nullif(F.regexp_extract(F.lower(display), DOMAIN, 1), F.lit(""))
    guess = F.when(F.col("vkey") != "", F.concat("vkey", F.lit(".com"))).otherwise("")
    how = F.when(F.col("host").isNotNull(), "merchant link").when(in_name.isNotNull(), "vendor name").when(F.col("vkey") != "", "guess - confirm").otherwise("unknown")
    out = names.join(hosts, "vkey", "left")
    return out.select("vkey", display.alias("name"), F.contains("raw", F.lit(" - ")).alias("marketplace"), F.coalesce("host", in_name, guess).alias("domain"), how.alias("domain_how"))


def new_vendors(candidates: DataFrame, primary: DataFrame, secondary: DataFrame, ignored: list[str], watching: int = 6) -> DataFrame:
    """vendor_candidates that are on neither list (vendor_key) nor ignored: all qualified ones, and the `watching` nearest of the others."""
    from larkspur.operators.reconcile import of_vendors

    left = of_vendors(candidates.where(~F.col("vkey").isin(ignored)), primary.select("vendor_key").unionByName(secondary.select("vendor_key")), keep=False)
    near = left.where(~F.col("ok")).orderBy(F.desc("met"), F.desc("high"), "vkey").limit(watching)
    return left.where("ok").unionByName(near)


def item_suggestions(items: DataFrame, listings: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(wid, suggestion): what an item's row lacks or what holds its pages back, from its listings.

    items: wid, product, brand, gtins, mpns and, if there, specs, urls and learned_gtins. listings: wid, title, brand, offer_gtins, offer_mpns and,
    if there, confidence, evidence, condition, pack_qty, from_url, url, vendor, vkey, unit_price, is_primary, eligible, reason; listings without a
    confidence are verified pages of single new units. failed: (wid, host, outcome) of links.
    """
    empty = F.array().cast("array<string>")
    kinds = {
        "confidence": ("string", "High"), "evidence": ("string", "verified_direct"), "condition": ("string", "new"), "pack_qty": ("int", 1), "from_url": ("boolean", None), "url": ("string", None), "vendor": ("string", None),
        "vkey": ("string", None), "unit_price": ("double", None), "is_primary": ("boolean", None), "eligible": ("boolean", None), "reason": ("string", None),
    }
    l = listings.withColumns({c: F.lit(x).cast(t) for c, (t, x) in kinds.items() if c not in listings.columns})
    items = items.withColumns({c: F.lit(None).cast("array<string>") for c in ("specs", "urls", "learned_gtins") if c not in items.columns})
    pages = l.where(F.startswith("evidence", F.lit("verified")) & F.col("confidence").isin("High", "Medium") & (F.col("condition") == "new"))
    single = (F.col("confidence") == "High") & (F.col("pack_qty") == 1)
    codes = F.filter(F.coalesce("offer_mpns", empty), lambda m: (F.length(m) >= 5) & m.rlike(r"\d"))
    seen = pages.groupBy("wid").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(single, F.coalesce("offer_gtins", empty)))))).alias("page_gtins"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(single, codes))))).alias("page_mpns"), F.min(F.when(single, F.nullif("brand", F.lit("")))).alias("page_brand"),
        F.array_distinct(F.flatten(F.collect_set(words_of(norm_text(F.col("title")))))).alias("words"), F.array_join(F.array_sort(F.collect_set(F.replace(norm_text(F.col("title")), F.lit(" "), F.lit("")))), " ").alias("compact"),
        F.array_distinct(F.flatten(F.collect_set(F.regexp_extract_all("title", F.lit(FEET), 1)))).alias("feet"),
    )
    own_links = l.where(F.coalesce("from_url", F.lit(False)) & F.startswith("evidence", F.lit("verified")) & (F.col("confidence") == "Medium")).groupBy("wid").agg(F.array_sort(F.collect_set(F.concat(host_of(F.col("url")), F.lit(" is only Medium: "), F.coalesce("reason", F.lit(""))))).alias("stuck"))
    known = items.select("wid", F.coalesce("product", F.lit("")).alias("product"), "brand", *[F.coalesce(c, empty).alias(c) for c in ("gtins", "mpns", "specs", "urls", "learned_gtins")])
    own_keys = known.select("wid", F.explode("urls").alias("u")).select("wid", vendor_key(host_of(F.col("u"))).alias("vkey")).distinct()
    snaps = l.where((F.col("evidence") == "market_snapshot") & (F.col("confidence") == "High") & (F.col("condition") == "new") & F.col("eligible") & F.col("is_primary") & (F.col("vkey") != ""))
    cheapest = snaps.join(own_keys, ["wid", "vkey"], "left_anti").groupBy("wid", "vkey").agg(F.min(F.struct("unit_price", "vendor")).alias("s"))
    only = cheapest.groupBy("wid").agg(F.slice(F.array_sort(F.collect_list("s")), 1, 2).alias("snaps"))  # a row a primary vendor
    both = known.join(seen, "wid", "left").join(missing_words(items, pages), "wid", "left").join(own_links, "wid", "left").join(only, "wid", "left")
    if failed is not None:
        bad = failed.where(F.col("outcome").isin("identity_mismatch", "parser", "no_match")).groupBy("wid").agg(F.array_sort(F.collect_set(F.concat(F.lit("link at "), "host", F.lit(" failed ("), "outcome", F.lit(")")))).alias("bad"))
        both = both.join(bad, "wid", "left")
    else:
        both = both.withColumn("bad", F.lit(None).cast("array<string>"))
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    first = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    plain = lambda c: F.transform(c, lambda m: F.replace(norm_text(m), F.lit(" "), F.lit("")))
    new_codes = F.filter("page_mpns", lambda m: ~F.array_contains(plain("mpns"), F.replace(norm_text(m), F.lit(" "), F.lit(""))))
    said = lambda w: F.array_contains("words", w) | ((F.length(w) >= 5) & F.contains("compact", w))
    lost = F.filter("specs", lambda s: ~F.forall(words_of(norm_text(s)), said) & (norm_text(s) != ""))
    inches = F.filter(F.regexp_extract_all("product", F.lit(INCHES), 1), lambda n: F.array_contains("feet", n))
    some = lambda c, text: F.when(has(c), F.transform(c, text))
    one = lambda cond, text: F.when(cond, F.array(text))
    rules = F.array(
        one(~has("gtins") & has("page_gtins"), F.concat(F.lit("GTIN is blank: pages report "), first("page_gtins", 2))),
        one(has(new_codes) & ~has("mpns"), F.concat(F.lit("MPN is blank: pages report "), first(new_codes, 3))),
        one(has(new_codes) & has("mpns"), F.concat(F.lit("pages also report "), first(new_codes, 3))),
        one((F.coalesce("brand", F.lit("")) == "") & F.col("page_brand").isNotNull(), F.concat(F.lit("brand is blank: pages report "), "page_brand")),
        one(F.col("missing").isNotNull(), F.concat(F.lit("no page has these words: "), "missing")),
        F.when(F.col("words").isNotNull(), some(lost, lambda s: F.concat(F.lit("no page has the spec: "), s))),
        some(inches, lambda n: F.concat(F.lit("the name says "), n, F.lit(" inches, pages say feet"))),
        some(F.slice("stuck", 1, 2), lambda s: F.concat(F.lit("link "), s)), F.col("bad"),
        some("snaps", lambda s: F.concat(s["vendor"], F.lit(" shows $"), F.format_number(s["unit_price"], 2), F.lit(" by search only: add its page"))),
        one(~has("gtins") & ~has("mpns") & ~has("learned_gtins") & ~has("page_gtins") & ~has("page_mpns"), F.lit("no GTIN or MPN known yet")),
    )
    return both.select("wid", F.explode(F.array_distinct(F.flatten(F.array_compact(rules)))).alias("suggestion"))


def candidate_lines(candidates: DataFrame) -> DataFrame:
    """(rest, met, high, line): a report of vendor_candidates; read it by rest (false: suggested), then most met, most high, line."""
    state = F.when(F.col("ok"), "suggested").otherwise(F.concat(F.lit("meets "), F.col("met").cast("string"), F.lit(" of 4")))
    line = F.format_string("%s: %d listings, %d items, %d runs; best %.2f; %s", "vkey", "high", "items", "runs", "best", state)
    return candidates.select((~F.col("ok")).alias("rest"), "met", "high", line.alias("line"))
