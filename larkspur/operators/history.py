"""Price history by item: series, statistics, change events, streaks, retention and idempotent writes.

Series have wid, dt and v. Windows by wid need an item's runs together: one row
a run, so few; observations are reduced to one value a run before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import money
from larkspur.operators.medians import sliding_medians

# The window, its least number of points, the moving average's weight, what counts as unchanged and as material.
WINDOW_DAYS, MIN_POINTS, EWMA_ALPHA, EPSILON, MATERIAL = 30, 3, 0.3, 0.01, 0.02


def item_key(c: Column) -> Column:
    return F.replace(F.trim(c.cast("string")), F.lit(".0"), F.lit(""))


def verified_series(rows: DataFrame, exclude_run: str = "") -> DataFrame:
    """(wid, dt, v) of past runs (wid, run, dt, baseline, baseline_src) whose baseline is verified."""
    ok = F.startswith("baseline_src", F.lit("verified")) & (F.col("baseline") > 0) & F.col("dt").isNotNull()
    return rows.where(ok & ~F.col("run").eqNullSafe(F.lit(exclude_run))).select(item_key(F.col("wid")).alias("wid"), "dt", F.col("baseline").alias("v"))


def ewma(values: Column, alpha: float = EWMA_ALPHA) -> Column:
    """The exponentially weighted mean of an array, its first value as the start."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, v: F.when(a.isNull(), v).otherwise(alpha * v + (1 - alpha) * a))


def with_trusted_low(stats: DataFrame, trusted: DataFrame) -> DataFrame:
    """history_stats with the trusted units (wid, unit) of searches in the low; an item that has only these has a low alone, and median_n 0."""
    least = trusted.where("wid IS NOT NULL AND unit > 0").groupBy("wid").agg(money(F.min("unit")).alias("_low"))
    out = stats.join(least, "wid", "full").withColumns({"low": F.least("low", "_low"), "median_n": F.coalesce("median_n", F.lit(0).cast("bigint"))})
    return out.select(*stats.columns)


def history_stats(series: DataFrame, now: Column) -> DataFrame:
    """(wid, prior, median, median_n, ewma, low): last value, median of the last WINDOW_DAYS if of MIN_POINTS at least, moving average, lowest."""
    recent = F.col("dt") >= now - F.expr(f"INTERVAL {WINDOW_DAYS} DAYS")
    out = series.groupBy("wid").agg(
        F.max_by("v", F.struct("dt", "v")).alias("prior"),
        F.median(F.when(recent, F.col("v"))).alias("median"),
        F.count(F.when(recent, 1)).alias("median_n"),
        F.array_sort(F.collect_list(F.struct("dt", "v"))).alias("s"),  # one value a run
        F.min("v").alias("low"),
    )
    return out.select("wid", "prior", F.when(F.col("median_n") >= MIN_POINTS, money(F.col("median"))).alias("median"), "median_n", money(ewma(F.transform("s", lambda x: x["v"]))).alias("ewma"), money(F.col("low")).alias("low"))


def moving_average(series: DataFrame, order: list[str], alpha: float = EWMA_ALPHA, block: int = 512) -> DataFrame:
    """series with ewma at each row: the exponentially weighted mean of its item's values so far, the first value as the start.

    A run of values maps the mean before it to the mean after it, by a factor and
    a summand, and such maps compose. So an item's rows are cut into blocks; sums
    within blocks are window sums, each block's map is a row, and only these are
    gathered by item. Null values have no part and no mean of their own; equal
    rows count one by one; an item of nulls has none. order must be total.
    """
    keep = 1.0 - alpha
    if not 0 < keep < 1 or keep**block < 1e-150:
        raise ValueError("alpha must be between 0 and 1, and its powers over a block must not vanish")
    own = [c for c in series.columns if c != "ewma"]
    rows = series.where("v IS NOT NULL").select(*own, (F.row_number().over(by_run(order)) - 1).alias("_i"))
    place = F.col("_i") % block + 1
    start = F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(alpha))  # an item's first value counts whole
    rows = rows.withColumns({"_block": F.floor(F.col("_i") / block), "_place": place, "_term": F.col("v") * start / F.pow(F.lit(keep), place)})
    within = Window.partitionBy("wid", "_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_sum", F.sum("_term").over(within) * F.pow(F.lit(keep), F.col("_place")))
    maps = rows.groupBy("wid", "_block").agg(F.max("_place").alias("n"), F.max_by("_sum", "_place").alias("c"))
    maps = maps.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct("_block", "n", "c"))).alias("s"))
    step = lambda a, b: F.concat(a, F.array(F.element_at(a, -1) * F.pow(F.lit(keep), b["n"]) + b["c"]))
    before = F.aggregate(F.col("s"), F.array(F.lit(0.0)), step)
    before = maps.select("wid", F.posexplode(F.slice(before, F.lit(1), F.size("s"))).alias("_block", "_before")).withColumn("_block", F.col("_block").cast("bigint"))
    out = rows.join(before, ["wid", "_block"]).select(*own, (F.col("_sum") + F.col("_before") * F.pow(F.lit(keep), F.col("_place"))).alias("ewma"))
    return out.unionByName(series.where("v IS NULL").select(*own, F.lit(None).cast("double").alias("ewma")))


def by_run(order: list[str]) -> Window:
    return Window.partitionBy("wid").orderBy(*order)


def running(series: DataFrame, order: list[str]) -> DataFrame:
    """series with prior (the value before), change (its share, 4 places), low_before and new_low."""
    w = by_run(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = series.withColumns({"prior": F.lag("v").over(w), "low_before": F.min("v").over(before)})
    change = (F.col("v") - F.col("prior")) / F.col("prior")
    return out.withColumns({"change": F.floor(change * 10000 + 0.5000001) / 10000, "material": F.abs(change) >= MATERIAL, "new_low": F.col("v") <= F.col("low_before") - EPSILON})


def trailing_median(series: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """series with median and n of the last `days`, both ends included; null values have no part, and a null time's window is the null times."""
    own = [c for c in series.columns if c not in ("median", "n")]
    found = sliding_medians(series.select("wid", "dt", "v"), days).withColumnsRenamed({"wid": "_w", "dt": "_dt"})
    rows = series.select(*[F.col(f"`{c}`") for c in own])
    same = rows["wid"].eqNullSafe(found["_w"]) & rows["dt"].eqNullSafe(found["_dt"])
    return rows.join(found, same, "left").select(*[rows[f"`{c}`"] for c in own], money(found["median"]).alias("median"), found["n"])


def price_events(series: DataFrame, order: list[str]) -> DataFrame:
    """series (wid, dt, v, in_stock) with event and since: new offer, unchanged, price drop or price increase; back in stock is appended.

    `since` is when the price last changed by EPSILON or more.
    """
    w = by_run(order)
    diff = F.col("v") - F.lag("v").over(w)
    kind = F.when(F.lag("v").over(w).isNull(), "new offer").when(F.abs(diff) < EPSILON, "unchanged").when(diff < 0, "price drop").otherwise("price increase")
    back = F.coalesce(~F.lag("in_stock").over(w) & F.coalesce("in_stock", F.lit(True)), F.lit(False))
    out = series.withColumns({"kind": kind, "back": back})
    since = F.last(F.when(F.col("kind") != "unchanged", F.col("dt")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumns({"event": F.concat("kind", F.when(F.col("back"), "; back in stock").otherwise("")), "since": since}).drop("kind", "back")


def flag_streak(rows: DataFrame, flag: Column, order: list[str]) -> DataFrame:
    """(wid, streak): how many of the newest rows (in `order`, oldest first) have the flag before one that hasn't."""
    rows = rows.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    position = F.struct(*order)
    last_no = rows.groupBy("wid").agg(F.max(F.when(~F.col("_flag"), position)).alias("_no"))
    return rows.join(last_no, "wid").groupBy("wid").agg(F.count(F.when(F.col("_no").isNull() | (position > F.col("_no")), 1)).alias("streak"))


def resale_trend(rows: DataFrame, now: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """(wid, trend, n): the mean of stored resale averages (wid, dt, avg, n; n null or 3 at least) of the last days, of three rows at least."""
    recent = rows.where((F.col("dt") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("n").isNull() | (F.col("n") >= 3)) & F.col("avg").isNotNull())
    out = recent.groupBy("wid").agg((F.sum(F.col("avg").cast("decimal(18,2)")).cast("double") / F.count("avg")).alias("trend"), F.count("avg").alias("n"))
    return out.where("n >= 3").select("wid", money(F.col("trend")).alias("trend"), "n")


def due_items(items: DataFrame, runs: DataFrame, now: Column, gap_days: int) -> DataFrame:
    """items whose last run is gap_days, less half a day, ago or more, or that never ran."""
    last = runs.groupBy("wid").agg(F.max("dt").alias("_last"))
    due = F.col("_last").isNull() | (F.timestamp_diff("HOUR", F.col("_last"), now) >= gap_days * 24 - 12)
    return items.join(last, "wid", "left").where(due).drop("_last")


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without rows whose keys new has, and new: a repeated write changes nothing. Null keys are equal; columns may be added."""
    k = new.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    kept = old.join(k, [old[c].eqNullSafe(k[f"_{c}"]) for c in keys], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def record_observations(old: DataFrame, listings: DataFrame) -> DataFrame:
    """Observations after runs' listings (run, wid, trusted, eligible, from_url and more) are recorded: those that are trusted, eligible or of an own link, in place of all
    that their run and item had, also where none is left. The three marks may be null; trusted is kept, the other two are not; old has the other columns of listings or fewer.
    """
    of_run = listings.select("run", "wid").distinct()
    kept = old.join(of_run, [old[c].eqNullSafe(of_run[c]) for c in ("run", "wid")], "left_anti")
    marks = [F.coalesce(c, F.lit(False)) for c in ("trusted", "eligible", "from_url")]
    return kept.unionByName(listings.where(marks[0] | marks[1] | marks[2]).drop("eligible", "from_url"), allowMissingColumns=True)


def retain(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows not older than `days`; rows without a time go."""
    return df.where(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))


def newest(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The n newest rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
