"""Exact medians where a key may hold any share of the rows: by groups, and over trailing windows of time.

Both work on distinct values with their counts, so equal rows meet before any
key does, and neither gathers what a hot key holds in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of values for each factor of e: a bin is 0.4 % wide, so prices up to 10,000 have 4,000 cents at most in one, and 0.01 to a million takes 4,700 bins.
BINS = 256


def bin_of(v: Column) -> Column:
    """A whole number that doesn't fall as v grows: bins of equal ratio from one cent up, and the same below zero. Only an aid to search, never part of a result."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v) * 100) * BINS)


def group_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median, n): the exact median of each key's values, the mean of the two in the middle if their number is even.

    Counts of (key, value), then a histogram by bins, in which the one bin that holds
    the lower middle is found; only that bin's distinct values are put in order. The
    upper middle is the next value of the bin or the least of the next bin. Null values
    and NaN count for nothing, and keys without values have no row, nor has a null key;
    equal rows count one by one. For keys of few distinct values `median` is as exact
    and cheaper, as these meet with their counts.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.dropna(subset=[f"`{c}`" for c in (*keys, value)]).select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.col(f"`{value}`").cast("double").alias("_v"))
    counts = rows.groupBy(*names, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", bin_of(F.col("_v")))
    bins = counts.groupBy(*names, "_b").agg(F.sum("_c").alias("_c"), F.min("_v").alias("_least"))
    by_bin = Window.partitionBy(*names).orderBy("_b")
    all_of = Window.partitionBy(*names)
    bins = bins.withColumns({"_n": F.sum("_c").over(all_of), "_to": F.sum("_c").over(by_bin), "_next": F.lead("_least").over(by_bin)})
    lower = F.floor((F.col("_n") - 1) / 2)  # ranks from 0
    found = bins.where((F.col("_to") > lower) & (F.col("_to") - F.col("_c") <= lower)).select(*[F.col(n).alias(f"_f{n}") for n in names], F.col("_b").alias("_fb"), "_n", (F.col("_to") - F.col("_c")).alias("_below"), "_next")
    same = [counts[n] == found[f"_f{n}"] for n in names]
    inside = counts.join(found, [*same, counts["_b"].eqNullSafe(found["_fb"])])  # null-safe, so that no filter for it parts the two uses of counts, which are one exchange
    by_value = Window.partitionBy(*names).orderBy("_v")
    inside = inside.withColumns({"_to": F.col("_below") + F.sum("_c").over(by_value), "_up": F.coalesce(F.lead("_v").over(by_value), "_next")})
    middle = inside.where((F.col("_to") > lower) & (F.col("_to") - F.col("_c") <= lower))
    upper = F.when(F.col("_to") > F.floor(F.col("_n") / 2), F.col("_v")).otherwise(F.col("_up"))
    return middle.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], (0.5 * F.col("_v") + 0.5 * upper).alias("median"), F.col("_n").alias("n"))


def _ranked(values: np.ndarray, weights: np.ndarray, start: np.ndarray, stop: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The value at `rank` (from 0, by weight) of each window start:stop of values, for all windows at once.

    A wavelet matrix: values become their ranks, whose bits sort the rows stably from
    the highest to the lowest; at each bit a window is again a window, of the rows with
    a 0 or those with a 1, and prefix sums of weights say in which the rank lies.
    """
    distinct, code = np.unique(values, return_inverse=True)
    start, stop, rank = start.copy(), stop.copy(), rank.copy()
    answer = np.zeros(len(start), np.int64)
    for bit in reversed(range(max(1, int(len(distinct) - 1).bit_length()))):
        ones = (code >> bit) & 1
        zeros = np.concatenate(([0], np.cumsum(1 - ones)))
        weight = np.concatenate(([0], np.cumsum(weights * (1 - ones))))
        held = weight[stop] - weight[start]
        up = rank >= held
        rank -= np.where(up, held, 0)
        answer |= up.astype(np.int64) << bit
        start, stop = (np.where(up, zeros[-1] + x - zeros[x], zeros[x]) for x in (start, stop))
        order = np.argsort(ones, kind="stable")
        code, weights = code[order], weights[order]
    return distinct[answer]


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Where a value isn't the one before it; nulls are equal."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return np.concatenate(([True], other.to_numpy(zero_copy_only=False).astype(bool)))


def _answers(rows: pa.Table, width: int) -> pa.Table:
    """(_w, _at, _median, _n) at each distinct time of its own block, for whole groups in order of item, block and time."""
    block, at, values, weights = (rows[c].to_numpy() for c in ("_block", "_at", "_v", "_c"))
    groups = np.cumsum(_changes(rows["_w"]) | _changes(rows["_block"])) - 1
    base = (block - 1) * width
    place = lambda t: groups * (2 * width) + np.clip(t - base, 0, 2 * width - 1)
    here, since = place(at), place(rows["_from"].to_numpy())
    asked = np.flatnonzero((np.diff(here, prepend=-1) != 0) & rows["_own"].to_numpy().astype(bool))
    known = weights > 0  # rows without a value only ask
    held = here[known]
    start, stop = np.searchsorted(held, since[asked], "left"), np.searchsorted(held, here[asked], "right")
    total = np.concatenate(([0], np.cumsum(weights[known])))
    n = total[stop] - total[start]
    some = n > 0
    median = np.zeros(len(asked))
    if some.any():
        windows = values[known], weights[known], start[some], stop[some]
        median[some] = 0.5 * _ranked(*windows, (n[some] - 1) // 2) + 0.5 * _ranked(*windows, n[some] // 2)
    out = rows.select(["_w", "_at"]).take(asked)
    return out.append_column("_median", pa.array(median, mask=~some)).append_column("_n", pa.array(n.astype(np.int64)))


def _whole_groups(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Answers batch by batch; a batch's last group waits for its rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            new = _changes(table["_w"]) | _changes(table["_block"])
            if waiting:
                ends = pa.Table.from_batches([waiting[-1].slice(len(waiting[-1]) - 1), batch.slice(0, 1)])
                new[0] = bool((_changes(ends["_w"]) | _changes(ends["_block"]))[1])
            cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if cut or new[0]:
                whole = pa.Table.from_batches([*waiting, batch.slice(0, cut)])
                waiting = []
                if len(whole):
                    yield from _answers(whole.combine_chunks(), width).to_batches()
            waiting.append(batch.slice(cut))
        if waiting:
            yield from _answers(pa.Table.from_batches(waiting).combine_chunks(), width).to_batches()

    return run


def sliding_medians(series: DataFrame, days: int) -> DataFrame:
    """(wid, dt, median, n) for each distinct wid and dt of series (wid, dt, v): the exact median and number of the item's values of the last `days`, both ends included.

    Time is cut into blocks a day longer than the window (clocks may change), and a
    row goes to its own block and the next, so an item's history is spread over its
    blocks and a block answers its own times alone. In a block all windows descend
    one rank structure together: n log n steps, whatever the windows hold. A task
    holds two blocks of an item, as distinct (time, value) with counts.

    Null values only ask and give median null and n 0 where nothing else is in the
    window; rows with a null time are each other's window; a null wid is an item.
    """
    kind = dict(series.dtypes)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    width = (days + 1) * 86_400_000_000
    timed = series.where("dt IS NOT NULL").groupBy(F.col("wid").alias("_w"), F.col("dt").alias("_dt"), F.col("v").cast("double").alias("_v")).agg(F.count("v").alias("_c"))
    timed = timed.select("_w", micros(F.col("_dt")).alias("_at"), micros(F.col("_dt") - F.expr(f"INTERVAL {days} DAYS")).alias("_from"), F.coalesce("_v", F.lit(0.0)).alias("_v"), "_c")
    block = F.floor(F.col("_at") / width)
    parts = timed.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_block", F.when(F.col("_own"), block).otherwise(block + 1))
    parts = parts.repartition("_w", "_block").sortWithinPartitions("_w", "_block", "_at")
    got = parts.mapInArrow(_whole_groups(width), f"_w {kind['wid']}, _at bigint, _median double, _n bigint")
    times = series.where("dt IS NOT NULL").select("wid", "dt").distinct()
    found = times.join(got, times["wid"].eqNullSafe(got["_w"]) & (micros(times["dt"]) == got["_at"])).select("wid", "dt", F.col("_median").alias("median"), F.col("_n").alias("n"))
    untimed = series.where("dt IS NULL").groupBy("wid").agg(F.first("dt").alias("dt"), F.median("v").alias("median"), F.count("v").alias("n"))
    return found.unionByName(untimed)
