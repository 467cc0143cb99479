"""Exact medians against brute force: groups and trailing windows, with hot keys, ties, nulls and repeated rows."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import history, medians


def test_ranks_in_windows():
    rng = np.random.default_rng(5)
    for n, top in ((1, 1), (40, 3), (500, 10_000)):
        values, weights = rng.integers(0, top, n).astype(float), rng.integers(1, 4, n)
        start = rng.integers(0, n, 60)
        stop = np.minimum(n, start + rng.integers(1, 50, 60))
        windows = [np.sort(np.repeat(values[a:b], weights[a:b])) for a, b in zip(start, stop)]
        rank = np.array([rng.integers(0, len(w)) for w in windows])
        assert medians._ranked(values, weights, start, stop, rank).tolist() == [w[r] for w, r in zip(windows, rank)]


def test_group_medians(spark):
    rng = random.Random(3)
    rows = [("hot", "a.b", round(rng.lognormvariate(3, 2), 2)) for _ in range(3001)] + [("even", "x", float(x)) for x in (1, 2, 2, 10)] + [("even", None, 9.0), ("even", "x", float("nan"))] + [("far", "x", v) for v in (0.01, 1e6)]
    rows += [(None, None, -5.0), (None, None, 0.0), (None, None, 7.0), ("none", "x", None), ("one", "x", 4.25), ("ties", "x", 3.0), ("ties", "x", 3.0), ("below", "x", -8.0), ("below", "x", -2.0)]
    df = spark.createDataFrame(rows, "wid string, `the.side` string, p double").withColumn("_c", F.lit(1)).repartition(7)
    got = {(r[0], r[1]): (r[2], r[3]) for r in medians.group_medians(df, ["wid", "the.side"], "p").collect()}
    groups = {}
    for a, b, v in rows:
        if v is not None and v == v and a is not None and b is not None:
            groups.setdefault((a, b), []).append(v)
    assert {k: v[1] for k, v in got.items()} == {k: len(v) for k, v in groups.items()}
    assert {k: v[0] for k, v in got.items()} == pytest.approx({k: statistics.median(v) for k, v in groups.items()}, abs=1e-12)
    assert medians.group_medians(df.limit(0), ["wid"], "p").count() == 0


@pytest.fixture
def batches(spark):
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_sliding_medians(spark, batches, batch):
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for wid, many in ((1, 400), (2, 40), (None, 30)):
        for _ in range(many):
            rows.append((wid, start + dt.timedelta(days=rng.randrange(60), hours=rng.choice([0, 0, 6])), rng.choice([None, 5.0, round(rng.uniform(1, 90), 2)])))
    rows += rows[:50] + [(1, None, 4.0), (1, None, 6.0), (3, None, None), (4, start, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    df = spark.createDataFrame(rows, "wid int, dt timestamp, v double").withColumns({"median": F.lit("clash"), "a.b": F.lit(1)}).repartition(5)
    out = history.trailing_median(df, 7)
    assert out.columns == ["wid", "dt", "v", "a.b", "median", "n"]
    got = sorted(((r["wid"], r["dt"], r["v"], r["median"], r["n"]) for r in out.collect()), key=repr)
    want = []
    for wid, at, v in rows:
        if at is None:
            held = [x for w, t, x in rows if w == wid and t is None and x is not None]
        else:
            held = [x for w, t, x in rows if w == wid and t is not None and at - dt.timedelta(days=7) <= t <= at and x is not None]
        want.append((wid, at, v, np.floor(statistics.median(held) * 100 + 0.5000001) / 100 if held else None, len(held)))
    assert got == sorted(want, key=repr)
    assert history.trailing_median(df.limit(0)).count() == 0


def test_one_item_of_many_rows(spark):
    """A single item's blocks go to many tasks, and the work doesn't grow with the windows."""
    hot = spark.range(200_000).select(F.lit(1).alias("wid"), (F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id") * 600)).alias("dt"), (F.hash("id") % 10_000 / 100.0).alias("v"))
    last = history.trailing_median(hot).orderBy(F.desc("dt")).first()
    held = [r[0] for r in hot.where(F.col("dt") >= last["dt"] - dt.timedelta(days=30)).select("v").collect()]
    assert (last["n"], last["median"]) == (len(held), np.floor(statistics.median(held) * 100 + 0.5000001) / 100)
