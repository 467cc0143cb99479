import math

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import negatives

OUT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, positives=5, low=50, high=95):
    real = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and len(v) == 4 and all(x is not None and math.isfinite(x) and abs(x) * 256 < negatives.LARGEST for x in v):
            x = (label, [math.floor(256 * c) for c in v])
            real[i] = min(real.get(i, x), x)
    out = []
    for a, (label, v) in real.items():
        if a % 5 == 0:
            score = sorted((-sum(p * q for p, q in zip(v, w)), i, m) for i, (m, w) in real.items() if i != a)
            for s, p, _ in [x for x in score if x[2] == label][:positives]:
                bad = [x for x in score if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:3]
                out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(bad)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, v, m, "k", 2) for i, v, m in rows], "vec_id long, embedding array<double>, label int, V string, cluster int")
    out = negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, **options)
    assert out.columns == OUT
    return sorted(tuple(r) for r in out.collect())


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 4))
    x = centres[rng.integers(0, 9, n)] + 0.2 * rng.normal(size=(n, 4))
    return [(i, [float(c) for c in v], int(rng.integers(0, 3))) for i, v in enumerate(x)]


def test_against_brute_force(spark, monkeypatch):
    rows = vectors(500)
    assert len(brute(rows)) > 500 and mined(spark, rows) == brute(rows)
    monkeypatch.setattr(negatives, "PROBES", 1)
    assert mined(spark, rows) == brute(rows)


def test_ties_and_equal_vectors(spark):
    """A hot vector and many equal scores: the smallest ids come first."""
    rows = [(i, [1.0, 0.0, 0.5, 0.0], 1) for i in range(60)] + [(i, [0.7, 0.0, 0.35, 0.0], i % 3) for i in range(60, 200)] + vectors(100, 2)[:20]
    rows = [(i, v, m) for i, (_, v, m) in enumerate(rows)]
    assert mined(spark, rows) == brute(rows)


def test_rows_that_take_no_part(spark):
    rows = vectors(120) + [
        (1000, None, 1), (1005, [1.0, None, 0.0, 0.0], 1), (1010, [math.nan, 0.0, 0.0, 0.0], 1), (1015, [math.inf, 1.0, 1.0, 1.0], 1), (1020, [1.0, 1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0, 1.0], 1),
        (1025, [], 1), (1030, [1.0], 1), (1035, [1e300, 0.0, 0.0, 0.0], 0), (1040, [-3.0, 2.0, 0.0, 1.0], 0), (1040, [3.0, 2.0, 0.0, 1.0], 0), (1040, [3.0, 2.0, 0.0, 1.0], 2), (-5, [0.5, 0.5, 0.1, 0.1], 1),
    ]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, rows[120:123]) == []
    assert mined(spark, vectors(1)) == [] and mined(spark, [(0, [1.0] * 4, 1), (5, [1.0] * 4, 1)]) == []


def test_lists_are_ruled_out_by_their_bounds(spark):
    """With tight clusters an anchor visits few lists after its first ones."""
    rng = np.random.default_rng(3)
    centres = 4 * rng.normal(size=(40, 16))
    rows = [(i, [float(c) for c in centres[i % 40] + 0.01 * rng.normal(size=16)], i % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    q = negatives.quantised(df, "vec_id", "embedding", F.col("label"), 256)
    centre = negatives._fit(q, 2000)
    listed = negatives._listed(q, centre)
    stats = [(r["cluster"], 1, r["far"]) for r in listed.groupBy("cluster").agg(F.max("far").alias("far")).collect()]
    best = max(abs(int(256 * c)) for _, v, _ in rows for c in v) ** 2
    asks = listed.where("vec_id % 50 = 0").selectExpr("0L AS ask", "vec_id AS anchor_id", "label", "v", f"-{best * 16}L AS low", f"{best * 16}L AS high", "aggregate(v, 0L, (a, x) -> a + x * x) * 9 DIV 10 AS kth")
    later = negatives._visits(asks, centre, stats, True).count()
    assert later < 0.2 * asks.count() * len(stats)
