import numpy as np
import pytest

from larkspur.llm import metric
from tests.llm.test_neardup import brute, corpus


def joined(spark, docs, k, percent):
    rows = metric.metric_join(spark.createDataFrame(docs, "doc_id long, text string"), k, percent).collect()
    return sorted(tuple(r) for r in rows)


def expected(docs, k, percent):
    return [r[:3] for r in brute(docs, k, percent)]


@pytest.mark.parametrize("seed, k, percent", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_against_brute_force(spark, seed, k, percent):
    docs = corpus(seed) + [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "one two three"), (906, "x " * 50_000), (907, "x " * 50_000)]
    df = spark.createDataFrame([(i, t, "c", 1.0) for i, t in docs], "doc_id long, text string, Component string, D double")
    assert sorted(tuple(r) for r in metric.metric_join(df, k, percent).collect()) == expected(docs, k, percent)


def test_groups_about_the_threshold(spark, monkeypatch):
    """Copies whose mutual similarities lie on both sides of it, in regions that are split again and compared by parts."""
    monkeypatch.setattr(metric, "SMALL", 16)
    rng = np.random.default_rng(5)
    docs, n = [], 0
    for words, edits in ((120, 3), (200, 4), (90, 2)):
        base = rng.integers(0, 10**6, words).astype(str)
        for i in range(90):
            copy = base.copy()
            copy[rng.integers(0, words, rng.integers(0, edits + 1))] = f"e{n}"
            docs.append((n, " ".join(copy)))
            n += 1
    assert joined(spark, docs, 4, 85) == expected(docs, 4, 85)


def test_one_word_more(spark):
    """Pairs exactly at the threshold: 85 of 100 shingles in common, and one less."""
    w = [f"w{i}" for i in range(103)]
    docs = [(1, " ".join(w[:88])), (2, " ".join(w)), (3, " ".join(f"v{i}" for i in range(87))), (4, " ".join(f"v{i}" for i in range(103)))]
    assert joined(spark, docs, 4, 85) == [(1, 85, 1), (2, 100, 1), (3, 84, 3), (4, 100, 4)] == expected(docs, 4, 85)


def test_edges(spark):
    assert joined(spark, [], 4, 85) == []
    rows = metric.metric_join(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "z")], "doc_id long, text string"), 5, 80).collect()
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, [(None, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (2, 1, 1)]))
