import re

import numpy as np
import pytest

from larkspur.llm import neardup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, k, percent=80):
    sets = {}
    for i, t in docs:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    least = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return sorted((i, len(sets[i]), least[i], least[i] == i) for i in sets)


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    docs, passage = [], rng.choice(vocabulary, 60)
    for g in range(12):
        base = rng.choice(vocabulary, rng.integers(40, 200))
        for _ in range(rng.integers(1, 14)):
            copy = base.copy()
            edits = rng.random(len(copy)) < rng.choice([0, 0.01, 0.03, 0.05, 0.08])
            copy[edits] = rng.choice(vocabulary, edits.sum())
            docs.append(" ".join(np.concatenate([passage, copy]) if g % 3 == 0 else copy))
    chain = list(rng.choice(vocabulary, 120))
    for i in range(6):  # a link leads to the next only
        docs.append(" ".join(chain[i * 8 :] + list(rng.choice(vocabulary, i * 8))))
    return [(int(i), d) for i, d in zip(rng.permutation(len(docs)), docs)]


@pytest.mark.parametrize("seed, k", [(1, 4), (2, 5), (3, 2)])
def test_against_brute_force(spark, seed, k):
    docs = corpus(seed) + [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "one two three"), (906, "x " * 50_000), (907, "x " * 50_000)]
    df = spark.createDataFrame([(i, t, "c", "h") for i, t in docs], "doc_id long, text string, component_id string, hub string")
    assert sorted(tuple(r) for r in neardup.near_duplicates(df, k).collect()) == brute(docs, k)


def test_large_group_stays_linear(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 10**6, 150).astype(str)
    docs = []
    for i in range(600):
        copy = base.copy()
        copy[rng.integers(0, 150, rng.integers(0, 8))] = f"e{i}"
        docs.append((i, " ".join(copy)))
    assert sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()) == brute(docs, 4)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = neardup.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], schema)).collect()
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, [(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]))
    kept = neardup.keep_one(spark.createDataFrame([(3, "a b c d e f", 1), (2, "A b c d e f", 2), (9, None, 3)], schema + ", kept int"))
    assert kept.columns == ["doc_id", "text", "kept"] and sorted(r["doc_id"] for r in kept.collect()) == [2, 9]


def test_structured_words_and_repeated_ids(spark):
    from tests.llm.test_small_operators import thue_morse

    docs = [(1, thue_morse()), (2, thue_morse("ba")), (3, thue_morse()), (4, "a b c d e f g h"), (4, "z"), (5, "a b c d e f g h"), (6, "z")]
    rows = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect())
    assert rows == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 1, 4), (4, 5, 4), (5, 5, 4), (6, 1, 6)]


def test_template_below_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART_ROWS", 16)  # so that the template's shingles are dealt in parts
    shared = [f"t{i}" for i in range(75)]
    docs = [(i, " ".join(shared + [f"u{i}_{j}" for j in range(24)])) for i in range(80)]
    docs += [(100 + i, docs[i][1] + " tail") for i in range(5)]
    rows = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()}
    assert rows == {i: i for i in range(80)} | {100 + i: i for i in range(5)}
    assert sorted(rows.items()) == sorted((r[0], r[2]) for r in brute(docs, 4))
