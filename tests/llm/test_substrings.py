import os
import re
import time

import numpy as np

from larkspur.llm import substrings
from larkspur.llm.substrings import FingerprintIndex

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, span, history=()):
    seen = {tuple(w[i : i + span]) for t in history if (w := WORDS.findall(t)) for i in range(len(w) - span + 1)}
    out = []
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - span + 1):
            window = tuple(w[a : a + span])
            if window in seen:
                gone[a : a + span] = [True] * span
            seen.add(window)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def corpus(seed, first, n=60):
    rng, shared = np.random.default_rng(seed), [np.random.default_rng(7 + k).integers(0, 10**6, 45).astype(str) for k in range(4)]
    docs = []
    for i in range(n):
        parts = [rng.integers(0, 10**6, rng.integers(1, 50)).astype(str)]
        for _ in range(rng.integers(0, 3)):
            p = shared[rng.integers(0, 4)]
            parts += [p[rng.integers(0, 10) :], rng.integers(0, 10**6, 5).astype(str)]
        docs.append((first + i, rng.choice([" ", "\n", " \t"]).join(np.concatenate(parts))))
    return docs


def result(df):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], " ".join(WORDS.findall(r["kept_text"]))) for r in df.collect())


def test_against_brute_force(spark):
    docs = corpus(1, 0) + [(500, None), (501, ""), (502, " "), (503, "z " * 60), (504, "y " * 40_000), (505, "A b " * 30), (506, "a b " * 30)]
    df = spark.createDataFrame([(i, t, "r", 5) for i, t in docs], "doc_id long, text string, removed string, block int")
    assert result(FingerprintIndex(spark).ingest(df)) == brute(docs, 20)


def test_batches_and_compaction(spark, tmp_path):
    index, history = FingerprintIndex(spark, f"file://{tmp_path}/index", span=10, max_runs=2), []
    for n in range(5):
        docs = corpus(n, 1000 * n, 25)
        out = index.ingest(spark.createDataFrame(docs, "doc_id long, text string"))
        assert result(out) == brute(docs, 10, history)
        history += [t for _, t in docs]
        assert len(index.runs()) <= 2
    assert sum(r["n_removed"] for r in index.ingest(spark.createDataFrame(docs, "doc_id long, text string")).collect()) > 0.9 * sum(len(WORDS.findall(t)) for _, t in docs if len(WORDS.findall(t)) >= 10)


def test_text_keeps_its_white_space(spark):
    p = " ".join(f"p{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"a\n{p}\tb"), (2, f" c\n\n{p}\nd  e\n"), (3, p), (4, "plain\ntext ")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in substrings.deduplicate(df).collect()} == {1: f"a\n{p}\tb", 2: " c\n\nd  e\n", 3: "", 4: "plain\ntext "}


def test_edges(spark):
    assert FingerprintIndex(spark).ingest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    p = " ".join(map(str, range(30)))
    rows = FingerprintIndex(spark).ingest(spark.createDataFrame([(None, p), (5, p), (5, p)], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in rows) == [("5", 0), ("5", 30), ("None", 30)]


def test_words_are_told_apart(spark):
    from tests.llm.test_small_operators import thue_morse

    rest = " ".join(f"r{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{thue_morse()} {rest}"), (2, f"{thue_morse('ba')} {rest}"), (3, f"{thue_morse()} {rest}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in FingerprintIndex(spark).ingest(df).collect()} == {1: 0, 2: 0, 3: 20}


def test_batches_are_one_table(spark, tmp_path):
    docs = corpus(3, 0, 80) + [(90, None), (None, "a " * 40), (5, "b " * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    path = f"file://{tmp_path}/index"
    out = substrings.in_batches(df, path)
    key = lambda r: str(r)
    assert sorted(result_of(out), key=key) == sorted(result_of(FingerprintIndex(spark).ingest(df)), key=key)
    index = FingerprintIndex(spark, path)
    assert len(index.runs()) == 2 and index._manifest()[0] == 4  # three batches and a compaction
    index.compact()
    assert len(index.runs()) == 1 and index.ingest(df.where("doc_id < 80")).where("n_words - n_removed >= 20").count() == 0
    assert substrings.in_batches(df.limit(0), f"file://{tmp_path}/none").count() == 0


def result_of(df):
    return [(r["doc_id"], r["n_words"], r["n_removed"], " ".join(WORDS.findall(r["kept_text"]))) for r in df.collect()]


def test_only_present_runs_stay_on_disk(spark, tmp_path):
    def shuffled():
        folders = [d for d in os.walk(spark.sparkContext.getConf().get("spark.local.dir"))]
        return {f: os.path.getsize(f"{d}/{f}") for d, _, files in folders for f in files if f.startswith("shuffle_") and f.endswith(".data")}

    rng, before = np.random.default_rng(5), shuffled()
    docs = [(i, " ".join(rng.integers(0, 10**9, 2000).astype(str))) for i in range(100)]
    path = f"file://{tmp_path}/index"
    substrings.in_batches(spark.createDataFrame(docs, "doc_id long, text string"), path)
    assert sorted(os.listdir(f"{tmp_path}/index/runs")) == sorted(FingerprintIndex(spark, path).runs())
    for _ in range(100):  # files are removed in the background
        left = sum(size for f, size in shuffled().items() if f not in before)
        if left < 50_000:
            break
        time.sleep(0.1)
    assert left < 50_000  # of 1.9 MB of texts and 200,000 windows
