import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import ngrams
from larkspur.llm.ngrams import MU, NU, EliasFano, Trie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, score string, held_out boolean"


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 5, 5, 9, 1000], [2**63, 2**63 + 5], list(range(500)), [7] * 200 + [2**40]])
def test_elias_fano(values):
    ef = EliasFano.build(np.array(values, np.uint64))
    assert ef[np.arange(len(values))].tolist() == values
    n = len(values)
    for lo, hi in ((0, n), (n // 3, n), (n // 2, n // 2)):
        wanted = np.array([0, 1, 5, 6, 999, 2**40 - 1, 2**40 + 1, 2**63 + 1, *values[:20]], np.uint64)
        want = [next((i for i in range(lo, hi) if values[i] >= w), hi) for w in wanted.tolist()]
        assert ef.successor(wanted, np.full(len(wanted), lo), np.full(len(wanted), hi)).tolist() == want


def test_elias_fano_random():
    rng = np.random.default_rng(5)
    for n, top in ((1000, 1 << 12), (3000, 1 << 40), (100, 1 << 20)):
        x = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        ef = EliasFano.build(x)
        assert (ef[np.arange(n)] == x).all()
        q = rng.integers(0, top, 2000, dtype=np.uint64)
        assert (ef.successor(q, np.zeros(2000, int), np.full(2000, n)) == np.searchsorted(x, q)).all()


def test_trie_lookup(tmp_path):
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 28, 4000, dtype=np.uint64))
    counts = rng.integers(0, 5, len(keys))
    blob = Trie.build(keys, counts, 2)
    (tmp_path / "trie").write_bytes(blob)
    for trie in (Trie.mapped(blob), Trie(np.memmap(tmp_path / "trie", np.uint8, "r"))):
        count, rest, kept = trie.lookup(keys)
        context = (keys >> np.uint64(24)).tolist()
        total = collections.Counter()
        for c, n in zip(context, counts.tolist()):
            total[c] += n
        assert count.tolist() == [ngrams.quantise_count(np.array([total[c]]))[0] for c in sorted(total)]
        want = [n / (total[c] + NU) if n >= 2 else 0 for c, n in zip(context, counts.tolist())]
        assert np.allclose(ngrams._VALUES[kept], want, rtol=0.04)


def brute(docs, learns):
    tokens = [WORDS.findall((t or "").translate(LOWER)) + ["\n"] for _, t in docs]
    one, two, three, kept = (collections.Counter() for _ in range(4))
    for t, learn in zip(tokens, learns):
        if learn:
            x = [" ", " ", *t]
            one.update([" ", *t])
            two.update([(" ", " "), *zip(x[1:], x[2:])])
            three.update(zip(x, x[1:], x[2:]))
    for (u, v, _), c in three.items():
        kept[u, v] += c * (c >= 2)
    total, distinct = sum(c for w, c in one.items() if w != " "), len(one) - (" " in one)
    for t in tokens:
        base = score = 0.0
        for u, v, w in zip([" ", " ", *t], [" ", *t], t):
            p1 = (one[w] + 0.5) / (total + 0.5 * (distinct + 1))
            p2 = (two[v, w] + MU * p1) / (one[v] + MU)
            c = two[u, v]
            p = (three[u, v, w] / (c + NU) if three[u, v, w] >= 2 else 0) + (c + NU - kept[u, v]) / (c + NU) * p2
            base, score = base + math.log10(p1), score + math.log10(p)
        yield len(t), sum(one[w] > 0 for w in t), total, base, score


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 60)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \t\n"), (203, "W1 w1\x0bÉtÉ <s>"), (0, docs[0][1]), (None, "w1 w2"), (204, "w3 " * 30_000)]
    learns = [zlib.crc32(str("" if i is None else i).encode()) % 5 != 1 for i, _ in docs]
    df = spark.createDataFrame([(i, t, "mine", None) for i, t in docs], SCHEMA)
    out = ngrams.score(df, ngrams.crc_remainder("doc_id", 5) != 1, min_count=2).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "held_out").collect()
    assert len(out) == len(docs)
    want = sorted(((-1 if i is None else i), *b) for (i, _), b in zip(docs, brute(docs, learns)))
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), *r[1:6]) for r in out)
    for w, g in zip(want, got):
        assert w[:4] == g[:4] and g[4] == pytest.approx(w[4], rel=1e-9) and abs(g[5] - w[5]) <= 0.03 * w[1]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngrams.score(empty, F.lit(True)).count() == 0 and ngrams.learn(empty).count() == 0
    r = ngrams.score(spark.createDataFrame([(1, "a b", None, None)], SCHEMA), F.lit(False)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and r["base_score"] == 0.0


def test_word_level():
    keys = np.array([3, 9, 2**63, 2**64 - 1], np.uint64)
    level = ngrams.WordLevel.mapped(ngrams.WordLevel.build(keys, np.array([5, 0, 70_000, 1])))
    assert level.lookup(np.array([0, 3, 9, 10, 2**63, 2**64 - 1], np.uint64)).tolist() == [0, 5, 0, 0, 70_000, 1]
    assert ngrams.WordLevel(ngrams.WordLevel.build(keys[:0], np.zeros(0, int))).lookup(keys).tolist() == [0] * 4


def test_model_can_be_kept(spark):
    df = spark.createDataFrame([(1, "a b a b a b", None, None), (2, "a b c", None, None)], SCHEMA)
    tries = [Trie.mapped(bytes(r["level"])) for r in ngrams.learn(df).where("kind = 1").collect()]
    assert sum(t.contexts.n for t in tries) == len({("", ""), ("", "a"), ("a", "b"), ("b", "a"), ("b", "END"), ("b", "c"), ("c", "END")})


def test_kept_model_scores_alike(spark):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(rng.choice([f"w{j}" for j in range(50)], rng.integers(0, 60))), i % 4 > 0) for i in range(90)] + [(500, None, False), (501, "new words only", False), (7, "w1 w2", True)]
    df = spark.createDataFrame(docs, "doc_id long, text string, mine boolean")
    model = ngrams.materialize(ngrams.learn(df.where("mine")))
    both = [{(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9), round(r["score"], 9)) for r in x.collect()} for x in (ngrams.score(df, F.col("mine")), ngrams.score_with(df, model))]
    assert both[0] == both[1] and len(both[0]) == len(docs)
    assert ngrams.score_with(df, model.limit(0)).first()["train_tokens"] == 0 and ngrams.score_with(df.limit(0), model).count() == 0


def test_query_keeps_trigrams_seen_once(spark, tmp_path):
    learns = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    train, held = [i for i in range(200) if learns(i)], [i for i in range(200) if not learns(i)]
    rng = np.random.default_rng(3)
    docs = {i: " ".join(rng.choice([f"w{j}" for j in range(60)], 50)) for i in train[:20]}
    docs[train[20]] = " ".join(f"only{j}" for j in range(40))
    docs |= {held[0]: docs[train[20]], held[1]: docs[train[0]], held[2]: "w1 w2 only3", held[3]: None}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    one, two, three, follow = (collections.Counter() for _ in range(4))
    padded = {i: [" ", " ", *WORDS.findall(t or ""), "\n"] for i, t in docs.items()}
    for i, x in padded.items():
        if learns(i):
            one.update(x[1:])
            two.update(zip(x, x[1:]))
            three.update(zip(x, x[1:], x[2:]))
    for (u, v, _), c in three.items():
        follow[u, v] += c
    total, distinct = sum(one.values()) - one[" "], len(one) - 1
    for r in ngrams.query(spark, str(tmp_path)).collect():
        x, want = padded[r["doc_id"]], 0.0
        for u, v, w in zip(x, x[1:], x[2:]):
            p2 = (two[v, w] + MU * (one[w] + 0.5) / (total + 0.5 * (distinct + 1))) / (one[v] + MU)
            c = two[u, v]
            want += math.log10(three[u, v, w] / (c + NU) + (c + NU - follow[u, v]) / (c + NU) * p2)
        assert abs(r["score"] - want) <= 0.03 * (len(x) - 2), r["doc_id"]
