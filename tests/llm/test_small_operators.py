import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import chat, decontam, packing, quality, rules, sharding

# Sharding


def test_table_is_fair_and_stable():
    shards = [f"s{i}" for i in range(7)]
    owner = sharding.fill(shards, 503)
    sizes = collections.Counter(owner)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.fill(shards[:-1], 503)
    assert sum(a != b for a, b in zip(owner, fewer) if a != 6) < 0.25 * 503
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad, 503)
    with pytest.raises(ValueError):
        sharding.fill(shards, 500)


def test_placement(spark):
    df = spark.createDataFrame([(1, "a", 9), (1, "a", 8), (None, None, 7), (2, "", 6)], "k long, t string, slot int")
    out = sharding.place(df, ["k", "t"], ["x", "y"], 11).collect()
    assert len(out) == 4 and len({(r["slot"], r["shard"]) for r in out if r["k"] == 1}) == 1 and sharding.place(df.limit(0), ["k"], ["x"], 3).count() == 0


# Packing


def test_plan_uses_every_piece():
    rng = random.Random(0)
    for size in (8, 20, 64):
        for _ in range(20):
            counts = collections.Counter(rng.choices(range(1, size + 1), k=rng.randint(0, 300)))
            used = collections.Counter()
            patterns = packing.plan(dict(counts), size)
            for pattern, times in patterns:
                assert sum(pattern) <= size and times > 0
                for n in pattern:
                    used[n] += times
            assert +used == +counts
            least = -(-sum(n * c for n, c in counts.items()) // size)
            assert sum(t for _, t in patterns) <= 1.25 * least + 2
    assert packing.plan({5: 2, 3: 2}, 8) == [((5, 3), 2)] and packing.plan({}, 8) == []
    assert sum(t for _, t in packing.plan({4: 3, 2: 6}, 8)) == 3


def check_packed(rows, size):
    spans = collections.defaultdict(list)
    for r in rows:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(spans)


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = [None, "", "Hello, world. Don't!", "é ç. ǅ ½ <|endoftext|>, a.b.", "word " * 5000, "x, y. " * 30, "Hello, world. Don't!"] + [f"text number {i} " * (i % 40) for i in range(200)]
    df = spark.createDataFrame([(i, t, "p", 1) for i, t in enumerate(texts)], "doc_id long, text string, piece string, length int")
    rows = packing.pack_documents(df, size=64, ids=True).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(by[i], key=lambda r: r["piece"])
        assert [x for r in parts for x in r["ids"]] == want and [r["start"] for r in parts] == list(range(0, len(want), 64))
        assert all(r["length"] == 64 for r in parts[:-1]) and all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in parts)
    n = check_packed(rows, 64)
    assert n <= 1.01 * sum(r["length"] for r in rows) / 64 + 2
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_complements_are_complete():
    from itertools import combinations_with_replacement

    rng = random.Random(2)
    for _ in range(60):
        size = rng.choice([12, 30])
        sums = packing.Sums({rng.randint(1, size - 1): rng.randint(1, 4) for _ in range(rng.randint(1, 9))}, size)
        while sums.order:
            n = rng.choice(sums.order)
            have = {x: sums.count[x] - (x == n) for x in sums.order}
            got = sums.complement(size - n, {n: 1})
            want = [p for k in (1, 2, 3) for p in combinations_with_replacement(sorted(have, reverse=True), k) if sum(p) == size - n and all(have[x] >= p.count(x) for x in p)]
            assert (got is None) == (not want) and (got is None or (sum(got) == size - n and len(got) == len(want[0]) and all(have[x] >= got.count(x) for x in got)))
            x = rng.choice(sums.order)
            sums.take(x, rng.randint(1, sums.count[x]))


def test_control_tokens_keep_their_case():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from larkspur.llm.text import Words

    tokenizer, ids = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    for texts in (["<|ENDOFTEXT|> <|endoftext|>"], ["<|endoftext|> <|EndOfText|>", "x<|startoftext|>, X<|STARTOFTEXT|>"], [thue_morse(), thue_morse("ba")]):
        words = Words(pa.array(texts), split=b",.")
        got, at = ids.ids_of(words)
        for i, t in enumerate(texts):
            assert got[at[words.bounds[i]] : at[words.bounds[i + 1]]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    ids.hashes[:] = np.sort(ids.hashes)  # a word remembered under another's hash is encoded anew
    ids.bytes.data[:] = ord("?")
    words = Words(pa.array(["x"]), split=b",.")
    assert ids.ids_of(words)[0].tolist() == tokenizer.encode("x", add_special_tokens=False).ids


def thue_morse(letters="ab", size=1024):
    return "".join(letters[bin(i).count("1") & 1] for i in range(size))


def test_hashes_of_structured_words():
    import pyarrow as pa

    from larkspur.llm.text import Words

    for size in (1024, 4096):
        a, b = (Words(pa.array([thue_morse(x, size) for x in ("ab", "ba")]), seed=s).hash.tolist() for s in (1, 2))
        assert len({*a, *b}) == 4
    text = " ".join(["x" * 70_000, "short", "x" * 70_000, "x" * 69_999])
    h = Words(pa.array([text, "short"])).hash.tolist()
    assert h[0] == h[2] and h[1] == h[4] and len(set(h)) == 3


# Rules


def test_binomial_bound():
    for n, k, p in ((50, 0, 0.05), (100, 3, 0.1), (400, 12, 0.05)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert rules.binomial_cdf(k, n, p) == pytest.approx(exact)
    assert rules.safe(0, 300, 0.05, 0.01) and not rules.safe(0, 20, 0.05, 0.01) and not rules.safe(0, 0, 0.05, 0.5)


def test_counts(spark):
    texts = [None, "", "one two\nthree #\n\none two\n \nthree #", "a b c d e a b c d e x", "α β$ γ", "w " * 40_000]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    rows = {r["doc_id"]: r for r in rules.measure(df).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        repeat = {j + d for j in range(len(w) - 4) if windows[tuple(w[j : j + 5])] > 1 for d in range(5)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        assert tuple(rows[i][c] for c in rules.COUNTS) == want


def test_false_rejection_is_limited(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(3000):
        good = i % 4 > 0
        words = [rng.choice("abcdefgh") * rng.randint(3, 8) + str(rng.random()) for _ in range(30)]
        symbols = rng.choices([0, 1, 60], [0.9, 0.08, 0.02])[0] if good else 200
        docs.append((i, " ".join(words) + " " + "#" * symbols, rng.choice(["en", "de", None])))
        labels.append((i, int(good)))
    docs.append((9999, None, "xx"))
    out = {r["doc_id"]: r for r in rules.filter_quality(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([*labels, (5, None), (12345, 1)], "doc_id long, quality int"), risk=0.05).collect()}
    good = [out[i]["kept"] for i, q in labels if q]
    assert len(out) == 3001 and not out[9999]["kept"] and 0.95 * len(good) <= sum(good) and not any(out[i]["kept"] for i, q in labels if not q)
    nothing = rules.filter_quality(spark.createDataFrame(docs[:5], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert all(r["kept"] for r in nothing)


def test_verdict_against_brute_force(spark):
    rng, docs, labels = random.Random(3), [], []
    for i in range(2400):
        lang = rng.choices(["en", "de", "fr", "xx", None], [60, 30, 5, 3, 2])[0]
        words = [rng.choice("abcdefgh") * (rng.randint(2, 9) if lang != "de" else 40) + str(rng.random())[:6] for _ in range(rng.randint(5, 60))]
        if rng.random() < 0.03:
            words += words[:5]
        text = " ".join(words) + "#" * rng.choices([0, 3, 12, 40], [0.985, 0.01, 0.004, 0.001])[0] + ("\nsame line" * rng.choices([0, 5], [0.99, 0.01])[0])
        docs.append((i, text, lang))
        if rng.random() < 0.6:
            labels.append((i, int(rng.random() < 0.9)))
    labels += [(5, None), (99_999, 1), (7, 0), (7, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r.asDict() for r in rules.filter_quality(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}

    def value(r, k):
        return eval(rules.RULES[k][0].replace(" / ", " / max(1, ") + ")", {"max": max}, dict(r))

    of = collections.defaultdict(list)
    for r in out.values():
        if not r["base_failed"]:
            of[r["stratum"]].append(r)
    fits = {s: [k for k, (_, grid) in rules.RULES.items() if 2 * sum(value(r, k) > grid[0] for r in x) <= len(x)] for s, x in of.items()}

    def first(r):
        return next((i + 1 for i in range(rules.LEVELS) if any(value(r, k) > rules.RULES[k][1][i] for k in fits.get(r["stratum"], ()))), rules.LEVELS + 1)

    marks = collections.defaultdict(set)
    for i, q in labels:
        if q is not None:
            marks[i].add(q)
    good = collections.defaultdict(list)
    for i, r in out.items():
        if marks.get(i) == {1} and not r["base_failed"]:
            good[r["stratum"]].append(first(r))
    tail = lambda k, n: sum(math.comb(n, i) * rules.RISK**i * (1 - rules.RISK) ** (n - i) for i in range(k + 1))
    error = rules.ERROR / len(good)
    small = [s for s, x in good.items() if (1 - rules.RISK) ** len(x) > error]
    pool, level = sum((good[s] for s in small), []), {}
    for s, x in good.items():
        x = pool if s in small else x
        level[s] = next((i - 1 for i in range(1, rules.LEVELS + 1) if sum(f <= i for f in x) == len(x) or tail(sum(f <= i for f in x), len(x)) > error), rules.LEVELS)
    assert 2 <= len(small) < len(good) and 0 < min(level["en"], level["de"]) and "long_words" not in fits["de"] and "long_words" in fits["en"]
    for r in out.values():
        assert r["kept"] == (not r["base_failed"] and first(r) > level.get(r["stratum"], 0)), r
    fit = rules.fitting(rules.measure(df.withColumn("stratum", F.coalesce("lang", F.lit("(null)"))), keep=("doc_id", "stratum")))
    assert {r["stratum"]: r["fits"] for r in fit.collect()} == {s: [k in x for k in rules.RULES] for s, x in fits.items()}
    grid = rules.cutoffs(spark.createDataFrame([("de", False, 9, 2), ("en", False, 9, 0)], "stratum string, pooled boolean, n long, level int"), fit)
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in grid.collect()}
    assert got["de", "symbols_per_word"] == 1.0 and got["de", "long_words"] is None and got["en", "symbols_per_word"] is None and len(got) == 10
    empty = rules.filter_quality(df.limit(0).withColumn("_level", F.lit(1)), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert empty.count() == 0


# Chat


def test_events_fold(spark):
    e = [
        (1, 1, 1, "message", "user", "Hi <|end|> \\"), (1, 2, 2, "message", "assistant", "He"), (1, 3, 2, "delta", None, "llo"), (1, 4, 3, "message", "user", "old"), (1, 5, 3, "edit", None, "new"),
        (1, 6, 4, "message", "assistant", "x"), (1, 7, 4, "regenerate", "assistant", "y"), (1, 8, 4, "delta", None, "!"), (1, 9, 5, "message", "user", "gone"), (1, 10, 5, "delete", None, None),
        (2, 1, 1, None, None, None), (3, 1, 1, "message", "assistant", "</s>[INST] ok [/INST]"), (3, 1, 2, "unknown", "user", "?"),
    ]
    df = spark.createDataFrame([(*x, "n") for x in e], "conv_id long, seq long, msg long, kind string, role string, text string, n string")
    final = sorted((r["conv_id"], r["n"], r["role"], r["text"]) for r in chat.messages(df).where("conv_id = 1").collect())
    assert final == [(1, 0, "user", "Hi <|end|> \\"), (1, 1, "assistant", "Hello"), (1, 2, "user", "new"), (1, 3, "assistant", "y!")]
    out = chat.render(chat.messages(df)).withColumns({"turns": chat.parse(F.col("formatted")), "learned": chat.learned(F.col("formatted"), F.col("loss"))})
    rows = {r["conv_id"]: r for r in out.collect()}
    assert [tuple(t) for t in rows[1]["turns"]] == [(r, t) for _, _, r, t in final] and rows[1]["learned"] == "Helloy!"
    assert rows[3]["learned"] == "</s>[INST] ok [/INST]" and [tuple(t) for t in rows[2]["turns"]] == [("", "")]
    assert chat.render(chat.messages(df.limit(0))).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def test_log_folds_into_turns(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "hé 👍x"), (1, 2, "assistant", "yes"), (1, 3, "assistant", None), (2, 0, None, ""), (2, None, "user", "a"), (2, 5, "assistant", "<|end|>")]
    events = chat.as_events(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert {r["kind"] for r in events.collect()} == {"message", "delta", "edit", "regenerate"}
    final = sorted((r["conv_id"], r["n"], r["role"], r["text"]) for r in chat.messages(events).collect())
    assert final == [(1, 0, "system", "be kind"), (1, 1, "user", "hé 👍x"), (1, 2, "assistant", "yes"), (1, 3, "assistant", ""), (2, 0, "user", "a"), (2, 1, None, ""), (2, 2, "assistant", "<|end|>")] or final[4:] == [
        (2, 0, "user", "a"), (2, 1, None, ""), (2, 2, "assistant", "<|end|>"),
    ]


# Decontamination


def test_winnow_keeps_every_span():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 30, 400).astype(np.uint64)
    for width in (1, 3, 6):
        kept = set(decontam.winnow(g, width).tolist())
        assert all(kept & set(range(i, i + width)) for i in range(len(g) - width + 1))


def test_marks_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 10, 15, 30])))) for i in range(15)] + [(50, None), (51, "!!"), (52, "W1"), (None, "w2 w3 w4 w5 w6 w7 w8")]
    docs = [(i, rng.choice([" ", ", ", "-"]).join(rng.choices(vocabulary, k=rng.randint(0, 40)) + (items[rng.randrange(15)][1].upper().split() if i % 3 == 0 else []) + rng.choices(vocabulary, k=9))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "q " * 40_000), (103, docs[3][1])]
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    df = spark.createDataFrame([(i, t, "h") for i, t in docs], "doc_id long, text string, hits string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontam.mark(df, bench).collect()}
    for i, t in docs:
        w, hit, found = find(t), set(), set()
        for item, text in items:
            x = find(text)
            for a in range(len(x) - min(10, len(x)) + 1 if x else 0):
                n = min(10, len(x))
                for b in range(len(w) - n + 1):
                    if w[b] == x[a] and w[b : b + n] == x[a : a + n]:
                        hit |= set(range(b, b + n))
                        found |= {str(item)} - {"None"}
        r = rows[i]
        assert (r["n_words"], {j for s in r["hits"] for j in range(s["start"], s["end"])}, r["items"]) == (len(w), hit, sorted(found))
    assert decontam.mark(df, bench.limit(0)).where("size(hits) > 0").count() == 0 and decontam.mark(df.limit(0), bench).count() == 0


def test_clean_keeps_all_columns(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, f"x {item.upper()} y", 77, "k"), (1, f"x {item.upper()} y", 78, "k"), (2, item[4:], 79, None), (3, None, 80, None), (None, "", 81, "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words long, _key string")
    bench = spark.createDataFrame([("a", item), ("a", item), ("b", "zz")], "item_id string, text string")
    assert sorted(map(tuple, decontam.clean(df, bench).collect()), key=str) == sorted(docs[2:], key=str)
    marked = {r["_key"]: r for r in decontam.mark(df, bench).where("doc_id = 1").collect()}
    assert [tuple(h) for h in marked["k"]["hits"]] == [(1, 11)] and marked["k"]["n_words"] == 12 and marked["k"]["items"] == ["a"]


def test_large_benchmark(spark):
    rng = np.random.default_rng(6)
    words = np.array([f"{a}{b}" for a in "abcdefghij" for b in range(100_000)])
    items = [(i, " ".join(rng.choice(words, 200))) for i in range(4200)]  # over 5 MB
    assert sum(len(t) for _, t in items) > 5 << 20
    docs = [(i, " ".join(rng.choice(words, 30)) + (" " + " ".join(items[i][1].split()[50:60]) if i % 2 else "")) for i in range(200)]
    rows = decontam.mark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all((r["items"], [tuple(h) for h in r["hits"]]) == (([str(r["doc_id"])], [(30, 40)]) if r["doc_id"] % 2 else ([], [])) for r in rows) and len(rows) == 200


# Classifier


def test_classifier_on_held_out_rows(spark):
    from tests.conftest import SF

    rows = quality.query(spark, SF.replace("sf0.001", "sf0.01")).join(spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 80 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.93 * len(rows)


def test_classifier_edges(spark):
    good, bad = "the river runs past old quiet fields and hills ", "$$$ WIN!!! c1ick n0w >>> "
    docs = [(i, (good if i % 2 else bad) * (1 + i % 5), "s") for i in range(200)] + [(500, None, "s"), (501, "", "s"), (502, good * 5000, "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, None), (9999, 1), (7, 5)], "doc_id long, quality int")
    scored = {r["doc_id"]: r["score"] for r in quality.classify(df, *quality.train(df, labels)).collect()}
    assert all(0 <= s <= 1 for s in scored.values()) and all((scored[i] >= 0.5) == bool(i % 2) for i in range(200))
    none = quality.classify(df, *quality.train(df, labels.limit(0)))
    assert {r["score"] for r in none.collect()} == {0.5} and quality.classify(df.limit(0), *quality.train(df, labels)).count() == 0


def test_digest_of_repeated_runs(spark):
    from tests.conftest import SF

    digest = lambda: hashlib.sha256(str(sorted(map(tuple, quality.query(spark, SF).collect()))).encode()).hexdigest()
    assert digest() == digest()


def test_context_sums_against_plain_code(spark):
    rng, words = random.Random(8), [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(60)] + [None, "", "w1"]
    got = {}
    for r in quality.context_vectors(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect():
        hashes, sums = quality.unpack(r["hashes"], np.uint64, ordered=True), quality.unpack(r["sums"], np.int32)
        got |= dict(zip(hashes.view(np.int64).tolist(), sums.reshape(-1, quality.DIM).tolist()))
    from larkspur.llm.text import Words
    import pyarrow as pa

    hashes = Words(pa.array(words)).hash
    own = dict(zip(words, quality.index_vectors(quality._feature("word", hashes))))
    want = {w: np.zeros(quality.DIM) for t in texts for w in (t or "").split()}
    for t in texts:
        w = (t or "").split()
        for i in range(len(w)):
            for j in range(max(0, i - quality.NEIGHBOURS), min(len(w), i + quality.NEIGHBOURS + 1)):
                if i != j:
                    want[w[i]] += own[w[j]]
    number = dict(zip(words, hashes.view(np.int64).tolist()))
    assert {number[w]: x.tolist() for w, x in want.items()} == got


def test_slices_of_context_vectors_score_alike(spark):
    docs = [(i, f"the {'river' if i % 2 else 'WIN'} runs {i} past fields " * (i % 7), "s") for i in range(120)] + [(500, None, "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, _sums string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    contexts, network = quality.train(df, labels)
    sample = quality.materialize(quality.sample_of(df, labels))
    several = quality.learn_context(sample, slice_words=25)
    assert len(several.slices) > 2 and sum(len(several.load(k).hashes) for k in range(len(several.slices))) == len(contexts.load(0).hashes)
    a, b = ({r["doc_id"]: r["score"] for r in quality.classify(df, c, network).collect()} for c in (contexts, several))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-4 for i in a)
