import collections
import re

from tests.conftest import SF

import corpus_pipeline as pipeline
from larkspur.llm import packing
from tests.llm.test_neardup import brute as near
from tests.llm.test_substrings import WORDS
from tests.llm.test_substrings import brute as repeats


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = kept["quality"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(i in good for i, q in labels.items() if q) >= 0.97 * sum(labels.values())
    assert sorted(kept["near_duplicates"]) == [i for i, _, _, keep in near(list(good.items()), 5) if keep]
    cut = kept["substrings"]
    assert sorted((i, " ".join(WORDS.findall(t))) for i, t in cut.items()) == sorted((r[0], r[3]) for r in repeats(list(kept["near_duplicates"].items()), 20))
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = find(r["text"])
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[n].add(tuple(w[i : i + n]))
    clean = [i for i, t in cut.items() if not any(tuple(w[a : a + n]) in found for w in [find(t)] for n, found in windows.items() for a in range(len(w) - n + 1))]
    assert sorted(kept["decontamination"]) == sorted(clean)
    rows = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r["sequence_id"]] += r["length"]
    assert {r["doc_id"] for r in rows} == set(clean) and max(sizes.values()) <= packing.SIZE
    assert len(rows) == pipeline.run(spark, SF).count()


def test_stages_keep_the_columns_of_the_user(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).selectExpr("*", "77 AS n_words", "'mine' AS score", "1 AS hits", "'i' AS items", "2 AS removed", "'k' AS kept_text", "3 AS _text", "4 AS _key")
    docs = spark.createDataFrame([*docs.collect(), (9001, None, "en", None, None, *docs.first()[5:]), (9001, "", None, "s", 0, *docs.first()[5:])], docs.schema)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {tuple(r[5:]) for r in out.collect()} == {(77, "mine", 1, "i", 2, "k", 3, 4)}
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
