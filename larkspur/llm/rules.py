"""Quality rules whose cutoffs come with a risk guarantee.

Each rule compares one statistic of a document with a cutoff. The rules are
tightened together, along one path of LEVELS levels from lax to strict, which
ends at cutoffs usual in published corpora. In each stratum the levels are
tried in order; one passes if the exact (Clopper-Pearson) upper bound on the share
of good documents that the rules reject at it, from labelled ones, is at most
`risk`; the last before the first failure holds. Testing in a fixed order needs
no correction within a stratum; over strata the error level is divided
(Bonferroni). So with probability 1 - error no stratum loses more than `risk` of
its good documents.

A stratum with so few good labels that no level could pass, even without a
rejection, shares one pooled stratum with all others like it; the guarantee then
holds for these together. A stratum without good labels rejects by the base
rules only, and so does the pooled one if its labels are still too few.

A rule that would reject, at its laxest, more than half of a stratum's documents
does not fit it (as word lengths where words aren't set apart) and takes no part
there. Documents decide that, not labels, so the guarantee stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.frames import bound_batches, materialize, unused
from larkspur.llm.text import Words, grams, whole

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RISK, ERROR = 0.02, 0.05
LEVELS = 10

#: Rule: the statistic, which rejects above its cutoff, and its cutoff at each level.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols_per_word": ("n_symbols / n_words", [2.0, 1.0, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "duplicate_lines": ("n_dup_lines / n_lines", [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.32, 0.3]),
    "repeated_words": ("n_repeat_words / n_words", [0.195, 0.19, 0.185, 0.18, 0.175, 0.17, 0.165, 0.16, 0.155, 0.15]),
    "long_words": ("word_chars / n_words", [20.0, 18.0, 16.0, 15.0, 14.0, 13.0, 12.0, 11.0, 10.5, 10.0]),
    "short_words": ("-word_chars / n_words", [-1.0, -1.5, -1.75, -2.0, -2.25, -2.5, -2.6, -2.75, -2.9, -3.0]),
}


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials with chance p."""
    if k >= n:
        return 1.0
    return min(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1)))


def safe(k: int, n: int, risk: float, error: float) -> bool:
    """Whether the exact upper bound, at level 1 - error, on a rate seen as k of n is at most risk."""
    return n > 0 and binomial_cdf(k, n, risk) <= error


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """`keep` columns with COUNTS and n_lines (lines with a word), of whole texts; null texts are empty, repeated rows stay; an empty table gives none. `keep` may not name a count."""
    names, own = [*keep, *COUNTS, "n_lines"], unused("_text", *keep)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                column = b.column(own)
                w = Words(column)
                repeat = np.zeros(w.n, bool)
                g = (grams(w.hash, WINDOW) + np.uint64(0x9E3779B97F4A7C15) * w.rows()[: max(0, w.n - WINDOW + 1)].astype(np.uint64))[ok := whole(w, WINDOW)]
                if len(g):
                    _, inverse, n = np.unique(g, return_inverse=True, return_counts=True)
                    twice = np.flatnonzero(ok)[n[inverse] > 1]
                    for j in range(WINDOW):
                        repeat[twice + j] = True
                sums = np.concatenate([[0], np.cumsum(repeat)])
                counts = {k: np.zeros(b.num_rows, np.int64) for k in (*COUNTS, "n_lines")}
                counts["n_words"], counts["n_repeat_words"] = w.counts, sums[w.bounds[1:]] - sums[w.bounds[:-1]]
                for i, t in enumerate(column.to_pylist()):
                    if t:
                        counts["word_chars"][i] = len(t) - sum(map(t.count, BLANKS))
                        counts["n_symbols"][i] = sum(map(t.count, SYMBOLS))
                        lines = [x for x in t.split("\n") if x.strip(BLANKS)]
                        counts["n_lines"][i], counts["n_dup_lines"][i] = len(lines), len(lines) - len(set(lines))
                yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + [pa.array(counts[k].astype(np.int64)) for k in (*COUNTS, "n_lines")], names)

    kinds = dict(docs.dtypes)
    source = bound_batches(docs).select(*keep, F.col(text).alias(own))
    return source.mapInArrow(stats, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + "".join(f", {k} long" for k in (*COUNTS, "n_lines")))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def statistic(rule: str) -> Column:
    """The rule's statistic; 0 where its divisor is 0."""
    above, below = RULES[rule][0].split(" / ")
    return F.when(F.col(below) > 0, (-F.col(above[1:]) if above[0] == "-" else F.col(above)) / F.col(below)).otherwise(0.0)


def fitting(measured: DataFrame) -> DataFrame:
    """(stratum, fits): which of RULES take part in a stratum of measured documents, by those that the base rules don't fail."""
    lax = [2 * F.sum((statistic(r) > grid[0]).cast("long")) <= F.count(F.lit(1)) for r, (_, grid) in RULES.items()]
    return measured.where(~base_failed()).groupBy("stratum").agg(F.array(*lax).alias("fits"))


def with_first(measured: DataFrame, fits: DataFrame, first: str = "first") -> DataFrame:
    """measured with `first`, the laxest level at which a rule that takes part rejects, from 1; LEVELS + 1: none does."""
    own = unused("_fits", *measured.columns)

    def passed(rule: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, RULES[rule][1])), lambda c: statistic(rule) <= c))

    each = [F.when(F.col(own)[i], passed(r)).otherwise(LEVELS) for i, r in enumerate(RULES)]
    return measured.join(fits.withColumnRenamed("fits", own), "stratum", "left").withColumn(first, 1 + F.least(*each)).drop(own)


def levels(good: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, pooled, n, level) from good documents (stratum, first), as with_first has them; level 0 rejects nothing, n are the labels it rests on.

    Counts by stratum and level are summed before they meet.
    """
    counts = good.groupBy("stratum", "first").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(counts.groupBy("stratum").agg(F.sum("n").alias("_size")))
    share = error / max(1, sizes.count())  # of each test: there is one for a stratum at most
    pools = sizes.select("stratum", (F.pow(F.lit(1 - risk), F.col("_size")) > share).alias("pooled"))
    key = F.when(~F.col("pooled"), F.col("stratum"))
    by_level = counts.join(pools, "stratum").groupBy(key.alias("_key"), "pooled", "first").agg(F.sum("n").alias("n"))

    def choose(key, table):
        n_at, level, k = dict(zip(table["first"].to_pylist(), table["n"].to_pylist())), 0, 0
        n = sum(n_at.values())
        for i in range(1, LEVELS + 1):
            k += n_at.get(i, 0)
            if not safe(k, n, risk, share):
                break
            level = i
        return pa.table({"_key": pa.array([key[0].as_py()], pa.string()), "pooled": [key[1].as_py()], "n": pa.array([n], pa.int64()), "level": pa.array([level], pa.int32())})

    chosen = by_level.groupBy("_key", "pooled").applyInArrow(choose, "_key string, pooled boolean, n long, level int")
    own = pools.select("stratum", "pooled", key.alias("_own"))
    return own.join(chosen.drop("pooled"), F.col("_own").eqNullSafe(F.col("_key"))).select("stratum", "pooled", "n", "level")


def cutoffs(chosen: DataFrame, fits: DataFrame) -> DataFrame:
    """(stratum, pooled, n, level, rule, cutoff) of chosen levels; a null cutoff rejects nothing."""
    grids = F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*[F.array(*map(F.lit, grid)) for _, grid in RULES.values()]))
    rows = chosen.join(fits, "stratum").select(*chosen.columns, "fits", F.posexplode(F.map_entries(grids)).alias("_i", "_x"))
    active = F.when((F.col("level") > 0) & F.get("fits", F.col("_i")), F.col("level"))
    return rows.select(*chosen.columns, F.col("_x.key").alias("rule"), F.try_element_at("_x.value", active).alias("cutoff"))


def judge(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """measured (with stratum and first) with base_failed and kept; strata without a level reject by the base rules only.

    An empty table stays empty; columns named base_failed or kept are replaced.
    """
    level = unused("_level", *measured.columns)
    out = measured.join(chosen.select("stratum", F.col("level").alias(level)), "stratum", "left")
    passes = F.col("first") > F.coalesce(F.col(level), F.lit(0))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & passes).drop(level)


def filter_quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(doc_id, stratum, COUNTS, n_lines, base_failed, kept) of docs (doc_id, text, stratum), levels from labels (doc_id, quality).

    Good: labelled 1 and not failed by the base rules. A null stratum is one of
    its own; null labels and labels without a document count for nothing; a
    document with several labels counts as good if all of them are 1. Repeated
    rows stay, and each counts; null and empty texts have no words and fail the
    base rules; long texts are read whole; an empty table gives an empty result;
    other columns are dropped.
    """
    by_stratum = docs.select("doc_id", "text", F.coalesce(F.col(stratum).cast("string"), F.lit("(null)")).alias("stratum"))
    measured = materialize(measure(by_stratum, keep=("doc_id", "stratum")))  # texts are read once; counts, not texts, meet the labels
    good = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality")).where("_quality = 1").select("doc_id")
    measured = with_first(measured, materialize(fitting(measured)))
    labelled = measured.join(good, "doc_id", "left_semi")
    return judge(measured, materialize(levels(labelled.where(~base_failed()), risk, error))).drop("first")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document, with levels by language from all labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return filter_quality(docs, labels).select("doc_id", *COUNTS, "base_failed", "kept")


def _value_sql(rule: str) -> str:
    above, below = RULES[rule][0].split(" / ")
    return f"coalesce({above} / nullif({below}, 0), 0)"


_FITS_SQL = ", ".join(f"2 * count(*) FILTER (WHERE {_value_sql(r)} > {grid[0]}) <= count(*) AS fits_{r}" for r, (_, grid) in RULES.items())
_FIRST_SQL = "1 + least(" + ", ".join(f"CASE WHEN fits_{r} THEN len(list_filter({grid}, lambda c: {_value_sql(r)} <= c)) ELSE {LEVELS} END" for r, (_, grid) in RULES.items()) + ")"

ORACLE_SQL = rf"""WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '(null)') AS stratum, coalesce(text, '') AS t,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n
  FROM (SELECT rid, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS win FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i))
), repeated AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM windows, unnest(range(i, i + {WINDOW})) AS u(j) WHERE n > 1 GROUP BY rid
), m AS (
  SELECT rid, doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN repeated USING (rid)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), fitting AS (SELECT stratum, {_FITS_SQL} FROM b WHERE NOT base_failed GROUP BY stratum
), f AS (SELECT *, {_FIRST_SQL} AS first FROM b LEFT JOIN fitting USING (stratum)
), good AS (
  SELECT stratum, first FROM f WHERE NOT base_failed
    AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)
), sizes AS (SELECT stratum, count(*) AS size FROM good GROUP BY stratum
), pools AS (SELECT stratum, CASE WHEN pow(1 - {RISK}, size) > {ERROR} / (SELECT count(*) FROM sizes) THEN '(pooled)' ELSE '=' || stratum END AS pool FROM sizes
), tries AS (
  SELECT pool, level, count(*) FILTER (WHERE first <= level) AS k, count(*) AS n FROM good JOIN pools USING (stratum), range(1, {LEVELS + 1}) AS r(level) GROUP BY pool, level
), bounds AS (
  SELECT *, k < n AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END - CASE WHEN i < n THEN lgamma(n - i + 1) ELSE 0 END
    + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) <= {ERROR} / (SELECT count(*) FROM sizes) AS safe FROM tries
), chosen AS (SELECT pool, coalesce(min(level) FILTER (WHERE NOT safe) - 1, {LEVELS}) AS level FROM bounds GROUP BY pool)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND first > coalesce(level, 0) AS kept
FROM f LEFT JOIN pools USING (stratum) LEFT JOIN chosen USING (pool)"""
