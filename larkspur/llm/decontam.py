"""Benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of every sliding window. Windows of
`span` words equal in a text and an item hold the same `span - k + 1` k-grams,
so they keep the same one: a join of the kept fingerprints misses no shared span
of `span` words. Around each hit the windows that could hold it are written out
and joined with the items' windows, word by word. Items of fewer than `span`
words, one window each, keep the smallest k-gram of the whole item (k no larger
than the item).

A text is known by its digest, so equal texts are one. The items' fingerprints
and windows are written tables; Spark broadcasts them only if their size allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.frames import bound_batches, materialize, unused
from larkspur.llm.text import NOT_ALNUM, Words, grams, release, whole

SPAN, K = 10, 5
#: Rows of texts that one Python call handles.
ROWS = 500
_TO_BLANK = bytes(0x20 if NOT_ALNUM[b] and not 0x41 <= b <= 0x5A else b + 32 * (0x41 <= b <= 0x5A) for b in range(256))


def winnow(g: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest hash (the last of equal ones) of every window of `width` k-grams, ascending."""
    n = len(g) - width + 1
    if n < 1:
        return np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, width):
        here = g[j : j + n]
        less = here <= best
        best[less], at[less] = here[less], np.flatnonzero(less) + j
    return at[np.diff(at, prepend=-1) != 0]  # they only rise


def kept(words: Words, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(words' places, hashes) of the fingerprints that windows of `size` words keep, of all rows."""
    k = min(k, size)
    g = grams(words.hash, k)
    at = winnow(g, size - k + 1)  # over row borders too: that only adds places, of which those across a border go
    at = at[whole(words, k)[at]]
    return at, g[at]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _words(column) -> Words:
    return Words(column, lower=True, between=NOT_ALNUM)


def item_prints(items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """(size, print): the distinct fingerprints of items (text), by the length of their windows."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            words = _words(b.column("text"))
            row = words.rows()
            for size in range(1, span + 1):
                mine = words.counts >= span if size == span else words.counts == size
                if mine.any():
                    at, g = kept(words, size, k)
                    g = np.unique(g[mine[row[at]]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), size, np.int32)), pa.array(g.view(np.int64))], ["size", "print"])

    return bound_batches(items).select("text").mapInArrow(prints, "size int, print long").distinct()


def item_windows(items: DataFrame, span: int = SPAN) -> DataFrame:
    """(item, size, window), each once: the windows of items (item_id, text), lower-cased words joined by a space; item is the id as text."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 50):
            ids, sizes, found = [], [], []
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                words = (text or "").encode().translate(_TO_BLANK).split()
                size = min(span, len(words))
                for i in range(len(words) - size + 1 if size else 0):
                    ids.append(item)
                    sizes.append(size)
                    found.append(b" ".join(words[i : i + size]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(sizes, pa.int32()), pa.array(found, pa.binary()).cast(pa.string())], ["item", "size", "window"])

    source = bound_batches(items).select(F.col("item_id").cast("string").alias("item"), "text")
    return source.mapInArrow(windows, "item string, size int, window string").distinct()


def text_prints(texts: DataFrame, sizes: list[int], k: int = K) -> DataFrame:
    """(key, size, print, at): the fingerprints of texts (key, text) for windows of each size; at: the place in words."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            words = _words(b.column("text"))
            row = words.rows()
            for size in sizes:
                at, g = kept(words, size, k)
                r = row[at]
                arrays = [b.column("key").take(pa.array(r)), pa.array(np.full(len(at), size, np.int32)), pa.array(g.view(np.int64)), pa.array((at - words.bounds[r]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "size", "print", "at"])
        release()

    return bound_batches(texts).select("key", "text").mapInArrow(prints, "key binary, size int, print long, at int")


def windows_around(texts: DataFrame, k: int = K) -> DataFrame:
    """(key, start, size, window): the windows of texts (key, text, places) that could keep a fingerprint at one of the places (size, at)."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 50):
            rows, starts, sizes, found = [], [], [], []
            for i, (text, places) in enumerate(zip(b.column("text").to_pylist(), b.column("places").to_pylist())):
                words = text.encode().translate(_TO_BLANK).split()
                around = {(s, p["size"]) for p in places for s in range(max(0, p["at"] - p["size"] + min(k, p["size"])), min(p["at"], len(words) - p["size"]) + 1)}
                for start, size in around:
                    rows.append(i)
                    starts.append(start)
                    sizes.append(size)
                    found.append(b" ".join(words[start : start + size]))
            arrays = [b.column("key").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(found, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "start", "size", "window"])

    return bound_batches(texts).select("key", "text", "places").mapInArrow(windows, "key binary, start int, size int, window string")


def with_counts(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs with the number of words of their texts."""
    names = docs.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            n = Words(b.column(text), between=NOT_ALNUM, hashed=False).counts
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n.astype(np.int64))], [*names, name])
        release()

    return bound_batches(docs).mapInArrow(count, "".join(f"`{c}` {t}, " for c, t in docs.dtypes) + f"`{name}` long")


def key_of(text: str) -> Column:
    """The digest by which a text is known; null is the empty text."""
    return F.unhex(F.sha1(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def occurrences(docs: DataFrame, items: DataFrame, text: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """(key, hits, items), written: each text of docs, by key_of, in which windows of items occur.

    hits: array of (start, end) in words, disjoint and ascending; items: sorted
    strings. docs should be a written table, as its texts are read twice. Places
    and hits grow with the documents, so texts meet them by merge joins at every
    size; only the items' tables may be broadcast.
    """
    items = items.select("item_id", "text").where("length(text) > 0").distinct()
    prints, windows = materialize(item_prints(items, span, k)), materialize(item_windows(items, span))
    sizes = [r["size"] for r in prints.select("size").distinct().collect()]  # span at most
    texts = docs.select(key_of(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    places = text_prints(texts, sorted(sizes), k).join(prints, ["size", "print"], "left_semi").groupBy("key").agg(F.collect_set(F.struct("size", "at")).alias("places"))
    around = windows_around(texts.join(materialize(places).hint("merge"), "key"), k)
    found = materialize(around.join(windows.select("size", "window").distinct(), ["size", "window"], "left_semi").distinct())
    end = F.col("start") + F.col("size")
    ordered = Window.partitionBy("key").orderBy("start", "size")  # the hits of one text
    new = F.col("start") > F.coalesce(F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    islands = found.select("key", "start", end.alias("end"), F.sum(new.cast("int")).over(ordered).alias("island"))
    hits = islands.groupBy("key", "island").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"))
    hits = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hits"))
    ids = found.select("key", "size", "window").distinct().join(windows.where("item is not null"), ["size", "window"]).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return materialize(hits.join(ids, "key", "left"))


def mark(docs: DataFrame, items: DataFrame, text: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """docs with n_words, hits (array of (start, end) in words, disjoint and ascending) and items (sorted strings).

    items: (item_id, text). Null or empty texts have no words and no hits; texts
    are read whole; equal texts and repeated rows are marked alike; empty tables
    on either side give no hits; hits of a null item_id are marked but not
    listed; columns of docs named n_words, hits or items are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_words", "hits", "items")]
    key = unused("_key", *names)
    found = occurrences(docs, items, text, span, k).withColumnRenamed("key", key)
    out = with_counts(docs.select(*names), text, "n_words").withColumn(key, key_of(text)).join(found.hint("merge"), key, "left")
    empty = F.array().cast(dict(found.dtypes)["hits"])
    return out.select(*names, "n_words", F.coalesce("hits", empty).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """The rows of docs without a hit, as mark has them, with all their columns."""
    key = unused("_key", *docs.columns)
    found = occurrences(docs, items, text, span, k).select(F.col("key").alias(key))
    return docs.withColumn(key, key_of(text)).join(found.hint("merge"), key, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that lie in occurrences of benchmark windows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    marked = mark(docs, items)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return marked.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""WITH item_words AS (
  SELECT DISTINCT item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM item_words, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), doc_windows AS (
  SELECT rid, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM docs, (SELECT DISTINCT size FROM item_windows) s, unnest(range(1, len(w) - size + 2)) AS u(i)
), hits AS (SELECT rid, i, d.size, item_id FROM doc_windows d JOIN item_windows t ON t.win = d.win AND t.size = d.size
), words AS (SELECT rid, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + size)) AS u(j) GROUP BY rid
), listed AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits WHERE item_id IS NOT NULL GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN listed USING (rid)"""
