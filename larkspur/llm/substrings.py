"""Substring deduplication over a log-structured index of window hashes.

A window is `span` consecutive words of a document. Each block of documents
makes a sorted run of its window hashes, cut into ranges (shards). In a shard
the new blocks' runs, on short keys, are merge-joined with each other and with
the history's; blocks learn which of their keys another run has and answer with
these and a second, independent hash of the same words, which decide which
occurrence came first. All others are removed.

An index on disk is a list of immutable runs of keys and second hashes, sorted
within a block and shard, later within a shard; a batch is checked against them
and adds one run, and small runs are compacted into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.frames import block_bytes_of, each_block, freed_shuffles, materialize, scratch, shard_count, text_blocks, unused, values
from larkspur.llm.text import Words, cuts, distinct, grams, pack, release, unpack, whole

SPAN = 20
#: Text bytes whose windows one shard has.
SHARD_BYTES = 16 << 20
#: Bits of a window's hash that runs are merged on, and of the second hash, of other random numbers, that confirms.
KEY_BITS, CHECK_BITS = 40, 40
SHORT = np.uint64(64 - KEY_BITS)
_LAST = np.iinfo(np.int64).max
_RUN_DDL = "shard int, block long, keys binary, checks binary"


class _Windows:
    """The windows of a block: where they begin, and their keys, KEY_BITS of a hash."""

    def __init__(self, texts, span: int):
        self.texts, self.span, self.second = texts, span, None
        self.words = Words(texts)
        self.at = np.flatnonzero(whole(self.words, span))
        self.keys = grams(self.words.hash, span)[self.at] >> SHORT if len(self.at) else np.zeros(0, np.uint64)
        self.words.hash = None  # of no more use

    def checks(self, which: np.ndarray | None = None) -> np.ndarray:
        """The second hash of the given windows, or of all."""
        if which is not None and not len(which):
            return np.zeros(0, np.uint64)
        if self.second is None:
            self.second = grams(Words(self.texts, seed=2).hash, self.span, seed=2)
        return self.second[self.at if which is None else self.at[which]] >> np.uint64(64 - CHECK_BITS)

    def rows(self) -> np.ndarray:
        return np.searchsorted(self.words.bounds, self.at, "right") - 1


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """The doc_ids of a block; null comes last."""
    ids = batch.column("rows")[0].values.field("doc_id")
    return ids.cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def _ordered(keys: np.ndarray) -> bytes:
    return pack(keys, ordered=True)


def _cut(keys: np.ndarray, shards: int) -> np.ndarray:
    return cuts(keys << SHORT, shards)


def _runs(blocks: DataFrame, shards: int, span: int, checks: bool) -> DataFrame:
    """_RUN_DDL: each block's run, sorted and distinct, cut into shards; with the second hashes if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in each_block(batches):
            w = _Windows(texts, span)
            if checks:
                keys, second = _pairs(w)
            else:
                keys = distinct(w.keys)
            del w
            at = _cut(keys, shards)
            filled = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(filled, pa.int32()), pa.array([b.column("block")[0].as_py()] * len(filled), pa.int64()), pa.array([_ordered(keys[at[s] : at[s + 1]]) for s in filled], pa.binary()),
                    pa.array([pack(second[at[s] : at[s + 1]]) if checks else None for s in filled], pa.binary()),
                ],
                ["shard", "block", "keys", "checks"],
            )
        release()

    return blocks.select("block", "rows", "sizes", "data").mapInArrow(run, _RUN_DDL)


def _pairs(w: _Windows) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a block's windows in order, and their second hashes; a pair may be there twice only beside another of its key."""
    order = np.argsort(w.keys, kind="stable")
    h = w.keys[order]
    c = w.checks()[order]
    del order
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    return h[new], c[new]


def _recut(history: DataFrame, shards: int) -> DataFrame:
    """Runs of an index, cut into so many shards, as blocks of number -1."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, checks = unpack(b.column("keys")[i].as_py(), np.uint64, ordered=True), unpack(b.column("checks")[i].as_py(), np.uint64)
                at = _cut(keys, shards)
                filled = np.flatnonzero(np.diff(at))
                arrays = [pa.array([f(x[at[s] : at[s + 1]]) for s in filled], pa.binary()) for f, x in ((_ordered, keys), (pack, checks))]
                yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([-1] * len(filled), pa.int64()), *arrays], ["shard", "block", "keys", "checks"])

    return history.mapInArrow(cut, _RUN_DDL)


def _merge_join(runs: DataFrame) -> DataFrame:
    """(block, shard, found, checks): the places, in a block's part of a shard, of keys that another run has.

    Of the history (block -1) the entries themselves that some block's keys hit: found has the keys.
    """

    def merge(key, table):
        blocks = table["block"].to_pylist()
        parts = [unpack(x.as_py(), np.uint64, ordered=True) for x in table["keys"]]
        keys = np.concatenate(parts)
        begin = np.cumsum([0, *map(len, parts)])
        order = np.argsort(keys, kind="stable")  # merges the runs, which are sorted
        keys = keys[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        del keys
        group = np.flatnonzero(first)
        size = np.diff(np.append(group, len(first)))
        fresh = np.logical_or.reduceat(np.repeat(np.array(blocks) >= 0, np.diff(begin))[order], group)  # keys that a new block has
        hit = np.zeros(len(first), bool)
        hit[order] = np.repeat((size > 1) & fresh, size)
        del order, group, size
        out = [i for i in range(len(blocks)) if hit[begin[i] : begin[i + 1]].any()]
        found, checks = [], []
        for i in out:
            places = np.flatnonzero(hit[begin[i] : begin[i + 1]])
            if blocks[i] >= 0:
                found.append(pack(places.astype(np.uint32), ordered=True))
                checks.append(None)
            else:
                found.append(_ordered(parts[i][places]))
                checks.append(pack(unpack(table["checks"][i].as_py(), np.uint64)[places]))
        return pa.table({"block": pa.array([blocks[i] for i in out], pa.int64()), "shard": pa.array([key[0].as_py()] * len(out), pa.int32()), "found": pa.array(found, pa.binary()), "checks": pa.array(checks, pa.binary())})

    return runs.groupBy("shard").applyInArrow(merge, "block long, shard int, found binary, checks binary")


def _by_block(blocks: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """blocks with what was found for them, a list of at most one row a shard."""
    return blocks.join(found.groupBy("block").agg(F.collect_list(F.struct("shard", "found")).alias("found")), "block", how)


def _found(batch: pa.RecordBatch, dtype, ordered: bool) -> dict[int, np.ndarray]:
    return {x["shard"]: unpack(x["found"], dtype, ordered) for x in batch.column("found")[0].as_py() or ()}


def _candidates(w: _Windows, hits: dict[int, np.ndarray], shards: int) -> np.ndarray:
    """The windows whose key is among the hits."""
    keys = distinct(w.keys)
    at = _cut(keys, shards)
    hot = np.concatenate([np.zeros(0, np.uint64), *(keys[at[s] + hits[s]] for s in sorted(hits))])
    if not len(hot):
        return np.zeros(0, np.int64)
    return np.flatnonzero(hot[np.minimum(np.searchsorted(hot, w.keys), len(hot) - 1)] == w.keys)


def _entries(w: _Windows, which: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, check) of the given windows, sorted; the windows in that order, first occurrences first; where each entry begins; its first doc_id."""
    h, c = w.keys[which], w.checks(which)
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    rows = w.rows()[which]
    order = np.lexsort((which, rank[rows], c, h))
    h, c, rows = h[order], c[order], rows[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    begin = np.flatnonzero(new)
    return h[begin], c[begin], which[order], begin, ids[rows[begin]]


def _answers(blocks: DataFrame, hits: DataFrame, shards: int, span: int) -> DataFrame:
    """(shard, block, keys, checks, firsts): the key and second hash, and first doc_id, of each block's hits; the history's come before all."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in each_block(batches):
            w = _Windows(texts, span)
            h, c, _, _, first = _entries(w, _candidates(w, _found(b, np.uint32, True), shards), _ids(b))
            at = _cut(h, shards)
            filled = np.flatnonzero(np.diff(at))
            arrays = [pa.array([f(x[at[s] : at[s + 1]]) for s in filled], pa.binary()) for f, x in ((_ordered, h), (pack, c), (pack, first))]
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([b.column("block")[0].as_py()] * len(filled), pa.int64()), *arrays], ["shard", "block", "keys", "checks", "firsts"])

    own = _by_block(blocks, hits.where("block >= 0"), "inner").mapInArrow(answer, "shard int, block long, keys binary, checks binary, firsts binary")
    old = hits.where("block < 0").select("shard", "block", F.col("found").alias("keys"), "checks", F.lit(None).cast("binary").alias("firsts"))
    return own.unionByName(old)


def _verdicts(answers: DataFrame) -> DataFrame:
    """(block, shard, found): for each entry of a block in a shard, a bit that says whether its first occurrence is there."""

    def decide(key, table):
        blocks = table["block"].to_pylist()
        h = [unpack(x.as_py(), np.uint64, ordered=True) for x in table["keys"]]
        c = [unpack(x.as_py(), np.uint64) for x in table["checks"]]
        first = [unpack(x.as_py(), np.int64) if x.is_valid else np.full(len(k), np.iinfo(np.int64).min) for x, k in zip(table["firsts"], h)]
        begin = np.cumsum([0, *map(len, h)])
        of = np.repeat(np.array(blocks, np.int64), np.diff(begin))
        h, c, first = np.concatenate(h), np.concatenate(c), np.concatenate(first)
        order = np.lexsort((of, first, c, h))
        new = np.ones(len(order), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (c[order[1:]] != c[order[:-1]])
        mine = np.zeros(len(order), np.uint8)
        mine[order[new]] = 1
        out = [i for i, b in enumerate(blocks) if b >= 0]
        return pa.table({"block": pa.array([blocks[i] for i in out], pa.int64()), "shard": pa.array([key[0].as_py()] * len(out), pa.int32()), "found": pa.array([pack(mine[begin[i] : begin[i + 1]]) for i in out], pa.binary())})

    return answers.groupBy("shard").applyInArrow(decide, "block long, shard int, found binary")


def removals(w: _Windows, hits: dict, verdicts: dict, ids: np.ndarray, shards: int) -> np.ndarray:
    """Which words of the block lie in a window that also starts earlier, here or elsewhere."""
    elsewhere = _candidates(w, hits, shards)
    drop = np.zeros(len(w.keys), bool)
    if len(elsewhere):
        h, _, order, begin, _ = _entries(w, elsewhere, ids)
        mine = np.zeros(len(h), bool)
        at = _cut(h, shards)
        for s, bits in verdicts.items():
            mine[at[s] : at[s + 1]] = bits
        drop[order] = True
        drop[order[begin[mine]]] = False
    ordered = np.sort(w.keys)
    repeated = distinct(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(repeated):
        here = np.flatnonzero(repeated[np.minimum(np.searchsorted(repeated, w.keys), len(repeated) - 1)] == w.keys)
        _, _, order, begin, _ = _entries(w, here, ids)
        later = np.ones(len(order), bool)
        later[begin] = False
        drop[order[later]] = True
    change = np.zeros(w.words.n + 1, np.int32)
    starts = w.at[drop]
    np.add.at(change, starts, 1)
    np.add.at(change, starts + w.span, -1)
    return np.cumsum(change[:-1]) > 0


class FingerprintIndex:
    """Immutable runs of window hashes at a path that all executors share; without a path, nothing is kept.

    A run counts once a manifest names it, so a job that is lost leaves the index
    as it was; one job at a time may write. Beyond max_runs the smallest runs
    become one, and go. Disk holds the present runs and what one job needs: a
    batch's run is written when its exchanges are over, whose files go with them.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, span: int = SPAN, max_runs: int = 8):
        self.spark, self.path, self.span, self.max_runs = spark, path, span, max_runs

    def _file(self, name: str):
        """The path of a file of the index, and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[int, list[tuple[str, int]]]:
        """The version and the runs (name, text bytes) of the last manifest that was written whole."""
        if not self.path:
            return 0, []
        path, files = self._file("manifests")
        if not files.exists(path):
            return 0, []
        rows = self.spark.read.schema("version long, runs array<struct<name: string, size: long>>").parquet(f"{self.path}/manifests")
        last = rows.agg(F.max_by(F.struct("version", "runs"), "version").alias("m")).first()["m"]
        return (last["version"], [tuple(r) for r in last["runs"]]) if last else (0, [])

    def runs(self) -> list[str]:
        """The names of the present runs."""
        return [name for name, _ in self._manifest()[1]]

    def _publish(self, runs: list[tuple[str, int]]) -> None:
        version = self._manifest()[0] + 1
        rows = values(self.spark, runs, "name string, size bigint").agg(F.collect_list(F.struct("name", "size")).alias("runs"))
        rows.select(F.lit(version).cast("long").alias("version"), "runs").coalesce(1).write.mode("append").parquet(f"{self.path}/manifests")

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(_RUN_DDL).parquet(*[f"{self.path}/runs/{n}" for n in names])

    def ingest(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs with n_words, n_removed, kept_text and removed (array of (start, end) in words), against the history and each other.

        A window that history has, or that starts earlier in docs (by doc_id, an
        integer, null last; equal ids in any fixed order), is removed: all words
        in it. Null and empty texts have no words; texts are read whole; repeated
        rows are documents of their own; an empty table gives none; columns of
        docs named like the new ones are replaced. With a path, the windows of
        docs become a run of the index.
        """
        span, new = self.span, ("n_words", "n_removed", "kept_text", "removed")
        docs = docs.drop(*new)
        blocks = text_blocks(docs, text)
        size = block_bytes_of(blocks)
        shards = shard_count(blocks, SHARD_BYTES, size)
        old = self._manifest()[1]
        runs = _runs(blocks, shards, span, checks=False)
        if old:
            runs = runs.unionByName(_recut(self._read([n for n, _ in old]), shards))
        with freed_shuffles(self.spark):
            hits = materialize(_merge_join(runs))
            verdicts = materialize(_verdicts(_answers(blocks, hits, shards, span)))
        if self.path:
            self._add(_runs(blocks, shards, span, checks=True), size)
        keep, kinds = [c for c in docs.columns if c != text], dict(docs.dtypes)

        def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, texts in each_block(batches):
                w = _Windows(texts, span)
                hits = {x["shard"]: unpack(x["found"], np.uint32, True) for x in b.column("found")[0].as_py() or ()}
                verdicts = {x["shard"]: unpack(x["found"], np.uint8).astype(bool) for x in b.column("verdicts")[0].as_py() or ()}
                gone = removals(w, hits, verdicts, _ids(b), shards)
                rows = b.column("rows")[0].values
                for a in range(0, len(rows), 1000):
                    part = [_kept(w.words, gone, i) for i in range(a, min(a + 1000, len(rows)))]
                    n_words, n_removed, kept, removed = zip(*part)
                    yield pa.RecordBatch.from_arrays(
                        [*(rows.field(c).slice(a, len(part)) for c in keep), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                        [*keep, *new],
                    )

        full = _by_block(blocks, hits.where("block >= 0"), "left").join(verdicts.groupBy("block").agg(F.collect_list(F.struct("shard", "found")).alias("verdicts")), "block", "left")
        out = full.mapInArrow(remove, "".join(f"`{c}` {kinds[c]}, " for c in keep) + "n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>")
        return out

    def _add(self, run: DataFrame, size: int) -> None:
        """Writes and publishes a run of so many text bytes; of more than max_runs the smallest become one, before it is written if it is none of them."""
        if sum(s > size for _, s in self._manifest()[1]) < self.max_runs - 1:
            self.compact(self.max_runs - 1)
        name = uuid.uuid4().hex
        run.write.parquet(f"{self.path}/runs/{name}")
        self._publish([*self._manifest()[1], (name, size)])
        self.compact(self.max_runs)

    def compact(self, max_runs: int = 1) -> None:
        """Merges the smallest runs into one until max_runs are left, and removes them; what ingest has returned doesn't read them."""
        runs = sorted(self._manifest()[1], key=lambda r: (-r[1], r[0]))
        kept, small = runs[: max_runs - 1], runs[max_runs - 1 :]
        if len(small) < 2:
            return
        size, name = sum(s for _, s in small), uuid.uuid4().hex
        shards = max(1, -(-size // SHARD_BYTES))

        def merge(key, table):
            h = np.concatenate([unpack(x.as_py(), np.uint64, ordered=True) for x in table["keys"]])
            c = np.concatenate([unpack(x.as_py(), np.uint64) for x in table["checks"]])
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([-1], pa.int64()), "keys": pa.array([_ordered(h[new])], pa.binary()), "checks": pa.array([pack(c[new])], pa.binary())})

        merged = _recut(self._read([n for n, _ in small]), shards).groupBy("shard").applyInArrow(merge, _RUN_DDL)
        with freed_shuffles(self.spark):
            merged.write.parquet(f"{self.path}/runs/{name}")
        self._publish([*kept, (name, size)])
        for n, _ in small:
            path, files = self._file(f"runs/{n}")
            files.delete(path, True)


def _kept(words: Words, gone: np.ndarray, row: int) -> tuple[int, int, bytes, list[dict]]:
    """n_words, n_removed, the text without the removed words and the white space after them, and the removed spans of a row."""
    a, b = int(words.bounds[row]), int(words.bounds[row + 1])
    flags, text, origin = gone[a:b], words.text(row), int(words.at[row])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))).tolist()
    spans = list(zip(edge[::2], edge[1::2]))
    parts, at = [], 0
    for x, y in spans:
        parts.append(text[at : int(words.start[a + x]) - origin])
        at = int(words.start[a + y]) - origin if a + y < b else len(text)
    return b - a, int(flags.sum()), b"".join([*parts, text[at:]]), [{"start": x, "end": y} for x, y in spans]


def deduplicate(docs: DataFrame, text: str = "text", span: int = SPAN) -> DataFrame:
    """docs with what is kept as their text and all their columns; documents of which nothing is kept stay, with an empty or blank text."""
    aside = {c: unused(f"_{c}", *docs.columns) for c in docs.columns if c in ("n_words", "n_removed", "kept_text", "removed")}
    out = FingerprintIndex(docs.sparkSession, span=span).ingest(docs.withColumnsRenamed(aside), text)
    return out.select(*[F.col("kept_text").alias(text) if c == text else F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def in_batches(docs: DataFrame, path: str, shares: tuple[float, ...] = (0.125, 0.25), text: str = "text", max_runs: int = 2) -> DataFrame:
    """docs as ingest has them, ingested one after another in batches of ascending doc_id into an index at path.

    shares: which part of the documents each batch but the last ends at, about.
    Small runs are compacted on the way. The result is that of a single batch.
    """
    index, least = FingerprintIndex(docs.sparkSession, path, max_runs=max_runs), None
    edges = docs.agg(F.percentile_approx("doc_id", list(shares), 1000)).first()[0] or []
    out = []
    for edge in [*dict.fromkeys(edges), None]:
        batch = docs if least is None else docs.where((F.col("doc_id") > least) | F.col("doc_id").isNull())
        batch = batch if edge is None else batch.where(F.col("doc_id") <= edge)
        out.append(index.ingest(batch, text))
        least = edge
    union = out[0]
    for more in out[1:]:
        union = union.unionByName(more)
    return union


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once repeated 20-word windows are gone, by an index that takes the table in three batches."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = in_batches(docs, scratch(spark))
    joined = F.btrim(F.regexp_replace("kept_text", r"[\x20\x09-\x0D]+", " "), F.lit(" "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(joined.cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = rf"""WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + {SPAN - 1}], ' ') AS win FROM w, unnest(range(1, len(w) - {SPAN - 2})) AS u(i)
), later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), gone AS (SELECT DISTINCT doc_id, j FROM later, unnest(range(i, i + {SPAN})) AS u(j)
), lists AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(len(js), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(js, i)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id)"""
