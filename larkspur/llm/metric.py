"""Exact n-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric, so measured distances to a pivot rule pairs out:
documents whose distances to it differ by more than the threshold can't be
linked. A region of documents gets pivots; each document lies in the Voronoi
cell of its nearest pivot, and is copied to another pivot's cell where that one
is at most two thresholds farther. Within a cell, rings of one threshold's
width around the pivot are the windows: a document meets those of its own ring
and of the next. Cells are split again by new pivots; what is small is compared
directly. Documents that one pivot links are one component, so no pair among
them is looked at again.

Unrelated texts share no shingle and are all at distance 1, where no pivot can
tell them apart. So the first regions are the neighbourhoods of single rare
shingles: linked documents share one of the rarest in the part of each set that
both must agree on. Documents without such a neighbour are in no region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.frames import each_block, materialize, shard_count, text_blocks
from larkspur.llm.neardup import _lower, components, shingle_sets, with_representatives
from larkspur.llm.ngrams import _counted, _summed
from larkspur.llm.text import cuts, mix, pack, release, unpack

#: Bytes of text whose shingles one shard counts.
SHARD_BYTES = 16 << 20
#: Documents of a region that are compared directly; larger ones get PIVOTS pivots.
SMALL = 128
PIVOTS = 2
#: Times that regions are split at most. What is still large then, or has few pairs less after a split, is compared directly, in parts of SMALL documents against all.
DEPTH = 3
#: Shingles that are counted by one product of matrices.
COLUMNS = 1 << 13
#: Documents whose sets are compared with one pivot's in one call.
MEMBERS = 64
#: Slack of measured distances against rounding.
_EPS = 1e-9
_XOR = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 2, dtype=np.uint64)


def _least(n, percent: int):
    """Shingles that a set of n shares with any linked one."""
    return -(-n * percent // 100)


def _named(blocks: DataFrame, k: int, kind: str) -> DataFrame:
    """(block, pos, doc_id, n_shingles, set_a, set_b): each document's place, and the size and 128-bit name of its set."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in each_block(batches):
            sets = list(shingle_sets(texts, k))
            sizes = np.array([len(x) for x in sets], np.int64)
            names = np.zeros((2, len(sets)), np.uint64)
            full = np.flatnonzero(sizes)
            if len(full):
                x, starts = np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                for side in range(2):
                    names[side, full] = np.add.reduceat(mix(x ^ _XOR[side]), starts) + sizes[full].astype(np.uint64)
            ids = b.column("rows")[0].values.field("doc_id")
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.column("block")[0].as_py()] * len(ids), pa.int64()), pa.array(np.arange(len(ids), dtype=np.int32)), ids, pa.array(sizes), *(pa.array(x.view(np.int64)) for x in names)],
                ["block", "pos", "doc_id", "n_shingles", "set_a", "set_b"],
            )
        release()

    return materialize(blocks.mapInArrow(name, f"block long, pos int, doc_id {kind}, n_shingles long, set_a long, set_b long"))


def _prefixes(texts, k: int, percent: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sets of a block, of all of them the shingles with the smallest hashes: a set of n can lack n - least of a linked one's, and as many again are taken; and how many each has."""
    sets = list(shingle_sets(texts, k))
    taken = []
    for x in sets:
        spare = len(x) - _least(len(x), percent)
        taken.append(x[: min(len(x), spare + max(1, spare))])
    return sets, np.concatenate([np.zeros(0, np.uint64), *taken]), np.array([len(x) for x in taken], np.int64)


def _neighbours(blocks: DataFrame, chosen: DataFrame, k: int, percent: int, kind: str) -> DataFrame:
    """(doc_id, n, shingles, cells) of chosen documents (block, pos) that share a cell's shingle with another text.

    Linked sets share at least as many of the taken shingles as the smaller of
    both took beyond those that it can lack; so of the taken ones, in order of
    how many texts took them, all but so many contain a shared one.
    """
    shards = shard_count(blocks, SHARD_BYTES)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in each_block(batches):
            _, taken, _ = _prefixes(texts, k, percent)
            keys, counts, _ = _counted(taken, np.ones(len(taken), np.int64))
            at = cuts(keys, shards)
            filled = np.flatnonzero(np.diff(at))
            packed = [pa.array([pack(x[at[s] : at[s + 1]], ordered=o) for s in filled], pa.binary()) for x, o in ((keys, True), (counts.astype(np.uint32), False))]
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([b.column("block")[0].as_py()] * len(filled), pa.int64()), *packed], ["shard", "block", "keys", "counts"])
        release()

    def answer(table: pa.Table) -> pa.Table:
        _, counts, places = _summed(table)
        counts = np.minimum(counts, (1 << 32) - 1).astype(np.uint32)
        return pa.table({"block": table["block"], "shard": table["shard"], "counts": pa.array([pack(counts[p]) for p in places], pa.binary())})

    asked = blocks.mapInArrow(ask, "shard int, block long, keys binary, counts binary")
    answers = asked.groupBy("shard").applyInArrow(answer, "block long, shard int, counts binary").groupBy("block").agg(F.collect_list(F.struct("shard", "counts")).alias("answers"))
    wanted = chosen.groupBy("block").agg(F.collect_list("pos").alias("chosen"))  # at most a block's documents

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in each_block(batches):
            sets, taken, sizes = _prefixes(texts, k, percent)
            _, _, place = _counted(taken, np.ones(len(taken), np.int64))
            parts = sorted(b.column("answers")[0].as_py() or (), key=lambda x: x["shard"])
            df = np.concatenate([np.zeros(0, np.uint32), *(unpack(x["counts"], np.uint32) for x in parts)])[place]
            ends, rows, cells = np.cumsum(sizes), [], []
            for i in b.column("chosen")[0].as_py():
                n, own = len(sets[i]), slice(ends[i] - sizes[i], ends[i])
                least = _least(n, percent)
                share = max(1, least - _least(least, percent))
                order = np.lexsort((taken[own], df[own]))[: max(0, int(sizes[i]) - share + 1)]
                cell = taken[own][order][df[own][order] > 1]
                if len(cell):
                    rows.append(i)
                    cells.append(cell)
            ids = b.column("rows")[0].values.field("doc_id").take(pa.array(rows, pa.int64()))
            flat = np.concatenate([np.zeros(0, np.uint64), *cells]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array([len(sets[i]) for i in rows], pa.int64()), pa.array([pack(sets[i], ordered=True) for i in rows], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(c) for c in cells])]), pa.int32()), pa.array(flat)),
                ],
                ["doc_id", "n", "shingles", "cells"],
            )
        release()

    joined = blocks.join(wanted, "block").join(answers, "block", "left")
    return materialize(joined.mapInArrow(choose, f"doc_id {kind}, n long, shingles binary, cells array<long>"))


def measure(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(pivot, doc_id, d, linked) of pairs (pivot, doc_id): Jaccard distance, and whether 100 * intersection >= percent * union.

    A pivot's pairs are dealt in parts of about MEMBERS, its set going once to each part.
    """
    kind = dict(pairs.dtypes)["doc_id"]
    counts = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    parts = materialize(counts.select("pivot", F.ceil(F.col("n") / MEMBERS).cast("int").alias("parts")))  # written, so that a hot pivot's join can be split
    sets = sets.select("doc_id", "shingles")
    dealt = pairs.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    members = dealt.join(sets.hint("merge"), "doc_id").select("pivot", "part", "doc_id", "shingles")
    pivots = parts.join(sets.withColumnRenamed("doc_id", "pivot").hint("merge"), "pivot").select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast(kind).alias("doc_id"), "shingles")

    def compare(key, table):
        ids, packed = table["doc_id"].to_pylist(), table["shingles"]
        own = next(unpack(packed[i].as_py(), np.uint64, ordered=True) for i, x in enumerate(ids) if x is None)
        far, linked = [], []
        for i, x in enumerate(ids):
            if x is not None:
                other = unpack(packed[i].as_py(), np.uint64, ordered=True)
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                both = int((own[at] == other).sum())
                union = len(own) + len(other) - both
                far.append(1 - both / union)
                linked.append(100 * both >= percent * union)
        found = [x for x in ids if x is not None]
        return pa.table({"pivot": pa.array([key[0].as_py()] * len(found), table["pivot"].type), "doc_id": pa.array(found, table["doc_id"].type), "d": pa.array(far, pa.float64()), "linked": pa.array(linked, pa.bool_())})

    return materialize(members.unionByName(pivots).groupBy("pivot", "part").applyInArrow(compare, f"pivot {kind}, doc_id {kind}, d double, linked boolean"))


def _sized(regions: DataFrame, found: DataFrame | None) -> DataFrame:
    """regions that hold documents of several components, with component and size; component: of found (doc_id, component)."""
    rows = regions if found is None else regions.join(found, "doc_id", "left")
    rows = rows.withColumn("component", F.coalesce("component", "doc_id") if found is not None else F.col("doc_id"))
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select("region", "size")
    return rows.join(sizes, "region")


def _split(rows: DataFrame, sets: DataFrame, percent: int, many: bool) -> tuple[DataFrame, DataFrame]:
    """The next regions of rows (region, doc_id, ...) by new pivots, and what was measured.

    many: PIVOTS of each region, else one. Pivots are left out of the next
    regions, as all their distances in the region are known.
    """
    width = 1 - percent / 100
    if many:
        order = Window.partitionBy("region").orderBy(F.xxhash64("doc_id"), "doc_id")
        pivots = rows.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= PIVOTS).select("region", F.col("doc_id").alias("pivot"))
    else:
        pivots = rows.groupBy("region").agg(F.min("doc_id").alias("pivot"))
    near = rows.select("region", "doc_id").distinct().join(pivots, "region")
    near = materialize(near)
    measured = measure(near.where("pivot <> doc_id").select("pivot", "doc_id").distinct(), sets, percent)
    known = near.join(measured, ["pivot", "doc_id"], "left").withColumn("d", F.when(F.col("pivot") == F.col("doc_id"), 0.0).otherwise(F.col("d")))
    home = known.groupBy("region", "doc_id").agg(F.min(F.struct("d", "pivot")).alias("home"))
    known = known.join(home, ["region", "doc_id"]).where((F.col("home.d") > 0) & (F.col("d") <= F.col("home.d") + 2 * width + _EPS))
    ring = F.floor((F.col("d") + _EPS) / width).cast("int")
    known = known.select("region", "doc_id", "pivot", F.explode(F.array(ring, ring + 1)).alias("ring"))
    region = F.xxhash64("region", "pivot", "ring") if many else F.xxhash64("pivot", "ring")  # first regions with one pivot are one
    parent = F.col("region") if many else F.lit(0).cast("long")
    return known.select(parent.alias("parent"), region.alias("region"), "doc_id").distinct(), measured


def _compare(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(hub, doc_id): links that join the components of each region of rows (region, doc_id, component, size).

    A region is dealt in parts of about SMALL documents; each two of its parts
    meet in a task, which counts common shingles by products of matrices.
    """
    kind = dict(rows.dtypes)["doc_id"]
    parts = F.ceil(F.col("size") / SMALL).cast("int")
    rows = rows.join(sets.select("doc_id", "shingles"), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("region", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "doc_id", "component", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        docs, of = table["doc_id"].to_pylist(), table["component"].to_pylist()
        each = [unpack(x.as_py(), np.uint64, ordered=True) for x in table["shingles"]]
        n = np.array([len(x) for x in each], np.int64)
        _, token, times = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        column = np.cumsum(times > 1) - 1
        row, token = np.repeat(np.arange(len(docs)), n), token.ravel()
        some = times[token] > 1
        row, token = row[some], column[token[some]]
        order = np.argsort(token, kind="stable")
        row, token = row[order], token[order]
        both, at = np.zeros((len(docs), len(docs)), np.float64), 0
        while at < len(token):
            to = int(np.searchsorted(token, token[at] + COLUMNS))
            m = np.zeros((len(docs), COLUMNS), np.float32)
            m[row[at:to], token[at:to] - token[at]] = 1
            both += m @ m.T
            at = to
        x, y = np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1))
        root, links = {}, []

        def top(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        for i, j in zip(x.tolist(), y.tolist()):
            c, d = top(of[i]), top(of[j])
            if c != d:
                root[max(c, d)] = min(c, d)
                links.append((docs[i], docs[j]))
        hubs, others = zip(*links) if links else ((), ())
        return pa.table({"hub": pa.array(hubs, table["doc_id"].type), "doc_id": pa.array(others, table["doc_id"].type)})

    return materialize(rows.groupBy("region", "one", "two").applyInArrow(compare, f"hub {kind}, doc_id {kind}"))


def _links(measured: DataFrame) -> DataFrame:
    return measured.where("linked").select(F.col("pivot").alias("hub"), "doc_id")


def metric_join(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document: the size of its set and the smallest doc_id reachable by links.

    Linked: 100 * intersection >= percent * union of the sets of distinct
    k-word shingles, lower-cased in A-Z; percent is 50 to 99. Fewer than k words
    are one shingle. A null or empty text, or one without words, has no shingle
    and no link. Rows are documents by doc_id: repeated ids share a component_id;
    of their texts the one with most shingles is compared. Rows with a null
    doc_id have a null component. Other columns are dropped, whatever their
    names; an empty table gives no rows. Texts are read whole.

    Exact up to the 64-bit hashes of shingles and 128-bit names of sets. Equal
    sets are joined as one; of groups of near copies only distances to pivots
    are measured, never all pairs.
    """
    docs = docs.select("doc_id", F.col(f"`{text}`").alias("_text"))
    kind = dict(docs.dtypes)["doc_id"]
    blocks = text_blocks(docs, "_text")
    signed, name = _named(blocks, k, kind), ["n_shingles", "set_a", "set_b"]
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct(*name)).alias("_own")).select("doc_id", "_own.*")
    reps = materialize(with_representatives(real))
    chosen = signed.join(reps.where("doc_id = rep").select("doc_id", *name), ["doc_id", *name], "left_semi").groupBy("doc_id").agg(F.min(F.struct("block", "pos")).alias("_at")).select("_at.*")
    sets = _neighbours(blocks, chosen, k, percent, kind)

    rows = materialize(_sized(sets.select(F.explode("cells").alias("region"), "doc_id"), None))
    links, found, pairs = None, None, None
    for depth in range(DEPTH + 1):
        regions, measured = _split(rows, sets, percent, many=depth > 0)
        links = _links(measured) if links is None else links.unionByName(_links(measured))
        found = materialize(components(links))
        before, rows = rows, materialize(_sized(regions, found))
        if depth:  # regions whose split leaves over half of their pairs are compared as they are
            left = rows.select("parent", "region", "size").distinct().groupBy("parent").agg(F.sum(F.col("size") * F.col("size")).alias("left"))
            split = before.select("region", "size").distinct().join(left.withColumnRenamed("parent", "region"), "region").where(2 * F.col("left") <= F.col("size") * F.col("size")).select("region")
            whole = _sized(before.select("parent", "region", "doc_id").join(split, "region", "left_anti"), found)
            rows = rows.join(split.withColumnRenamed("region", "parent"), "parent", "left_semi")
            pairs = pairs.unionByName(whole)
        last = depth == DEPTH or rows.where(F.col("size") > SMALL).isEmpty()
        done = rows if last else rows.where(F.col("size") <= SMALL)
        pairs = done if pairs is None else pairs.unionByName(done)
        if last:
            break
        rows = materialize(rows.where(F.col("size") > SMALL))
    more = _compare(_sized(pairs.select("region", "doc_id"), found), sets, percent)
    found = materialize(components(links.unionByName(more)))
    labelled = reps.select("doc_id", "rep").join(found.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("_component"))
    return signed.select("doc_id", "n_shingles").join(labelled, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles at a similarity of 0.85."""
    return metric_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)


def oracle_sql(k: int = 4, percent: int = 85, table: str = "documents") -> str:
    """DuckDB SQL of the result: every pair that shares a shingle is counted, and its components are taken."""
    return rf"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM {table}
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i : i + {k - 1}], ' ')) END) AS s FROM w
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n + b.n) AS total FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY ALL
), links AS (SELECT a, b FROM pairs WHERE 100 * shared >= {percent} * (total - shared)
), sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(doc_id, goal) AS (SELECT a, a FROM sides UNION SELECT r.doc_id, e.b FROM reach r JOIN sides e ON e.a = r.goal
), least_of AS (SELECT doc_id, min(goal) AS c FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(c, s.doc_id) AS component_id FROM s LEFT JOIN least_of USING (doc_id)"""


ORACLE_SQL = oracle_sql()
