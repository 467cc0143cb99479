"""Hard negatives by inverted lists of k-means clusters with stored radii.

Every row lies in the list of its nearest centroid. For an anchor q and a list
with centroid c and radius r no score passes q.c + |q| r, nor falls below
q.c - |q| r (Cauchy-Schwarz). An anchor first visits the lists with the highest
bounds, PROBES of them; from then on it knows k scores, and visits the others
only where their bound is not strictly below the kth. A list outside an
anchor's window of scores is never visited. So results are exact, whatever the
clusters look like; the clusters only decide how much is visited.

Lists come in parts of about LIST_ROWS and anchors in slices of about
SLICE_ROWS, so each task multiplies two bounded matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.frames import materialize
from larkspur.llm.text import release

#: Rows that the centroids are fitted on at most, and centroids at most.
SAMPLE_ROWS = 20_000
MAX_CLUSTERS = 512
#: Rounds of k-means.
ROUNDS = 8
#: Lists that an anchor visits before any is ruled out by scores.
PROBES = 8
#: Rows of a list's part, and anchors that meet one in a task.
LIST_ROWS = 4096
SLICE_ROWS = 1024
#: Largest component after quantisation, so that sums of products fit in 64 bits.
LARGEST = 1 << 27


def quantised(vectors: DataFrame, vec_id: str, embedding: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, v): rows that take part, with v the floors of scale * component; one row for an id."""
    x = F.transform(F.col(f"`{embedding}`"), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    real = F.forall(F.col(f"`{embedding}`"), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * scale < LARGEST))
    rows = vectors.where(F.col(f"`{vec_id}`").isNotNull() & F.col(f"`{embedding}`").isNotNull() & real & (F.size(f"`{embedding}`") > 0))
    rows = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.cast("array<int>").alias("v")).where("label IS NOT NULL")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_row")).select("vec_id", "_row.*")


def _fit(rows: DataFrame, count: int) -> np.ndarray:
    """Centroids by k-means on the SAMPLE_ROWS rows whose ids have the smallest hashes."""
    sample = rows.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(SAMPLE_ROWS).select("v").collect()
    x = np.array([r["v"] for r in sample], np.float64)
    k = min(MAX_CLUSTERS, max(1, int(np.sqrt(count))), len(x))
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centre)[0]
        order = np.argsort(near, kind="stable")
        begin = np.searchsorted(near[order], np.arange(k))
        size = np.bincount(near, minlength=k)
        some = size > 0
        centre[some] = np.add.reduceat(x[order], begin[some], axis=0) / size[some, None]
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, and the distance."""
    near = np.argmin((centre**2).sum(1)[None, :] - 2 * (x @ centre.T), axis=1)
    return near, np.sqrt(((x - centre[near]) ** 2).sum(1))


def _matrix(column, width: int, dtype) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), width)


def _listed(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """rows with cluster and the distance to its centroid, written."""

    def assign(batches):
        for b in batches:
            for at in range(0, b.num_rows, LIST_ROWS):
                part = b.slice(at, LIST_ROWS)
                near, far = _nearest(_matrix(part.column("v"), centre.shape[1], np.float64), centre)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(far)], [*part.schema.names, "cluster", "far"])
        release()

    return materialize(rows.mapInArrow(assign, "vec_id long, label long, v array<int>, cluster int, far double"))


def _visits(asks: DataFrame, centre: np.ndarray, lists: list[tuple[int, int, float]], later: bool) -> DataFrame:
    """asks (..., v, low, high, kth) with the lists (cluster, part) that they visit.

    low and high bound the scores asked for. The first visits go to the PROBES
    lists with the highest bounds among those that the window can touch; the
    later ones to the others whose bound is not below kth.
    """
    clusters = np.array([x[0] for x in lists], np.int64)
    parts, radius = np.array([x[1] for x in lists], np.int64), np.array([x[2] for x in lists])
    at = centre[clusters]

    def visit(batches):
        for b in batches:
            for start in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(start, SLICE_ROWS)
                q = _matrix(part.column("v"), centre.shape[1], np.float64)
                middle, spread = q @ at.T, np.sqrt((q**2).sum(1))[:, None] * radius[None, :]
                spread += 1 + 1e-9 * (np.abs(middle) + spread)  # beyond what rounding may lose
                low, high, kth = (part.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("low", "high", "kth"))
                bound = middle + spread
                touched = (bound >= low) & (middle - spread <= high)
                order = np.argsort(np.where(touched, -bound, np.inf), axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(len(clusters))[None, :], axis=1)
                go = touched & ((place >= PROBES) & (bound >= kth) if later else place < PROBES)
                row, to = np.nonzero(go)
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(row)).columns, pa.array(clusters[to].astype(np.int32)), pa.array(parts[to])], [*part.schema.names, "cluster", "parts"])

    kinds = ", ".join(f"{n} {t}" for n, t in asks.dtypes)
    out = asks.mapInArrow(visit, f"{kinds}, cluster int, parts long")
    return out.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).drop("parts")


def _best(asks: DataFrame, lists: DataFrame, k: int, same: bool) -> DataFrame:
    """(ask, anchor_id, other_id, score): of each visited part the k best rows for each ask, of the same or of another label."""

    def score(key, left, right):
        if not len(left) or not len(right):
            return pa.table({"ask": pa.array([], pa.int64()), "anchor_id": pa.array([], pa.int64()), "other_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        right = right.sort_by("vec_id")
        take = lambda t, c: t[c].combine_chunks().to_numpy(zero_copy_only=False)
        ids, labels = take(right, "vec_id"), take(right, "label")
        width = len(right["v"][0])
        anchors, of = np.unique(take(left, "anchor_id"), return_index=True)
        q, x = _matrix(left["v"].combine_chunks().take(pa.array(of)), width, np.int64), _matrix(right["v"], width, np.int64)
        small = width * float(np.abs(q).max()) * float(np.abs(x).max()) < 2**53
        product = (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if small else q @ x.T
        at = np.searchsorted(anchors, take(left, "anchor_id"))
        found = []
        for i, (ask, own, label, low, high, kth) in enumerate(zip(*(take(left, c).tolist() for c in ("ask", "anchor_id", "label", "low", "high", "kth")))):
            s = product[at[i]]
            ok = np.flatnonzero((s >= max(low, kth)) & (s <= high) & ((labels == label) if same else (labels != label)) & (ids != own))
            if len(ok) > k:  # all rows above the kth score, and of those at it the ones with the smallest ids
                least = np.partition(s[ok], len(ok) - k)[len(ok) - k]
                above, even = ok[s[ok] > least], ok[s[ok] == least]
                ok = np.concatenate([above, even[: k - len(above)]])
            if len(ok):
                found.append((np.full(len(ok), ask), np.full(len(ok), own), ids[ok], s[ok]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("ask", "anchor_id", "other_id", "score"), (c.astype(np.int64) for c in columns))))

    visitors = asks.groupBy("cluster", "part").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("slices"))
    visitors = materialize(visitors)  # so that a hot list's join can be split
    dealt = asks.join(visitors, ["cluster", "part"]).withColumn("slice", F.pmod(F.xxhash64("anchor_id"), F.col("slices")).cast("int")).drop("slices")
    rows = lists.select("cluster", "part", "vec_id", "label", "v").join(visitors, ["cluster", "part"])
    rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    key = ["cluster", "part", "slice"]
    return dealt.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(score, "ask long, anchor_id long, other_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """found with rank: each ask's first k, by score and id."""
    order = Window.partitionBy("anchor_id", "ask").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(asks: DataFrame, lists: DataFrame, centre: np.ndarray, stats: list[tuple[int, int, float]], k: int, same: bool) -> DataFrame:
    """(ask, anchor_id, other_id, score, rank): each ask's first k rows with a score from low to high, of the anchor's label or of the others.

    asks: (ask, anchor_id, label, v, low, high); higher scores come first, ties
    by smaller id. lists: rows by (cluster, part). Exact: see above.
    """
    asks = materialize(asks.withColumn("kth", F.col("low")))
    near = materialize(_first(_best(_visits(asks, centre, stats, False), lists, k, same), k))
    kth = near.where(F.col("rank") == k).select("anchor_id", "ask", F.col("score").alias("_kth"))
    known = asks.join(kth, ["anchor_id", "ask"], "left").withColumn("kth", F.coalesce("_kth", "kth")).select(*asks.columns)
    far = _best(_visits(materialize(known), centre, stats, True), lists, k, same)
    return _first(near.drop("rank").unionByName(far), k)


def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, scale: int = 256,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    `anchor` says of a vec_id whether it is an anchor. Components become
    floor(scale * x); a score is the integer inner product with the anchor.
    Higher scores come first, ties by smaller id. Positives are an anchor's
    first other rows of its label, negatives the first rows of other labels with
    low_percent * positive_score <= 100 * score <= high_percent * positive_score.

    Rows with a null id, label, vector or component, a component that is not
    finite or is 2**27 / scale or more in size, an empty vector, or another
    length than most rows (of equally frequent lengths the longest counts) take
    no part. Of rows with one id the one with the smallest label and vector takes
    part. A null `anchor` is false. An empty table gives no rows; other columns
    are dropped, whatever their names. An anchor without another row of its
    label, or a positive without a negative in its window, has no row.
    """
    label = F.col("label") if label is None else label
    rows = quantised(vectors, vec_id, embedding, label, scale)
    rows = materialize(rows.withColumn("width", F.size("v")))
    widths = rows.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if widths is None:
        return vectors.sparkSession.createDataFrame([], out)
    rows = rows.where(F.col("width") == widths["width"]).drop("width")
    centre = _fit(rows, widths["n"])
    listed = _listed(rows, centre)
    sizes = listed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("n") / LIST_ROWS).cast("long"))
    stats = [(r["cluster"], r["parts"], r["radius"]) for r in sizes.collect()]  # MAX_CLUSTERS rows at most
    parts = F.element_at(F.create_map(*[F.lit(x) for s in stats for x in s[:2]]), F.col("cluster"))
    lists = listed.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts)).drop("far")
    anchors = lists.where(F.coalesce(anchor, F.lit(False))).select(F.col("vec_id").alias("anchor_id"), "label", "v")
    bound = F.lit(1 << 62)
    asks = anchors.select(F.lit(0).cast("long").alias("ask"), "anchor_id", "label", "v", (-bound).alias("low"), bound.alias("high"))
    good = materialize(search(asks, lists, centre, stats, positives, True).select("anchor_id", F.col("rank").cast("long").alias("ask"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score").cast("decimal(20,0)")
    window = good.select("anchor_id", "ask", F.ceil(score * low_percent / 100).cast("long").alias("low"), F.floor(score * high_percent / 100).cast("long").alias("high")).where("low <= high")
    asks = anchors.join(window, "anchor_id").select("ask", "anchor_id", "label", "v", "low", "high")
    bad = search(asks, lists, centre, stats, negatives, False)
    return bad.join(good, ["anchor_id", "ask"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth row of embeddings among all rows; each seventh row counts under the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label)


ORACLE_SQL = """WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 3"""
