"""Near-duplicate documents by MinHash with tensored banding.

A document is its set of distinct word shingles. Two small collections of
half keys, HALVES of two minhashes each, come from 4 * HALVES minhashes; a
table's key pairs a half key of the first collection with one of the second,
so HALVES squared tables cost about a square root of the hashing of separate
ones. Half keys that no other document has are dropped before pairing: such a
table can't hold a partner. A pair at the threshold of 0.8 shares no table
with probability 2 * 0.36**HALVES, about 1e-5.

Equal sets meet first, as one representative. In each bucket the member that
shares most buckets with others is compared with all the rest, on full sets;
that is linear in the bucket. Where a bucket then still holds several
components, their documents are compared exactly, whatever the bucket's size:
shingles in order of rarity, a prefix of each set, and the bound on the overlap
that positions in the two prefixes allow, leave few pairs to confirm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.frames import bound_batches, materialize
from larkspur.llm.text import Words, grams, mix, pack, release, unpack

HALVES = 12
#: Documents whose sets are compared with one hub's in one call.
MEMBERS = 64
#: Rows of one shingle's documents of about a length that are compared in one part.
PART_ROWS = 1024
#: Parts of a group of equal sets that are reduced on their own first.
SALTS = 64
_R = np.random.Generator(np.random.PCG64(4))
_XOR = _R.integers(1, 1 << 63, 4 * HALVES, dtype=np.uint64)
_TIMES = _R.integers(1, 1 << 63, 4 * HALVES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column, k: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct hashes of k-word shingles; of the whole sequence where a row has fewer words."""
    words = Words(column, lower=True)
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        yield np.unique(grams(words.hash[a:b], min(k, b - a)))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, halves) of docs (doc_id, _text): a 128-bit name of the set and its 2 * HALVES half keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = list(shingle_sets(b.column("_text"), k))
            sizes = np.array([len(x) for x in sets], np.int64)
            full = np.flatnonzero(sizes)
            names = np.zeros((2, len(sets)), np.uint64)
            halves = np.zeros((len(sets), 2 * HALVES), np.uint64)
            if len(full):
                x, starts = np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                for side in range(2):
                    names[side, full] = np.add.reduceat(mix(x ^ _XOR[side]), starts) + sizes[full].astype(np.uint64)
                least = [np.minimum.reduceat((x ^ _XOR[j]) * _TIMES[j], starts) for j in range(4 * HALVES)]
                for h in range(2 * HALVES):
                    halves[full, h] = mix(least[2 * h] * np.uint64(3) + mix(least[2 * h + 1] + np.uint64(h)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, halves.size + 1, 2 * HALVES), pa.int32()), pa.array(halves.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes), *(pa.array(x.view(np.int64)) for x in names), flat], ["doc_id", "n_shingles", "set_a", "set_b", "halves"])
        release()

    kind = dict(docs.dtypes)["doc_id"]
    return bound_batches(docs).select("doc_id", "_text").mapInArrow(sign, f"doc_id {kind}, n_shingles long, set_a long, set_b long, halves array<long>")


def with_representatives(signed: DataFrame) -> DataFrame:
    """signed with rep, the smallest doc_id of an equal set; groups of equal sets are reduced in SALTS parts."""
    name = ["n_shingles", "set_a", "set_b"]
    salted = signed.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(*name, "_salt").agg(F.min("doc_id").alias("_least"))
    reps = parts.join(parts.groupBy(*name).agg(F.min("_least").alias("rep")), name).select(*name, "_salt", "rep")
    return salted.join(reps, [*name, "_salt"]).drop("_salt")


def buckets(reps: DataFrame) -> DataFrame:
    """(bucket, doc_id) of representatives (doc_id, halves): keys that pair half keys shared with another document; buckets of one may remain."""
    halves = reps.select("doc_id", F.posexplode("halves").alias("h", "half"))
    shared = halves.groupBy("h", "half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "half")
    kept = halves.join(shared, ["h", "half"]).groupBy("doc_id").agg(F.collect_list(F.struct("h", "half")).alias("kept"))  # at most 2 * HALVES a document
    first, second = (F.filter("kept", lambda x: (x["h"] < HALVES) if side == 0 else (x["h"] >= HALVES)) for side in range(2))
    pairs = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.xxhash64(a["h"], a["half"], b["h"], b["half"]))))
    return kept.select("doc_id", F.explode(pairs).alias("bucket"))


def hub_pairs(members: DataFrame) -> DataFrame:
    """(hub, doc_id), each once: every member of a bucket with the one whose buckets are largest in sum; equal sums: the smallest doc_id."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    known = members.join(sizes, "bucket")
    weight = known.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    known = known.join(weight, "doc_id").select("bucket", "doc_id", "weight")
    hubs = known.groupBy("bucket").agg(F.min(F.struct(-F.col("weight"), "doc_id")).alias("top")).select("bucket", F.col("top.doc_id").alias("hub"))
    return known.join(hubs, "bucket").where("hub <> doc_id").select("hub", "doc_id").distinct()


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles): packed sets of the docs in ids (doc_id, set_a, set_b), each that of the given name.

    The ids grow with the documents, so they are never broadcast: the plan is the same at every size.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            named = list(zip(shingle_sets(b.column("_text"), k), b.column("set_a").to_pylist(), b.column("set_b").to_pylist()))
            mine = [i for i, (x, *name) in enumerate(named) if [int(n) for n in _name(x).view(np.int64)] == name]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(mine, pa.int64())), pa.array([pack(named[i][0], ordered=True) for i in mine], pa.binary())], ["doc_id", "shingles"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "_text").join(ids.hint("merge"), "doc_id").mapInArrow(sets, f"doc_id {kind}, shingles binary").dropDuplicates(["doc_id"])


def _name(x: np.ndarray) -> np.ndarray:
    """The 128-bit name of a set, as signatures makes it."""
    return np.array([np.add.reduce(mix(x ^ _XOR[side])) + np.uint64(len(x)) if len(x) else np.uint64(0) for side in range(2)], np.uint64)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, doc_id) with 100 * intersection >= percent * union of their full sets.

    A hub's pairs are dealt in parts of about MEMBERS, the hub's set going once to each part.
    """
    counts = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    parts = materialize(counts.select("hub", F.ceil(F.col("n") / MEMBERS).cast("int").alias("parts")))  # written, so that a hot hub's join can be split
    dealt = pairs.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    members = dealt.join(sets.hint("merge"), "doc_id").select("hub", "part", "doc_id", "shingles")
    hubs = parts.join(sets.withColumnRenamed("doc_id", "hub").hint("merge"), "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast(dict(pairs.dtypes)["doc_id"]).alias("doc_id"), "shingles")

    def compare(key, table):
        ids, packed = table["doc_id"].to_pylist(), table["shingles"]
        own = next(unpack(packed[i].as_py(), np.uint64, ordered=True) for i, x in enumerate(ids) if x is None)
        found = []
        for i, x in enumerate(ids):
            if x is not None:
                other = unpack(packed[i].as_py(), np.uint64, ordered=True)
                if 100 * min(len(own), len(other)) >= percent * max(len(own), len(other)):
                    at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    both = int((own[at] == other).sum())
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        found.append(x)
        return pa.table({"hub": pa.array([key[0].as_py()] * len(found), table["hub"].type), "doc_id": pa.array(found, table["doc_id"].type)})

    kind = dict(pairs.dtypes)["doc_id"]
    return members.unionByName(hubs).groupBy("hub", "part").applyInArrow(compare, f"hub {kind}, doc_id {kind}")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component) of the ends of links (hub, doc_id); the component is the smallest id reachable.

    Rounds of large and small stars, each written out, until nothing changes:
    their number grows with the logarithm of the longest path.
    """
    edges = materialize(links.select(F.greatest("hub", "doc_id").alias("u"), F.least("hub", "doc_id").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component")).distinct())
        before = now


def _prefixes(leftover: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(token, doc_id, component, main, n, at): each leftover document's prefix, shingles that others share in order of rarity, with their places.

    Of sorted sets with the asked similarity, the first n - ceil(percent * n) + 1 tokens share one; shingles of one document come first and share none.
    """
    kind = dict(sets.dtypes)["doc_id"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 100):
            each = [unpack(x, np.uint64, ordered=True) for x in b.column("shingles").to_pylist()]
            rows = np.repeat(np.arange(len(each)), [len(x) for x in each])
            n = np.repeat([len(x) for x in each], [len(x) for x in each])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), pa.array(np.concatenate(each).view(np.int64) if each else np.zeros(0, np.int64)), pa.array(n.astype(np.int32))], ["doc_id", "token", "n"])

    tokens = sets.join(leftover.select("doc_id"), "doc_id", "left_semi").mapInArrow(spread, f"doc_id {kind}, token long, n int")
    tokens = materialize(tokens)
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = tokens.join(common, "token").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))  # at most one document's set
    alone = F.col("n") - F.size("t")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    prefix = ranked.where(length > 0).select("doc_id", "n", alone.alias("alone"), F.posexplode(F.slice("t", F.lit(1), length.cast("int"))).alias("i", "x"))
    return prefix.join(leftover, "doc_id").select(F.col("x.token").alias("token"), "doc_id", "component", "main", "n", (F.col("alone") + F.col("i")).alias("at"))


def exact_pairs(members: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(hub, doc_id) that could still be linked among members of buckets that hold several components of `found`."""
    ids = members.join(found, "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    by = ids.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = by.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("n", "component")).alias("top")).where("c > 1").select("bucket", F.col("top.component").alias("largest"))
    leftover = materialize(ids.join(mixed, "bucket").groupBy("doc_id", "component").agg(F.min(F.col("component") == F.col("largest")).alias("main")))
    rows = materialize(_prefixes(leftover, sets, percent))  # main: in the largest component of each of its buckets
    # Only lengths within the asked ratio compare: those of a block (a power of that ratio) and the next ones. Many rows in one block are dealt in parts.
    block = F.floor(F.log("n") / F.log(F.lit(100.0001 / percent))).cast("int")
    rows = rows.withColumn("block", block)
    sizes = rows.groupBy("token", "block").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > PART_ROWS)
    many = materialize(sizes.select("token", "block", F.ceil(F.col("size") / PART_ROWS).cast("int").alias("parts")))
    x, y = (rows.select("token", "block", *[F.col(c).alias(f"{side}_{c}") for c in ("doc_id", "component", "n", "at")], F.col("main").alias(f"{side}_main")) for side in "xy")
    parts = F.coalesce("parts", F.lit(1))
    x = x.join(many, ["token", "block"], "left").withColumn("part", F.pmod(F.xxhash64("x_doc_id"), parts).cast("int")).drop("parts")
    y = y.withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1))).join(many, ["token", "block"], "left")
    y = y.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    n = F.col("x_n") + F.col("y_n")
    overlap = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))  # of the shared token and all after it
    ok = (
        (F.col("x_doc_id") < F.col("y_doc_id")) & (F.col("x_component") != F.col("y_component")) & ~(F.col("x_main") & F.col("y_main"))
        & (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")) & ((100 + percent) * overlap >= percent * n)
    )
    return x.join(y, ["token", "block", "part"]).where(ok).select(F.col("x_doc_id").alias("hub"), F.col("y_doc_id").alias("doc_id")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document: the component is the smallest doc_id reachable by links, and that one is kept.

    Linked: 100 * intersection >= percent * union of the sets of distinct
    k-word shingles, lower-cased in A-Z. Fewer than k words are one shingle. A
    null or empty text, or one without words, has no shingle and no link.
    Rows are documents by doc_id: repeated ids share a component_id and are all
    kept or all not; of their texts the one with most shingles is compared.
    Rows with a null doc_id have a null component and are kept. Other columns
    are dropped. Texts are read whole. Groups of any size are linked without
    emitting their pairs; documents whose bucket stays mixed are compared by rare
    shingles, by parts of PART_ROWS of about one length.
    """
    docs = docs.select("doc_id", F.col(text).alias("_text"))
    signed, name = materialize(signatures(docs, k)), ["n_shingles", "set_a", "set_b"]
    real = signed.where("n_shingles > 0 and doc_id is not null")
    real = real.groupBy("doc_id").agg(F.max(F.struct(*name)).alias("_own")).select("doc_id", "_own.*")  # one set for an id
    named = materialize(with_representatives(real))
    own = named.where(F.col("doc_id") == F.col("rep")).select("doc_id", *name)
    reps = signed.join(own, ["doc_id", *name], "left_semi").dropDuplicates(["doc_id"])
    members = materialize(buckets(reps.select("doc_id", "halves")))
    pairs = materialize(hub_pairs(members))
    ids = pairs.select(F.col("hub").alias("doc_id")).unionByName(pairs.select("doc_id")).distinct().join(own.select("doc_id", "set_a", "set_b"), "doc_id")
    sets = materialize(_sets_of(docs, ids, k))
    links = materialize(confirm(pairs, sets, percent))
    more = exact_pairs(members, components(links), sets, percent)
    links = links.unionByName(confirm(materialize(more), sets, percent))
    found = materialize(components(links))
    labelled = named.select("doc_id", "rep").join(found.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("_component"))
    out = signed.select("doc_id", "n_shingles").join(labelled, "doc_id", "left")
    component = F.coalesce("_component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """docs without the documents that near_duplicates does not keep; all columns stay."""
    gone = near_duplicates(docs, k, percent, text).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate components of all documents, by 4-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)


def _lower(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql(k: int = 4, percent: int = 80, table: str = "documents") -> str:
    """DuckDB SQL of the result: pairs that share a shingle of one of the 1 - percent/100 rarest of both, confirmed, and their components."""
    return rf"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM {table}
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i : i + {k - 1}], ' ')) END) AS s FROM w
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s
), ranked AS (SELECT doc_id, n, t, row_number() OVER (PARTITION BY doc_id ORDER BY df, t) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY t) AS df FROM t)
), prefix AS (SELECT * FROM ranked WHERE pos <= n - ceil({percent} * n / 100.0) + 1
), pairs AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.t = b.t AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
), links AS (
  SELECT a, b FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= {percent} * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))
), sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(doc_id, goal) AS (SELECT a, a FROM sides UNION SELECT r.doc_id, e.b FROM reach r JOIN sides e ON e.a = r.goal
), least_of AS (SELECT doc_id, min(goal) AS c FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(c, s.doc_id) AS component_id, coalesce(c, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN least_of USING (doc_id)"""


ORACLE_SQL = oracle_sql()

