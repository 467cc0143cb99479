"""Quality classifier: random-indexing word vectors pooled by document, then a two-layer network.

A word has sparse random index vectors of itself, of its ending and of its
shape, and, if the training sample has it, a context vector: the sum of the
index vectors of its neighbours over that sample. A document is the mean of its
words' vectors. The network is trained on the driver on a bounded sample of
labelled rows and its probabilities are calibrated by a temperature fitted on
rows that it was not trained on.

The sample is written once; its context sums are added up by word in Spark, for
every word of it. They are broadcast in slices of SLICE_WORDS words: one slice is
the usual case, and each further one takes another pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.frames import bound_batches, crc_remainder, materialize, unused
from larkspur.llm.text import Words, mix, pack, release, unpack

DIM, HIDDEN, NEIGHBOURS, NONZERO = 48, 32, 2, 4
#: Bound of what the driver learns from: labelled rows.
MAX_ROWS = 12_000
#: Words whose context vectors are broadcast at once (DIM bytes each).
SLICE_WORDS = 1_000_000
#: Steps of a context vector's entries, which lie between -2 and 2.
STEPS = 60
#: Words whose vectors a worker remembers.
CACHE_WORDS = 150_000
ROWS, CHUNK = 250, 20_000
#: Ranges of word hashes whose sums meet in one task.
RANGES = 64
_SHAPE = np.array([ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in range(256)], np.uint64)
_KIND = {name: mix(np.full(1, i, np.uint64)) for i, name in enumerate(("word", "ending", "shape", "run"), 1)}


def _feature(kind: str, x: np.ndarray) -> np.ndarray:
    return mix(mix(x) + _KIND[kind])


def index_vectors(features: np.ndarray) -> np.ndarray:
    """Sparse random vectors of hashed features: NONZERO entries of +-1 each, which may meet."""
    out = np.zeros((len(features), DIM), np.float32)
    rows, h = np.arange(len(features)), features
    for _ in range(NONZERO):
        h = mix(h + np.uint64(0x9E3779B97F4A7C15))
        out[rows, (h >> np.uint64(8)).astype(np.int64) % DIM] += np.where(h & np.uint64(1), 1.0, -1.0).astype(np.float32)
    return out


def _shapes(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each word's shape: classes of bytes, equal ones in a row as one that is marked."""
    kinds = _SHAPE[data]
    new = np.ones(len(data), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[at] = True
    runs = np.flatnonzero(new)
    long = np.diff(np.append(runs, len(data))) > 1
    of = np.searchsorted(runs, at)  # each word's first run
    place = (np.arange(len(runs)) - np.repeat(of, np.diff(np.append(of, len(runs))))).astype(np.uint64)
    return np.add.reduceat(_feature("run", (place << np.uint64(9)) + (kinds[runs] << np.uint64(1)) + long.astype(np.uint64)), of)


def _endings(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each word's last three bytes."""
    out, last = np.zeros(len(at), np.uint64), at + sizes - 1
    for j in range(3):
        out = (out << np.uint64(9)) + np.where(sizes > j, data[np.maximum(last - j, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return out


def plain_vectors(words: Words, which: np.ndarray) -> np.ndarray:
    """The vectors of the given words but for their contexts: index vectors of shape (twice), ending and, by half, the word itself."""
    sizes = words.end[which] - words.start[which]
    ends = np.cumsum(sizes)
    at = ends - sizes
    data = words.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(words.start[which] - at, sizes)]
    if not len(which):
        return np.zeros((0, DIM), np.float32)
    out = 0.5 * index_vectors(_feature("word", words.hash[which]))
    for times, kind, feature in ((2, "shape", _shapes(data, at, sizes)), (1, "ending", _endings(data, at, sizes))):
        unique, inverse = np.unique(feature, return_inverse=True)
        out += times * index_vectors(_feature(kind, unique))[inverse]
    return out


class Slice:
    """Context vectors of some words: sorted hashes and a row of small integers each."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray):
        self.hashes, self.rows = hashes, rows

    def add(self, hashes: np.ndarray, table: np.ndarray) -> None:
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = np.flatnonzero(self.hashes[at] == hashes)
            table[known] += self.rows[at[known]].astype(np.float32) * np.float32(0.5 / STEPS)


class Packed:
    """A slice as the driver passes it on, compressed by range; a worker opens it once."""

    def __init__(self, ranges: list[tuple[bytes, bytes]]):
        self.ranges, self.slice = ranges, None

    def open(self) -> Slice:
        if self.slice is None:
            joined = lambda i, t: np.concatenate([np.zeros(0, t), *(unpack(r[i], t, ordered=i == 0) for r in self.ranges)])
            self.slice = Slice(joined(0, np.uint64), joined(1, np.int8).reshape(-1, DIM))
        return self.slice


class WordVectors:
    """Vectors of words by hash, remembered from slice to slice of rows; when full, only the words of the last call stay."""

    def __init__(self, context: Slice, plain: bool):
        self.context, self.plain = context, plain
        self.hashes, self.table = np.zeros(0, np.uint64), np.zeros((0, DIM), np.float32)

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """A table of vectors, and each word's row in it."""
        unique, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != unique[inside]
        if new.any():
            add = plain_vectors(words, first[new]) if self.plain else np.zeros((int(new.sum()), DIM), np.float32)
            self.context.add(unique[new], add)
            if len(self.hashes) + len(add) > CACHE_WORDS:
                self.hashes, self.table = self.hashes[at[~new]], self.table[at[~new]]
            place = np.searchsorted(self.hashes, unique[new])
            self.hashes, self.table = np.insert(self.hashes, place, unique[new]), np.insert(self.table, place, add, axis=0)
            at = np.searchsorted(self.hashes, unique)
        return self.table, at[inverse]


def summed(words: Words, vectors: WordVectors) -> np.ndarray:
    """A row for each document: the sum of its words' vectors."""
    out = np.zeros((len(words.counts), DIM), np.float32)
    if not words.n:
        return out
    table, at = vectors.of(words)
    rows = words.rows()
    for i in range(0, words.n, CHUNK):
        r = rows[i : i + CHUNK]
        starts = np.flatnonzero(np.diff(r, prepend=-1))
        out[r[starts]] += np.add.reduceat(table[at[i : i + CHUNK]], starts, axis=0)
    return out


def _pooled(sums: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Means of the words' vectors, and the logarithm of their number."""
    return np.column_stack([sums / np.maximum(n_words, 1)[:, None], np.log1p(n_words) / 8]).astype(np.float32)


def vectors(docs: DataFrame, contexts: Contexts, text: str, out: str, network: Network | None = None) -> DataFrame:
    """docs with the pooled vector as column `out` or, where a network is given, the probability instead.

    Each slice of the context vectors beyond the first takes another pass over
    the texts, between which rows are written out with their sums.
    """
    names = docs.columns
    sums_name = unused("_sums", *names, out)
    ddl = "".join(f"`{c}` {t}, " for c, t in docs.dtypes)
    for k in range(len(contexts.slices)):
        if k:
            docs = materialize(docs)
        shared, last = contexts.shared(k), k == len(contexts.slices) - 1

        def embed(batches: Iterator[pa.RecordBatch], shared=shared, first=not k, last=last) -> Iterator[pa.RecordBatch]:
            context = shared.value.open()
            words_of = WordVectors(context, first)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    b = batch.slice(at, ROWS)
                    words = Words(b.column(text))
                    sums = summed(words, words_of)
                    if not first:
                        sums += np.array(b.column(sums_name).flatten(), np.float32).reshape(-1, DIM)
                    flat = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                    pooled = _pooled(sums, words.counts) if last else None
                    made = flat(sums) if not last else pa.array(network.probability(pooled)) if network else flat(pooled)
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), made], [*names, out if last else sums_name])
            del words_of
            release()

        kind = f"`{sums_name}` array<float>" if not last else f"`{out}` {'double' if network else 'array<float>'}"
        docs = bound_batches(docs).mapInArrow(embed, ddl + kind)
    return docs


def context_vectors(texts: DataFrame, text: str) -> DataFrame:
    """(range, n, hashes, sums, rows) of ranges of word hashes: for each word of the texts the sum of the index vectors of its neighbours, NEIGHBOURS on either side, and its vector of length 2.

    Each task adds up its texts and sends a row for each range; the sums of a range meet in one task.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = np.zeros(0, np.uint64), np.zeros((0, DIM), np.int32)

        def rows():
            at = np.searchsorted(known, np.arange(1, RANGES, dtype=np.uint64) * np.uint64((1 << 64) // RANGES))
            at = np.concatenate([[0], at, [len(known)]])
            filled = [i for i in range(RANGES) if at[i + 1] > at[i]]
            return pa.RecordBatch.from_arrays(
                [pa.array(filled, pa.int32()), pa.array([known[at[i] : at[i + 1]].tobytes() for i in filled], pa.binary()), pa.array([total[at[i] : at[i + 1]].tobytes() for i in filled], pa.binary())],
                ["range", "hashes", "sums"],
            )

        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                w = Words(b.column(text).slice(s, ROWS))
                if not w.n:
                    continue
                unique, inverse = np.unique(w.hash, return_inverse=True)
                own, rows_of, sums = index_vectors(_feature("word", unique)).astype(np.int32), w.rows(), np.zeros((len(unique), DIM), np.int32)
                order = np.argsort(inverse, kind="stable")
                begin = np.searchsorted(inverse[order], np.arange(len(unique)))
                for d in range(1, NEIGHBOURS + 1):
                    for side in (d, -d):
                        other = order + side
                        ok = (other >= 0) & (other < w.n)
                        ok[ok] = rows_of[other[ok]] == rows_of[order[ok]]
                        for i in range(0, len(unique), CHUNK):  # words' neighbours, bounded in memory by CHUNK words' occurrences and one word's
                            a, z = begin[i], begin[i + CHUNK] if i + CHUNK < len(unique) else w.n
                            for c in range(a, z, 4 * CHUNK):
                                part = slice(c, min(z, c + 4 * CHUNK))
                                vectors = own[inverse[np.clip(other[part], 0, w.n - 1)]] * ok[part, None]
                                word = inverse[order[part]]
                                starts = np.flatnonzero(np.diff(word, prepend=-1))
                                sums[word[starts]] += np.add.reduceat(vectors, starts, axis=0)
                known, total = _merged([known, unique], [total, sums])
                if len(known) > SLICE_WORDS:
                    yield rows()
                    known, total = known[:0], total[:0]
        if len(known):
            yield rows()
        release()

    def add(key, table):
        hashes, sums = _merged(
            [np.frombuffer(x.as_py(), np.uint64) for x in table["hashes"]], [np.frombuffer(x.as_py(), np.int32).reshape(-1, DIM) for x in table["sums"]]
        )
        rows = np.rint(2 * STEPS * sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)).astype(np.int8)
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(hashes)], pa.int64()), "hashes": pa.array([pack(hashes, ordered=True)], pa.binary()), "sums": pa.array([pack(sums.ravel())], pa.binary()), "rows": pa.array([pack(rows.ravel())], pa.binary())})

    parts = bound_batches(texts).select(text).mapInArrow(gather, "range int, hashes binary, sums binary")
    return parts.groupBy("range").applyInArrow(add, "range int, n long, hashes binary, sums binary, rows binary")


def _merged(hashes: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and their added sums."""
    h, s = np.concatenate(hashes), np.concatenate(sums)
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    begin = np.flatnonzero(new)
    return h[begin], np.add.reduceat(s[order], begin, axis=0, dtype=np.int32) if len(begin) else s


class Contexts:
    """The context vectors of all words of a sample, a written table, in slices of whole ranges; one slice at a time passes through the driver."""

    def __init__(self, table: DataFrame, slice_words: int):
        self.table, self.slices, self.held, size = table, [[]], None, 0
        for r in table.select("range", "n").orderBy("range").collect():  # RANGES rows
            if size and size + r["n"] > slice_words:
                self.slices.append([])
                size = 0
            self.slices[-1].append(r["range"])
            size += r["n"]

    def packed(self, k: int) -> Packed:
        rows = self.table.where(F.col("range").isin(self.slices[k])).select("range", "hashes", "rows").collect()
        return Packed([(bytes(r["hashes"]), bytes(r["rows"])) for r in sorted(rows, key=lambda r: r["range"])])

    def load(self, k: int) -> Slice:
        return self.packed(k).open()

    def shared(self, k: int):
        """Slice k as a broadcast; the last one asked for is kept."""
        if self.held is None or self.held[0] != k:
            if self.held is not None:
                self.held[1].unpersist()
            self.held = k, self.table.sparkSession.sparkContext.broadcast(self.packed(k))
        return self.held[1]


def learn_context(texts: DataFrame, text: str = "text", slice_words: int = SLICE_WORDS) -> Contexts:
    """Context vectors of all words of texts, a written and bounded sample, in slices of about slice_words words."""
    return Contexts(materialize(context_vectors(texts, text)), slice_words)


@dataclass
class Network:
    """Two layers over standardised vectors; without training rows, every probability is 0.5."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    @classmethod
    def start(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        return cls(np.zeros(DIM + 1), np.ones(DIM + 1), r.normal(0, (2 / (DIM + 1)) ** 0.5, (DIM + 1, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> Network:
        """Adam on the log loss over four fifths of the rows, then the temperature on the last fifth."""
        order = np.random.default_rng(seed).permutation(len(x))
        x, y = x[order].astype(float), y[order].astype(float)
        held = len(x) // 5
        vx, vy, x, y = x[:held], y[:held], x[held:], y[held:]
        if not len(x):
            return self
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        self.w2 = np.random.default_rng(seed).normal(0, HIDDEN**-0.5, HIDDEN)
        state = [np.zeros_like(p) for p in (self.w1, self.b1, self.w2, np.zeros(1)) for _ in range(2)]
        step, shuffle = 0, np.random.default_rng(seed + 1)
        z = (x - self.mean) / self.scale
        for _ in range(epochs):
            for at in np.array_split(shuffle.permutation(len(z)), max(1, len(z) // 128)):
                step += 1
                pre = z[at] @ self.w1 + self.b1
                hidden = np.maximum(pre, 0)
                error = (1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2, -30, 30))) - y[at]) / len(at)
                back = np.outer(error, self.w2) * (pre > 0)
                for k, (p, g) in enumerate(((self.w1, z[at].T @ back + decay * self.w1), (self.b1, back.sum(0)), (self.w2, hidden.T @ error + decay * self.w2), (np.array([self.b2]), np.array([error.sum()])))):
                    m, v = state[2 * k], state[2 * k + 1]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                    if k == 3:
                        self.b2 -= float(change[0])
                    else:
                        p -= change
        if held:
            logits = self.logits(vx)
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            loss = [np.mean(np.logaddexp(0, np.where(vy > 0.5, -1, 1) * logits / t)) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self


def sample_of(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, quality, text): the rows that are learned from, max_rows at most, those with the smallest hash of their id.

    Only ids whose crc32 mod 3 is not 1 and labels 0 or 1 count; an id with both
    labels is two rows. Repeated ids are one document, with the least of their
    texts. Labels without a document count for nothing.
    """
    usable = labels.where("quality in (0, 1)").where(crc_remainder("doc_id", 3) != 1).select("doc_id", "quality").distinct()
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows ids at most
    parts = min(RANGES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return found.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).repartition(parts)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[Contexts, Network]:
    """Context vectors and network from docs (doc_id, text) with a label in labels (doc_id, quality), from sample_of.

    One pass over docs, for the sample. Null and empty texts are learned from as
    texts without words; long ones whole. Without a sample every probability is 0.5.
    """
    sample = materialize(sample_of(docs, labels, max_rows))
    contexts = learn_context(sample)
    rows = vectors(sample, contexts, "text", "vector").select("doc_id", "quality", "vector").toArrow()
    x = np.array(rows["vector"].combine_chunks().flatten()).reshape(-1, DIM + 1) if len(rows) else np.zeros((0, DIM + 1))
    y = np.array(rows["quality"])
    order = np.lexsort((y, np.array(rows["doc_id"].cast(pa.string()), str))) if len(rows) else []
    network = Network.start().fit(x[order], y[order])
    del rows, x, y
    release()
    return contexts, network


def classify(docs: DataFrame, contexts: Contexts, network: Network, text: str = "text", score: str = "score") -> DataFrame:
    """docs with the calibrated probability of label 1 as column `score`.

    Null texts are empty; an empty text has a score, too; texts are read whole,
    250 rows at a time. Equal texts have equal scores, repeated rows stay, an
    empty table stays empty. A column of that name is replaced; others stay,
    whatever their names.
    """
    return vectors(docs.drop(score), contexts, text, score, network)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = classify(docs, *train(docs, labels))
    return scored.select("doc_id", (crc_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
