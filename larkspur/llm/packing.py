"""Best-fit packing of token pieces by exact-complement hashing.

Pieces shorter than a sequence are known by their length alone, so the plan is
made from a histogram of at most `size` counts, however many documents there
are. An index, built once, has for each sum the pairs of available lengths that
make it and, over the pairs, the triples. From the longest length down, one, two
or three lengths that sum to the exact rest of the sequence are looked up, and the
combination is used as often as its counts allow; combinations whose lengths have
run out are passed over for good. What stays is packed best fit.
The plan is a bounded list of patterns with multiplicities. Pieces then take
numbers within their length, in Spark, and a number's place follows from the
plan by a binary search.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.frames import bound_batches, materialize, unused
from larkspur.llm.text import Words, release

SIZE, END_ID, TOKENIZER = 2048, 0, "word_bpe_49k.json"
#: Words whose ids a worker remembers.
CACHE_WORDS = 1_500_000
#: A length's pieces are numbered in parts of PART_ROWS, or as many more as make PARTS parts of all.
PART_ROWS, PARTS = 256, 4096
PIECES = "piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of white-space separated words, remembered by the word's hash and bytes.

    The tokenizer drops white space and joins nothing over it, so a text's ids
    are its words' ids; it cuts a comma or full stop from letters before it, and
    lowers letters, but its control tokens count only as they are written. New
    words of letters go to it many in one text: each ends with an id that marks
    a word's end. The memory is arrays of sorted hashes, of the words' bytes and
    of their ids; when full, the words of the last call stay. A word whose hash
    is remembered for other bytes is encoded each time.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.hashes, self.ids, self.bytes = np.zeros(0, np.uint64), _Ragged("<u4"), _Ragged(np.uint8)

    def ids_of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and where each word's begin (one more than words)."""
        unique, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        start, sizes = words.start[first], words.end[first] - words.start[first]
        at = np.minimum(np.searchsorted(self.hashes, unique), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == unique if len(self.hashes) else np.zeros(len(unique), bool)
        other = np.flatnonzero(known)
        other = other[~self.bytes.equal(at[other], words.data, start[other], sizes[other])]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.hashes) + len(new) > CACHE_WORDS:
                keep = at[known]
                self.hashes, self.ids, self.bytes = self.hashes[keep], self.ids.take(keep), self.bytes.take(keep)
            place = np.searchsorted(self.hashes, unique[new])
            self.ids.insert(place, *self._encode([words.bytes_of(k).decode() for k in first[new].tolist()]))
            self.bytes.insert(place, words.data[_ragged(start[new], sizes[new])], sizes[new])
            self.hashes = np.insert(self.hashes, place, unique[new])
            at = np.searchsorted(self.hashes, unique)
        ids, begin, count = self.ids.data, self.ids.at[at], self.ids.size[at]
        if len(other):
            more, count[other] = self._encode([words.bytes_of(k).decode() for k in first[other].tolist()])
            begin[other] = len(ids) + np.cumsum(count[other]) - count[other]
            ids = np.concatenate([ids, more])
        count = count[inverse]
        return ids[_ragged(begin[inverse], count)], np.concatenate([[0], np.cumsum(count)])

    def _encode(self, texts: list[str], joined: int = 50) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, in order, and how many each has."""
        letters = np.fromiter((t.isalpha() and (t.isascii() or normalize("NFC", t.lower()).isalpha()) for t in texts), bool, len(texts))
        plain, other = [texts[i] for i in np.flatnonzero(letters)], [texts[i] for i in np.flatnonzero(~letters)]
        got = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([" ".join(plain[i : i + joined]) for i in range(0, len(plain), joined)], add_special_tokens=False)]
        together = np.concatenate([np.zeros(0, "<u4"), *got])
        ends = np.flatnonzero(self.ends[together]) + 1
        if len(ends) != len(plain):  # letters that the tokenizer doesn't take for such
            letters[:], other, together, ends = False, texts, together[:0], ends[:0]
        single = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        sizes = np.zeros(len(texts), np.int64)
        sizes[letters], sizes[~letters] = np.diff(ends, prepend=0), [len(x) for x in single]
        ids = np.zeros(int(sizes.sum()), "<u4")
        begin = np.cumsum(sizes) - sizes
        ids[_ragged(begin[letters], sizes[letters])] = together
        ids[_ragged(begin[~letters], sizes[~letters])] = np.concatenate([np.zeros(0, "<u4"), *single])
        return ids, sizes


class _Ragged:
    """Lists of numbers in one array: where each begins, and its size."""

    def __init__(self, kind):
        self.data, self.at, self.size = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def insert(self, place: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> None:
        self.at = np.insert(self.at, place, len(self.data) + np.cumsum(sizes) - sizes)
        self.size, self.data = np.insert(self.size, place, sizes), np.concatenate([self.data, data])

    def take(self, which: np.ndarray) -> _Ragged:
        out = _Ragged(self.data.dtype)
        out.insert(np.zeros(len(which), np.int64), self.data[_ragged(self.at[which], self.size[which])], self.size[which])
        return out

    def equal(self, which: np.ndarray, data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each of the lists is the same as data[at:at + sizes]."""
        out = self.size[which] == sizes
        same = np.flatnonzero(out & (sizes > 0))
        if len(same):
            differ = self.data[_ragged(self.at[which[same]], sizes[same])] != data[_ragged(at[same], sizes[same])]
            out[same] = ~np.logical_or.reduceat(differ, np.cumsum(sizes[same]) - sizes[same])
        return out


def _ragged(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes at[i] to at[i] + sizes[i], one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + sizes, sizes)


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, ids: bool = False, text: str = "text") -> DataFrame:
    """docs without text, a row for each piece: piece (from 0), start, length, ids_crc32 and, if asked for, ids.

    A null or empty text is the end id alone; long texts are read whole, 250 rows
    at a time; repeated rows are pieces of their own; an empty table gives none.
    Columns of docs named like the new ones are replaced.
    """
    path = path or tokenizer_path()
    new = ["piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    keep = [c for c in docs.columns if c.lower() not in (text.lower(), *new)]
    own = unused("_text", *keep)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordIds(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                b = batch.slice(at, 250)
                words = Words(b.column(own), split=b",.")
                all_ids, starts = table.ids_of(words)
                begin, rows = starts[words.bounds], []
                for i in range(b.num_rows):
                    data = all_ids[begin[i] : begin[i + 1]].tobytes() + end
                    for k in range(0, len(data), 4 * size):
                        part = data[k : k + 4 * size]
                        rows.append((i, k // (4 * size), k // 4, len(part) // 4, zlib.crc32(part), part if ids else None))
                columns = [pa.array(x, t) for x, t in zip(list(zip(*rows)) or [[]] * 6, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                arrays = [b.column(c).take(columns[0]) for c in keep] + columns[1:5]
                if ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in columns[5].to_pylist()], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *new])
        del table
        release()

    kinds = dict(docs.dtypes)
    ddl = "".join(f"`{c}` {kinds[c]}, " for c in keep) + PIECES + (", ids array<long>" if ids else "")
    return bound_batches(docs).select(*keep, F.col(text).alias(own)).mapInArrow(cut, ddl)


class Sums:
    """Counted lengths and an index of what one, two or three of them sum to.

    pairs[s] has the longer lengths of all pairs that sum to s, descending;
    triples are a length and a pair that is no longer, so they need no table of
    their own. Counts only fall, so a combination that has run out stays so: each
    sum remembers from where its combinations may still be there.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.count = [0] * (size + 1)
        for n, c in counts.items():
            self.count[n] = c
        self.order = sorted(n for n, c in counts.items() if c > 0)  # falls only
        lengths = np.array(self.order, np.int64)
        a, b = (lengths[x] for x in np.tril_indices(len(lengths)))  # a >= b
        fit = a + b <= size
        a, b = a[fit], b[fit]
        by_sum = np.lexsort((-a, a + b))
        edges = np.searchsorted((a + b)[by_sum], np.arange(size + 2))
        self.pairs = [a[by_sum[x:y]].tolist() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
        self.lengths = self.order[::-1]  # all that ever were
        self.pair_from, self.triple_from = [0] * (size + 1), [0] * (size + 1)

    def take(self, n: int, times: int) -> None:
        self.count[n] -= times
        if not self.count[n]:
            del self.order[bisect_left(self.order, n)]

    def single(self, total: int, held: dict[int, int]) -> bool:
        return self.count[total] > held.get(total, 0)

    def pair(self, total: int, held: dict[int, int], most: int | None = None) -> tuple[int, int] | None:
        """Two available lengths, none above `most`, that sum to total; held lengths are in use already."""
        count, all_of, i = self.count, self.pairs[total], self.pair_from[total]
        while i < len(all_of) and not (count[a := all_of[i]] and count[b := total - a] and (a != b or count[a] > 1)):
            i += 1
        self.pair_from[total] = i
        while i < len(all_of):
            a = all_of[i]
            b = total - a
            if (most is None or a <= most) and count[a] - held.get(a, 0) > (a == b) and count[b] > held.get(b, 0):
                return a, b
            i += 1
        return None

    def triple(self, total: int, held: dict[int, int]) -> tuple[int, int, int] | None:
        count, i, first = self.count, self.triple_from[total], True
        while i < len(self.lengths) and 3 * (a := self.lengths[i]) >= total:
            if a < total and count[a]:
                if first and self.pair(total - a, {}, a) is not None:
                    self.triple_from[total], first = i, False
                if count[a] > held.get(a, 0):
                    two = self.pair(total - a, held | {a: held.get(a, 0) + 1}, a)
                    if two is not None:
                        return a, *two
            i += 1
        if first:
            self.triple_from[total] = i
        return None

    def complement(self, gap: int, held: dict[int, int]) -> tuple[int, ...] | None:
        """One, two or three available lengths, besides the held ones, that sum to gap; the longest first."""
        if gap <= 0:
            return None
        return (gap,) if self.single(gap, held) else self.pair(gap, held) or self.triple(gap, held)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a sequence, how often) that use each length as often as counted; lengths are 1 to size."""
    have, patterns = Sums({n: c for n, c in counts.items() if c > 0}, size), []
    if full := have.count[size]:
        patterns.append(((size,), full))
        have.take(size, full)
    rest: dict[int, int] = {}
    while have.order:
        n = have.order[-1]
        found = have.complement(size - n, {n: 1})
        if found is None:
            rest[n] = have.count[n]
            have.take(n, have.count[n])
            continue
        pattern = (n, *found)
        times = min(have.count[x] // pattern.count(x) for x in set(pattern))
        patterns.append((pattern, times))
        for x in set(pattern):
            have.take(x, times * pattern.count(x))
    return patterns + _best_fit(rest, size)


def _best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over groups of equal sequences: open[gap] lists (pattern, how often)."""
    opened: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = size - sum(pattern)
        if gap not in opened:
            opened[gap] = []
            insort(gaps, gap)
        opened[gap].append((pattern, times))

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left and (i := bisect_left(gaps, n)) < len(gaps):
            group = opened[gaps[i]]
            pattern, times = group.pop()
            if not group:
                del opened[gaps.pop(i)]
            fit = (size - sum(pattern)) // n
            if times <= left // fit if fit else False:
                put(pattern + (n,) * fit, times)
                left -= fit * times
            elif times <= left:  # not enough for all to take `fit`
                k = left // times
                put(pattern + (n,) * k, times)
                left -= k * times
            else:
                put(pattern, times - left)
                put(pattern + (n,), left)
                left = 0
        per = size // n
        if left >= per:
            put((n,) * per, left // per)
            left %= per
        if left:
            put((n,) * left, 1)
    return [x for group in opened.values() for x in group]


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces (with length) with sequence_id and offset; sequences are gapless from 0 and no longer than size.

    Full pieces are sequences of their own, with negative numbers. `cut` should
    be a written table, as it is read more than once. Equal rows are separate
    pieces; lengths must be 1 to size.
    """
    spark = cut.sparkSession
    names = [c for c in cut.columns if c.lower() not in ("sequence_id", "offset")]
    full = cut.where(F.col("length") == size).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    cut = cut.where(F.col("length") < size).select(*names)
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # below `size` rows
    base, slots = 0, {}
    for pattern, times in plan(counts, size):
        offset = 0
        for n in pattern:
            first = slots[n][-1][0] + slots[n][-1][3] if n in slots else 0
            slots.setdefault(n, []).append((first, base, offset, times))
            offset += n
        base += times
    shared = spark.sparkContext.broadcast({n: tuple(np.array(x, np.int64) for x in zip(*s)) for n, s in slots.items()})

    # A piece's number within its length: parts are numbered on their own, after the sizes of the parts before them.
    most = max(PART_ROWS, sum(counts.values()) // PARTS)
    in_parts = F.lit([-(-counts.get(n, 0) // most) for n in range(size + 1)])  # of each length
    part, number_name = unused("_part", *names), unused("_number", *names)
    parted = cut.withColumn(part, F.pmod(F.xxhash64(*names), F.greatest(F.element_at(in_parts, (F.col("length") + 1).cast("int")), F.lit(1)).cast("long")))
    sizes: dict[int, np.ndarray] = {n: np.zeros(-(-c // most) + 1, np.int64) for n, c in counts.items()}
    for r in parted.groupBy("length", F.col(part).alias("_part")).count().collect():  # at most size + PARTS rows
        sizes[r["length"]][r["_part"] + 1] = r["count"]
    before = spark.sparkContext.broadcast({n: np.cumsum(x) for n, x in sizes.items()})
    number = F.row_number().over(Window.partitionBy("length", part).orderBy(F.monotonically_increasing_id())) - 1
    numbered = parted.withColumn(number_name, number)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, parts, number = (b.column(c).to_numpy() for c in ("length", part, number_name))
            sequence, offset = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if b.num_rows else []:
                n = int(length[at[0]])
                first, base, place, _ = shared.value[n]
                r = number[at] + before.value[n][parts[at]]
                i = np.searchsorted(first, r, "right") - 1
                sequence[at], offset[at] = base[i] + r - first[i], place[i]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = dict(cut.dtypes)
    return full.unionByName(numbered.mapInArrow(place, "".join(f"`{c}` {kinds[c]}, " for c in names) + "sequence_id long, offset long"))


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """docs (with text) cut and packed: their other columns, the piece's columns, sequence_id and offset.

    Null and empty texts are one piece, the end id; long texts are cut into full
    pieces and a last one; repeated rows are packed as often as they are there;
    an empty table gives no sequence; columns named like the new ones are replaced.
    """
    return pack(materialize(pieces(docs, path, size, end_id, ids)), size)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
