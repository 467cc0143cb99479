"""N-gram language model in sharded Elias-Fano tries.

Words, contexts (the two tokens before a token) and their successors are counted
over all training texts. The word level is a sorted Elias-Fano sequence of word
hashes with their counts. A shard of the levels below has a range of context
hashes as a trie: sorted contexts, which are the bigrams, monotone pointers to
each one's successors, the trigrams, and successors numbered relative to their
context, all as Elias-Fano sequences beside one byte each for quantised values.
A lookup finds the context, then searches its own range for the successor.

With c counts, N training tokens and V distinct ones:

    p1(w)      = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p2(w | v)  = (c(v w) + MU p1(w)) / (c(v) + MU)
    p(w | u v) = kept(u v w) + rest(u v) p2(w | v)

kept is c(u v w) / (c(u v) + NU) for trigrams seen min_count times or more, and
rest, the weight of backing off, is what the kept ones leave, so each
distribution sums to one but for the rounding of its quantised values. By
default all trigrams are kept, from count 1 on. A bigram's level holds its
quantised count, not p2: the count of its first word lies in another shard and
meets it when a text is scored.

Texts are cut into blocks; each block sends its distinct n-grams, with training
counts, once to the shards, which add them up, build their tries and answer the
same n-grams (`score`). A model can also be kept: `learn` gives its levels as a
table, and `score_with` scores texts by such a table.
"""

from __future__ import annotations

import json
import mmap
import tempfile
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.frames import crc_remainder, each_block, materialize, shard_count, text_blocks, unused
from larkspur.llm.text import Words, cuts, mix, pack, unpack

MU, NU, MIN_COUNT = 50.0, 3.0, 1
#: Text bytes whose n-grams one shard has.
SHARD_BYTES = 12 << 20
#: The word level has this part of the shards of the levels below, WORD_SHARDS at least: it is far smaller.
WORD_PART, WORD_SHARDS = 8, 16
#: Bits of a successor's number within its context; a context's hash has the other bits of 64.
RELATIVE_BITS = 24
#: Hashes of the end of a text, of what stands before its first token and after its end.
END, BEGIN, AFTER = (np.uint64(x) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0xDA942042E4DD58B5))
_REL = np.uint64(RELATIVE_BITS)
_AFTER = AFTER >> np.uint64(64 - RELATIVE_BITS)
_BIT_COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_FIVES, _THREES, _LOW_HALVES, _EACH_BYTE, _TOP_BITS = (np.uint64(int(x * 8, 16)) for x in ("55", "33", "0f", "01", "80"))
_BIT_PLACE = np.array([([b for b in range(8) if i >> b & 1] + [0] * 8)[:8] for i in range(256)], np.uint8)


class EliasFano:
    """A monotone sequence of integers below 2**64: low bits packed, high parts in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.before = n, low_bits, low, high, before

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values, n = np.asarray(values, np.uint64), len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, min(56, (top // max(1, n)).bit_length() - 1))
        high = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((int(high[-1]) // 64 + 1) * 64 if n else 64, np.uint8)
        flags[high] = 1
        packed = np.packbits(flags, bitorder="little")
        low = np.zeros((n * bits + 63) // 64 * 8 + 16, np.uint8)
        if bits and n:
            parts = [np.unpackbits(values[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits].ravel() for i in range(0, n, 1 << 16)]
            each = np.concatenate(parts)
            data = np.packbits(each.ravel(), bitorder="little")
            low[: len(data)] = data
        ones = _BIT_COUNT[packed].reshape(-1, 8).sum(1, dtype=np.int64)
        return cls(n, bits, low.view("<u8"), packed, np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "before": self.before}

    def _select(self, i: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the i-th (from 0) bit that is set, or isn't, in the unary part."""
        before = self.before if ones else self.zeros_before
        word = np.searchsorted(before, i, "right") - 1
        x = self.high.view("<u8")[word]
        x = x if ones else ~x
        left = (i - before[word]).astype(np.uint64)
        b = x - ((x >> np.uint64(1)) & _FIVES)  # set bits of each byte, then of it and those before
        b = (b & _THREES) + ((b >> np.uint64(2)) & _THREES)
        b = (((b + (b >> np.uint64(4))) & _LOW_HALVES) * _EACH_BYTE).astype(np.uint64)
        byte = (((((left * _EACH_BYTE) | _TOP_BITS) - b) & _TOP_BITS) >> np.uint64(7)) * _EACH_BYTE >> np.uint64(56)
        shift = byte << np.uint64(3)
        left -= ((b << np.uint64(8)) >> shift) & np.uint64(255)
        bits = (x >> shift) & np.uint64(255)
        return word * 64 + shift.astype(np.int64) + _BIT_PLACE[bits.astype(np.int64), left.astype(np.int64)]

    @cached_property
    def zeros_before(self) -> np.ndarray:
        return (np.arange(len(self.before)) * 64 - self.before).astype(np.uint32)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i."""
        i = np.asarray(i, np.int64)
        value = (self._select(i, True) - i).astype(np.uint64)
        if self.low_bits:
            at = i * self.low_bits
            shift = (at & 63).astype(np.uint64)
            low = self.low[at >> 6] >> shift
            carry = np.where(shift > 0, self.low[(at >> 6) + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
            value = value << np.uint64(self.low_bits) | (low | carry) & np.uint64((1 << self.low_bits) - 1)
        return value

    def successor(self, wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each wanted value the first place in [lo, hi) whose value isn't below it; hi if none.

        The zeros of the unary part bound the places that have the same high part; few are left to search.
        """
        high = np.minimum(wanted >> np.uint64(self.low_bits), np.uint64(1 << 62)).astype(np.int64)
        last = int(self.zeros_before[-1])  # zeros there are: padding counts as high parts without values
        inside = np.minimum(high, last - 1)
        start = np.where(inside > 0, self._select(np.maximum(inside - 1, 0), False) - inside + 1, 0)
        end = self._select(inside, False) - inside
        beyond = high > inside
        lo = np.clip(np.where(beyond, self.n, start), lo, hi)
        hi = np.clip(np.where(beyond, self.n, end), lo, hi)
        while len(busy := np.flatnonzero(lo < hi)):
            mid = (lo[busy] + hi[busy]) >> 1
            less = self[mid] < wanted[busy]
            lo[busy[less]], hi[busy[~less]] = mid[less] + 1, mid[~less]
        return lo


#: Quantised values: byte 0 is 0, 255 is 1, between them powers down to 10**-QUANT.
QUANT = 8.0
_VALUES = np.concatenate([[0.0], 10 ** (-(255 - np.arange(1, 256)) * QUANT / 254)])
#: Quantised counts: exact to 32, then 8 % apart.
_COUNTS = np.concatenate([np.arange(33.0), 32 * 1.08 ** np.arange(1, 223)])


def quantise(x: np.ndarray) -> np.ndarray:
    code = np.rint(255 + 254 / QUANT * np.log10(np.maximum(x, 10**-QUANT)))
    return np.where(x > 0, np.clip(code, 1, 255), 0).astype(np.uint8)


def quantise_count(c: np.ndarray) -> np.ndarray:
    code = np.where(c <= 32, c, np.minimum(254, 32 + np.rint(np.log(np.maximum(c, 1) / 32) / np.log(1.08))))
    return code.astype(np.uint8)


def _stored(base: int, sequences: dict[str, EliasFano], arrays: dict[str, np.ndarray]) -> bytes:
    """Sequences and arrays in one buffer, behind a header that names their places."""
    arrays = arrays | {f"{k}.{a}": x for k, s in sequences.items() for a, x in s.arrays().items()}
    at, where = 0, {}
    for name, x in arrays.items():
        where[name] = [at, len(x), x.dtype.str]
        at += -(-x.nbytes // 8) * 8
    head = {"base": base, "sequences": {k: [s.n, s.low_bits] for k, s in sequences.items()}, "arrays": where}
    size = 4096
    while True:  # the header names places behind itself
        text = json.dumps(head | {"arrays": {k: [p + 8 + size, n, t] for k, (p, n, t) in where.items()}}).encode()
        if len(text) <= size:
            break
        size *= 2
    out = bytearray(8 + size + at)
    out[:8] = size.to_bytes(8, "little")
    out[8 : 8 + size] = text.ljust(size)
    for name, x in arrays.items():
        out[8 + size + where[name][0] : 8 + size + where[name][0] + x.nbytes] = x.tobytes()
    return bytes(out)


class Level:
    """Sequences and arrays, read from one buffer (a memory map, a file or bytes)."""

    def __init__(self, buffer):
        size = int.from_bytes(bytes(buffer[:8]), "little")
        head = json.loads(bytes(buffer[8 : 8 + size]))
        get = lambda name: np.frombuffer(buffer, head["arrays"][name][2], head["arrays"][name][1], head["arrays"][name][0])
        self.base = np.uint64(head["base"])
        for name, (n, bits) in head["sequences"].items():
            setattr(self, name, EliasFano(n, bits, get(f"{name}.low"), get(f"{name}.high"), get(f"{name}.before")))
        for name in head["arrays"]:
            if "." not in name:
                setattr(self, name, get(name))

    @classmethod
    def mapped(cls, data: bytes):
        """The level as a memory map of an unnamed file, which goes when the level goes."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def places(self, sequence: EliasFano, wanted: np.ndarray) -> np.ndarray:
        """The place in a sequence, which counts from base, of each sorted value; -1 where it isn't there."""
        at = np.full(len(wanted), -1, np.int64)
        inside = np.flatnonzero(wanted >= self.base)
        if sequence.n and len(inside):
            found = sequence.successor(wanted[inside] - self.base, np.zeros(len(inside), np.int64), np.full(len(inside), sequence.n))
            here = found < sequence.n
            inside, found = inside[here], found[here]
            same = sequence[found] + self.base == wanted[inside]
            at[inside[same]] = found[same]
        return at


class WordLevel(Level):
    """Words and their training counts."""

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray) -> bytes:
        """The level of sorted distinct words; those without a count are left out."""
        keys, counts = keys[counts > 0], counts[counts > 0]
        base = int(keys[0]) if len(keys) else 0
        return _stored(base, {"words": EliasFano.build(keys - np.uint64(base))}, {"count": counts.astype(np.uint64)})

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The count of each sorted word."""
        at = self.places(self.words, keys)
        return np.where(at >= 0, self.count[np.maximum(at, 0)] if len(self.count) else 0, 0).astype(np.uint64)


class Trie(Level):
    """Contexts and their kept successors."""

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray, min_count: int = MIN_COUNT) -> bytes:
        """The trie of sorted distinct (context | relative successor) keys with training counts; successors seen min_count (1 at least) times are kept."""
        context = keys >> _REL
        begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
        total = np.add.reduceat(counts, begin) if len(begin) else np.zeros(0, np.int64)
        keep = (counts >= max(1, min_count)) & (keys & np.uint64((1 << RELATIVE_BITS) - 1) != _AFTER)
        kept_sum = np.add.reduceat(np.where(keep, counts, 0), begin) if len(begin) else total
        of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(keys))))
        seen = total > 0
        rank = np.cumsum(seen) - 1
        keep &= seen[of]
        ends = np.concatenate([[0], np.cumsum(np.bincount(rank[of[keep]], minlength=int(seen.sum())))])
        base = int(context[begin[seen][0]]) if seen.any() else 0
        relative = keys[keep] & np.uint64((1 << RELATIVE_BITS) - 1)
        sequences = {
            "contexts": EliasFano.build(context[begin[seen]] - np.uint64(base)),
            "pointers": EliasFano.build(ends),
            "successors": EliasFano.build((rank[of[keep]].astype(np.uint64) << _REL) | relative),
        }
        arrays = {
            "count": quantise_count(total[seen]), "rest": quantise((total[seen] + NU - kept_sum[seen]) / (total[seen] + NU)),
            "kept": quantise(counts[keep] / (total[of[keep]] + NU)),
        }
        return _stored(base, sequences, arrays)

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted keys: for each distinct context its count and rest bytes (unknown: 0 and 255), for each key its kept byte."""
        context = keys >> _REL
        begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
        wanted = context[begin]
        n = self.contexts.n
        count, rest, kept = np.zeros(len(begin), np.uint8), np.full(len(begin), 255, np.uint8), np.zeros(len(keys), np.uint8)
        if not n:
            return count, rest, kept
        at = self.places(self.contexts, wanted)
        found = np.flatnonzero(at >= 0)
        count[found], rest[found] = self.count[at[found]], self.rest[at[found]]
        known = np.zeros(len(begin), bool)
        known[found] = True
        of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(keys))))
        ask = np.flatnonzero(known[of])
        node = at[of[ask]]
        lo, hi = self.pointers[node].astype(np.int64), self.pointers[node + 1].astype(np.int64)
        some = lo < hi
        ask, node, lo, hi = ask[some], node[some], lo[some], hi[some]
        target = (node.astype(np.uint64) << _REL) | (keys[ask] & np.uint64((1 << RELATIVE_BITS) - 1))
        place = self.successors.successor(target, lo, hi)
        hit = np.flatnonzero(place < hi)
        hit = hit[self.successors[place[hit]] == target[hit]]
        kept[ask[hit]] = self.kept[place[hit]]
        return count, rest, kept


class _Tokens:
    """The tokens of a block's texts (words, then an end), the pairs before and with them, and the block's distinct n-grams."""

    def __init__(self, texts):
        words = Words(texts, lower=True)
        rows = len(words.counts)
        self.sizes = words.counts + 1
        self.begin = words.bounds[:-1] + np.arange(rows)
        self.token = np.insert(words.hash, words.bounds[1:], END) if rows else words.hash
        before = np.roll(self.token, 1)
        before[self.begin] = BEGIN
        two = np.roll(before, 1)
        two[self.begin] = BEGIN
        pair = lambda a, b: mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b)) >> _REL
        relative = self.token >> np.uint64(64 - RELATIVE_BITS)
        last = self.begin + self.sizes - 1
        keys = (pair(two, before) << _REL) | relative
        self.all_keys = np.concatenate([keys, (pair(before[last], self.token[last]) << _REL) | _AFTER])  # a text's last pair is counted as a context too

    def grams(self, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, how often texts that are learned from have each, and the place of each key of all_keys."""
        return _counted(self.all_keys, np.concatenate([np.repeat(learn, self.sizes), learn]))

    def words(self, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct tokens, and what stands before a text, with training counts, and the place of each token, then of BEGIN."""
        return _counted(np.append(self.token, np.full(len(learn), BEGIN)), np.concatenate([np.repeat(learn, self.sizes), learn]))


def _counted(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, weight = keys[order], weight[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    begin = np.flatnonzero(new)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[begin], np.add.reduceat(weight.astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64), place


def _learn_flags(batch: pa.RecordBatch, flag: str) -> np.ndarray:
    return batch.column("rows")[0].values.field(flag).to_numpy(zero_copy_only=False).astype(bool)


def _requests(blocks: DataFrame, shards: tuple[int, int], flag: str) -> DataFrame:
    """(kind, shard, block, keys, counts) of each block: words (kind 0) and n-grams (kind 1), sorted, cut by range."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in each_block(batches):
            tokens, learn = _Tokens(texts), _learn_flags(b, flag)
            for kind, (keys, counts, _) in enumerate((tokens.words(learn), tokens.grams(learn))):
                at = cuts(keys, shards[kind])
                filled = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([kind] * len(filled), pa.int32()), pa.array(filled, pa.int32()), pa.array([b.column("block")[0].as_py()] * len(filled), pa.int64()),
                        pa.array([pack(keys[at[s] : at[s + 1]], ordered=True) for s in filled], pa.binary()), pa.array([pack(counts[at[s] : at[s + 1]].astype(np.uint32)) for s in filled], pa.binary()),
                    ],
                    ["kind", "shard", "block", "keys", "counts"],
                )

    return blocks.mapInArrow(ask, "kind int, shard int, block long, keys binary, counts binary")


def _summed(table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, their summed counts, and the place of each part's keys among them."""
    parts = [unpack(x.as_py(), np.uint64, ordered=True) for x in table["keys"]]
    keys, counts = np.concatenate(parts), np.concatenate([unpack(x.as_py(), np.uint32) for x in table["counts"]]).astype(np.int64)
    order = np.argsort(keys, kind="stable")  # merges sorted parts
    keys, counts = keys[order], counts[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    return keys[begin], np.add.reduceat(counts, begin), np.split(place, np.cumsum([len(p) for p in parts])[:-1])


def _shards(blocks: DataFrame) -> tuple[int, int]:
    """Shards of the word level and of the levels below."""
    n = shard_count(blocks, SHARD_BYTES)
    return min(n, max(WORD_SHARDS, n // WORD_PART)), n


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[int, int]:
    """Training tokens and distinct ones among a shard's words."""
    real = (keys != BEGIN) & (counts > 0)
    return int(counts[real].sum()), int(real.sum())


def _looked_up(kind: int, keys: np.ndarray, places: list[np.ndarray], level: bytes) -> list[tuple]:
    """(a, b, c) for each block: its words' counts, or its contexts' and trigrams' bytes; each n-gram is looked up once, for all blocks that have it."""
    if kind == 0:
        count = WordLevel.mapped(level).lookup(keys)
        return [(pack(count[p]), None, None) for p in places]
    count, rest, kept = Trie.mapped(level).lookup(keys)
    context = np.cumsum(np.concatenate([[False], (keys[1:] >> _REL) != (keys[:-1] >> _REL)]))
    rows = []
    for p in places:
        of = context[p]
        first = of[np.concatenate([[True], of[1:] != of[:-1]])]
        rows.append((pack(count[first]), pack(rest[first]), pack(kept[p])))
    return rows


ANSWERS = "block long, kind int, shard int, a binary, b binary, c binary, tokens long, distinct long"


def _answer_table(blocks: list[int], kind: int, shard: int, rows: list[tuple], sums: tuple[int, int]) -> pa.Table:
    """ANSWERS: what is found for each block, and, as block -1, the shard's sums."""
    rows, n = [*rows, (None, None, None)], len(rows) + 1
    return pa.table({
        "block": pa.array([*blocks, -1], pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()),
        **{c: pa.array([r[i] for r in rows], pa.binary()) for i, c in enumerate("abc")},
        "tokens": pa.array([0] * (n - 1) + [sums[0]], pa.int64()), "distinct": pa.array([0] * (n - 1) + [sums[1]], pa.int64()),
    })


def _answer(requests: DataFrame, min_count: int) -> DataFrame:
    """ANSWERS of requests by the model of their own training counts."""

    def answer(key, table):
        kind, shard = key[0].as_py(), key[1].as_py()
        keys, counts, places = _summed(table)
        level = WordLevel.build(keys, counts) if kind == 0 else Trie.build(keys, counts, min_count)
        return _answer_table(table["block"].to_pylist(), kind, shard, _looked_up(kind, keys, places, level), _sums(keys, counts) if kind == 0 else (0, 0))

    return requests.groupBy("kind", "shard").applyInArrow(answer, ANSWERS)


def _rated(blocks: DataFrame, answers: DataFrame, docs: DataFrame, text: str, flag: str) -> DataFrame:
    """docs without text and flag, with the five figures, from written answers."""
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep, kinds = [c for c in docs.columns if c not in (text, flag)], dict(docs.dtypes)
    total, distinct = (x or 0 for x in answers.where("block = -1").agg(F.sum("tokens"), F.sum("distinct")).first())
    each = answers.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "a", "b", "c")).alias("answers"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in each_block(batches):
            tokens, learn = _Tokens(texts), _learn_flags(b, flag)
            parts = sorted(b.column("answers")[0].as_py() or (), key=lambda x: (x["kind"], x["shard"]))
            joined = lambda kind, column, dtype: np.concatenate([np.zeros(0, dtype), *(unpack(x[column], dtype) for x in parts if x["kind"] == kind)])
            n, first = len(tokens.token), tokens.begin
            _, _, at = tokens.words(learn)
            count = joined(0, "a", np.uint64).astype(np.int64)
            c = count[at[:n]]
            c_before = np.roll(c, 1)
            c_before[first] = count[at[n:]]
            grams, _, gram = tokens.grams(learn)
            context = np.cumsum(np.concatenate([[True], (grams[1:] >> _REL) != (grams[:-1] >> _REL)]))[gram] - 1 if n else gram
            pair = np.roll(context[:n], -1)  # what stands before a token is its successor's context
            pair[first + tokens.sizes - 1] = context[n:]
            pairs, rest, kept = _COUNTS[joined(1, "a", np.uint8)], _VALUES[joined(1, "b", np.uint8)], _VALUES[joined(1, "c", np.uint8)]
            p1 = (c + 0.5) / (total + 0.5 * (distinct + 1))
            p2 = (np.minimum(pairs[pair], c_before) + MU * p1) / (c_before + MU)
            p = kept[gram[:n]] + rest[context[:n]] * p2
            add = lambda x: np.add.reduceat(x, tokens.begin) if len(tokens.begin) else x[:0]
            rows = b.column("rows")[0].values
            yield pa.RecordBatch.from_arrays(
                [*(rows.field(k) for k in keep), pa.array(tokens.sizes.astype(np.int64)), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(rows), total, np.int64)), pa.array(add(np.log10(p1))), pa.array(add(np.log10(p)))],
                [*keep, *new],
            )

    return blocks.join(each, "block", "left").mapInArrow(rate, "".join(f"`{k}` {kinds[k]}, " for k in keep) + "n_tokens long, n_known long, train_tokens long, base_score double, score double")


_NEW = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, learn: Column, text: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """docs without text, with n_tokens, n_known, train_tokens, base_score and score, by a model of the rows where `learn` is true.

    Scores are log10 probabilities of whole texts, lower-cased in A-Z; a null
    or empty text is its end alone. A null `learn` is false; repeated rows count
    as often as they are there; with nothing to learn from all counts are 0; an
    empty table stays empty. Columns of docs named like the new ones are
    replaced. Trigrams seen less than min_count times are scored by their bigram.
    """
    flag = unused("_learn", *docs.columns)
    docs = docs.withColumn(flag, F.coalesce(learn, F.lit(False))).drop(*_NEW)
    blocks = text_blocks(docs, text)
    answers = materialize(_answer(_requests(blocks, _shards(blocks), flag), min_count))
    return _rated(blocks, answers, docs, text, flag)


def learn(docs: DataFrame, text: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(kind, shard, shards, level, tokens, distinct): a model of all docs; kind 0 is the word level, kind 1 a trie of contexts and successors.

    Write it to keep it. WordLevel(bytes) and Trie(bytes) read a level, from a
    memory map as well. Texts are as in `score`.
    """
    flag = unused("_learn", *docs.columns)
    blocks = text_blocks(docs.select(text, F.lit(True).alias(flag)), text)
    shards = _shards(blocks)

    def build(key, table):
        kind, shard = key[0].as_py(), key[1].as_py()
        keys, counts, _ = _summed(table)
        level = WordLevel.build(keys, counts) if kind == 0 else Trie.build(keys, counts, min_count)
        tokens, distinct = _sums(keys, counts) if kind == 0 else (0, 0)
        return pa.table({
            "kind": pa.array([kind], pa.int32()), "shard": pa.array([shard], pa.int32()), "shards": pa.array([shards[kind]], pa.int32()), "level": pa.array([level], pa.binary()),
            "tokens": pa.array([tokens], pa.int64()), "distinct": pa.array([distinct], pa.int64()),
        })

    return _requests(blocks, shards, flag).groupBy("kind", "shard").applyInArrow(build, "kind int, shard int, shards int, level binary, tokens long, distinct long")


def score_with(docs: DataFrame, model: DataFrame, text: str = "text") -> DataFrame:
    """docs scored as `score` does, by a kept model (a written table of `learn`).

    Each n-gram of a block of texts is sent to its shard and looked up there once.
    """
    flag = unused("_learn", *docs.columns)
    docs = docs.withColumn(flag, F.lit(False)).drop(*_NEW)
    blocks = text_blocks(docs, text)
    cut = {r["kind"]: r["shards"] for r in model.groupBy("kind").agg(F.max("shards").alias("shards")).collect()}  # two rows

    def answer(key, asked, kept):
        if not len(asked) and not len(kept):
            return pa.table({})
        kind, shard = key[0].as_py(), key[1].as_py()
        level = kept["level"][0].as_py() if len(kept) else (WordLevel if kind == 0 else Trie).build(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        sums = (kept["tokens"][0].as_py(), kept["distinct"][0].as_py()) if len(kept) else (0, 0)
        keys, _, places = _summed(asked) if len(asked) else (np.zeros(0, np.uint64), None, [])
        return _answer_table(asked["block"].to_pylist() if len(asked) else [], kind, shard, _looked_up(kind, keys, places, level), sums)

    asked = _requests(blocks, (cut.get(0, 1), cut.get(1, 1)), flag).groupBy("kind", "shard")
    answers = materialize(asked.cogroup(model.groupBy("kind", "shard")).applyInArrow(answer, ANSWERS))
    return _rated(blocks, answers, docs, text, flag)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (crc_remainder("doc_id", 5) == 1).alias("held_out"))
    return score(docs, ~F.col("held_out"))
