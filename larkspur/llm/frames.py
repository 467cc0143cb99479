"""Shared Spark helpers: scratch tables, blocks of rows, renamed columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Python call handles at a time.
BLOCK_BYTES = 3 << 20
#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 8 << 20
_CODEC = pa.Codec("zstd", 3)


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Where that is unset, a local session takes a local folder; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/larkspur-checkpoints"
    return f"{base.rstrip('/')}/larkspur-{uuid.uuid4().hex}"


def unused(name: str, *taken: str) -> str:
    """name, or it after as many underscores as no taken name has, whatever their case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, the files of a shuffle go as soon as the job that made them ends; for jobs whose tables are written once and read back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bound_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of its session bounded to BATCH_BYTES: a task holds a batch in Java and in Python at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("b")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def text_blocks(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs as a written table of blocks: block (a number), rows (their other columns), sizes and data (texts in bytes, compressed).

    Each task fills its blocks one after another, without a shuffle; a block
    has about block_bytes of text and one row at least, so memory follows the
    block and the longest text. Null texts are empty. A block keeps its number,
    whatever reads it later.
    """
    keep = [c for c in docs.columns if c != text]
    kinds, own = dict(docs.dtypes), unused("_text", *docs.columns)
    rows = "struct<" + ", ".join(f"`{c}`: {kinds[c]}" for c in keep) + ">"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            t = pa.Table.from_batches(held).combine_chunks()
            texts = t[own].combine_chunks() if t[own].num_chunks else pa.array([], pa.large_binary())
            at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = texts.buffers()[2].slice(at[0], at[-1] - at[0]) if at[-1] > at[0] else pa.py_buffer(b"")
            structs = pa.StructArray.from_arrays([t[c].combine_chunks() for c in keep], keep)
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | n]), pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs), pa.array([np.diff(at)], pa.list_(pa.int64())), pa.array([_compress(data)], pa.binary())],
                ["block", "rows", "sizes", "data"],
            )

        for batch in batches:
            texts = batch.column(own).cast(pa.large_binary()).fill_null(b"")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0, np.int64)
            b = pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], [*keep, own])
            at = 0
            while at < b.num_rows:
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + block_bytes - size, "right")))
                held.append(b.slice(at, to - at))
                size += int(ends[to - 1] - before)
                at = to
                if size >= block_bytes * 7 // 8:
                    yield block()
                    n, held, size = n + 1, [], 0
        if held:
            yield block()

    source = bound_batches(docs).select(*keep, F.col(text).alias(own))
    return materialize(source.mapInArrow(gather, f"block long, rows array<{rows}>, sizes array<long>, data binary"))


def _compress(data) -> bytes:
    return _CODEC.compress(data, asbytes=True)


def block_texts(data, sizes) -> pa.Array:
    """The texts of a block, as Arrow bytes."""
    sizes = np.asarray(sizes.values, np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    plain = _CODEC.decompress(data.as_buffer(), int(at[-1])) if at[-1] else pa.py_buffer(b"")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), plain])


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Blocks one by one: a batch of one row, and its texts."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1), block_texts(batch.column("data")[i], batch.column("sizes")[i])


def block_bytes_of(blocks: DataFrame) -> int:
    """Bytes of text in all blocks."""
    return blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0


def shard_count(blocks: DataFrame, shard_bytes: int, text_bytes: int | None = None) -> int:
    """Shards that get what shard_bytes of text make, one at least for each shuffle partition."""
    partitions = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, -(-(block_bytes_of(blocks) if text_bytes is None else text_bytes) // shard_bytes))


def values(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows as a table of SQL literals, which never leave the JVM; ddl as in "id bigint, name string"."""
    names = [part.split()[0] for part in ddl.split(", ")]
    kinds = [part.split()[1] for part in ddl.split(", ")]
    each = [F.struct(*[F.lit(x).cast(t).alias(n) for x, n, t in zip(row, names, kinds)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*each)))


def crc_remainder(column, divisor: int):
    """crc32 of a key written as text, modulo divisor; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))
