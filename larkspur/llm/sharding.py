"""Shard placement by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table and the
shards take turns claiming the first free slot of their own.  A key goes to the
shard that owns slot ``hash(key) mod size``: one broadcast join, no shuffle, and
few keys move when a shard leaves.  The table has ``size`` rows whatever the
data, so the broadcast is bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.frames import unused

#: Hex digits of the MD5 that make a hash: 60 bits, a positive BIGINT.
HEX_DIGITS = 15


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HEX_DIGITS], 16)


def permutation(shard: str, size: int) -> tuple[int, int]:
    """First slot and step of a shard's preference order."""
    return _number(f"offset:{shard}") % size, _number(f"skip:{shard}") % (size - 1) + 1


def fill(shards: Sequence[str], size: int) -> list[int]:
    """The owner (its index) of each slot. Sizes must be prime and not below the number of shards.

    The order of `shards` is the order of turns; repeated names are an error.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if size < max(2, len(shards)) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime, not below the number of shards")
    orders = [permutation(s, size) for s in shards]
    owner, turns, claimed = [-1] * size, [0] * len(shards), 0
    while True:
        for i, (offset, skip) in enumerate(orders):
            while owner[slot := (offset + turns[i] * skip) % size] >= 0:
                turns[i] += 1
            owner[slot] = i
            claimed += 1
            if claimed == size:
                return owner


def table(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    """(slot, shard), one row for each slot."""
    owners = F.lit([shards[k] for k in fill(shards, size)])
    return spark.range(size).select(F.col("id").alias("slot"), F.element_at(owners, (F.col("id") + 1).cast("int")).alias("shard"))


def slot_of(keys: Sequence[str | Column], size: int) -> Column:
    """The slot of a row. Null key parts count as empty; parts are set apart by a unit separator."""
    text = F.concat_ws("\x1f", *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, HEX_DIGITS), 16, 10).cast("bigint"), F.lit(size))


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str], size: int, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """df with each row's slot and shard.

    Null keys, and repeated rows, go where their text goes; empty tables stay
    empty; columns of df named like `slot` or `shard` are replaced.
    """
    names = [c for c in df.columns if c.lower() not in (slot.lower(), shard.lower())]
    key, owned, owner = (unused(x, *df.columns) for x in ("_key_slot", "_owned_slot", "_owner"))
    owners = table(df.sparkSession, shards, size).select(F.col("slot").alias(owned), F.col("shard").alias(owner))
    out = df.withColumn(key, slot_of(keys, size)).join(F.broadcast(owners), F.col(key) == F.col(owned))
    return out.select(*names, F.col(key).alias(slot), F.col(owner).alias(shard))


#: Parameters of the registered query.
SHARDS = [f"shard-{i:02d}" for i in range(16)]
SIZE = 2003
DRAINED = "shard-07"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document goes, and where it goes once a shard is drained."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    now = place(docs, ["doc_id"], SHARDS, SIZE)
    later = place(now, ["doc_id"], [s for s in SHARDS if s != DRAINED], SIZE, slot="slot_later", shard="shard_later")
    return later.select("doc_id", "slot", "shard", "shard_later", (F.col("shard") != F.col("shard_later")).alias("moved"))


def _fill_sql(name: str, shards: Sequence[str], size: int) -> str:
    """A recursive table of the free slots: each turn the shard's most preferred one is claimed."""
    rows = ", ".join(f"({i}, '{s}', {o}, {k})" for i, s in enumerate(shards) for o, k in [permutation(s, size)])
    inverses = ", ".join(f"({i}, {pow(permutation(s, size)[1], -1, size)})" for i, s in enumerate(shards))
    return f"""{name}_shards(i, shard, first_slot, step) AS (VALUES {rows}), {name}_inverse(i, inverse) AS (VALUES {inverses}),
{name}(turn, slot, claimed) AS (
  SELECT -1, CAST(range AS BIGINT), CAST(-1 AS BIGINT) FROM range({size})
  UNION ALL
  SELECT f.turn + 1, f.slot, arg_min(f.slot, ((f.slot - s.first_slot + {size}) * v.inverse) % {size}) OVER ()
  FROM {name} f JOIN {name}_shards s ON s.i = (f.turn + 1) % {len(shards)} JOIN {name}_inverse v ON v.i = s.i
  WHERE f.slot <> f.claimed
), {name}_owner AS (SELECT slot, shard FROM {name} JOIN {name}_shards ON i = turn % {len(shards)} WHERE slot = claimed AND turn >= 0)"""


ORACLE_SQL = f"""WITH RECURSIVE {_fill_sql("now_fill", SHARDS, SIZE)},
{_fill_sql("later_fill", [s for s in SHARDS if s != DRAINED], SIZE)},
d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {HEX_DIGITS}) AS BIGINT) % {SIZE} AS slot FROM documents)
SELECT d.doc_id, d.slot, a.shard, b.shard AS shard_later, a.shard <> b.shard AS moved
FROM d JOIN now_fill_owner a ON a.slot = d.slot JOIN later_fill_owner b ON b.slot = d.slot"""
