"""Shard placement by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized
table: ``(offset + j * step) mod size`` with offset and step taken from the
shard's name.  The shards take turns, each claiming its most preferred free
slot, until the table is full.  A key's slot is its hash modulo the size, so
that placement is one lookup; when a shard is added or removed only about its
share of the slots changes hands.

The table is filled on the driver from the shard names alone (``size`` steps,
independent of the data) and has ``size`` rows, a documented parameter: that
is the proven bound of what is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 8191
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _preference(name: str, size: int) -> tuple[int, int]:
    d = hashlib.md5(name.encode()).digest()
    return int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:], "big") % (size - 1) + 1


def fill_table(shards: Sequence[str], size: int = SIZE, turns: Mapping[str, int] | None = None) -> list[int]:
    """Index of the owning shard for each slot.

    ``turns`` gives a shard more than one claim per round (its weight).
    """
    if not _is_prime(size) or len(shards) > size:
        raise ValueError("the table size must be a prime of at least the number of shards")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    orders = [_preference(s, size) for s in shards]
    claims = [int((turns or {}).get(s, 1)) for s in shards]
    if min(claims) < 1:
        raise ValueError("every shard takes one turn at least")
    tried, owner, left = [0] * len(shards), [-1] * size, size
    while left:
        for i, (offset, step) in enumerate(orders):
            for _ in range(min(claims[i], left)):
                slot = (offset + tried[i] * step) % size
                while owner[slot] >= 0:
                    tried[i] += 1
                    slot = (offset + tried[i] * step) % size
                owner[slot], left = i, left - 1
    return owner


def key_slot(key: Column, size: int = SIZE) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text modulo the table size; a null key is the empty text."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint"), F.lit(size)).cast("int")


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int = SIZE, turns: Mapping[str, int] | None = None) -> DataFrame:
    """(__slot, __shard) rows, made by the JVM from one string."""
    text = ",".join(map(str, fill_table(shards, size, turns)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("__slot", "__owner")).select("__slot", F.col("__owner").cast("int").alias("__shard"))


def assign_shards(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = SIZE, turns: Mapping[str, int] | None = None, column: str = "shard") -> DataFrame:
    """``df`` with the shard index of each row in ``column`` (an existing column of that name is replaced).

    No row is shuffled: the table of ``size`` rows is broadcast.  Null keys
    share one slot, equal keys share a shard, an empty table gives no rows.
    """
    table = F.broadcast(lookup_table(df.sparkSession, shards, size, turns))
    keep = [c for c in df.columns if c != column]
    placed = df.select(*(F.col(f"`{c}`") for c in keep), key_slot(F.col(f"`{key}`"), size).alias("__slot"))
    return placed.join(table, "__slot").select(*(F.col(f"`{c}`") for c in keep), F.col("__shard").alias(column))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return assign_shards(docs).select("doc_id", key_slot(F.col("doc_id")).alias("slot"), "shard")


def oracle() -> str:
    """Placement in DuckDB; the table's content stands in the SQL as its owner list."""
    owners = ",".join(map(str, fill_table(SHARDS, SIZE)))
    return f"""
        WITH t AS (SELECT string_split('{owners}', ',') AS owners),
        d AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {SIZE} AS slot FROM documents)
        SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(owners[slot + 1] AS INTEGER) AS shard FROM d, t"""


QUERIES = {"op9_sharding": op9_sharding}
ORACLES = {"op9_sharding": oracle()}
