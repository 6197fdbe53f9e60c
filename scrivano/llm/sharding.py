"""Sharding by a permutation-filled lookup table.

Each shard orders the slots of a table of prime size by a permutation of its own, offset + j * skip
modulo the size, both from a hash of its name.  Shards take turns; in its turn a shard claims the
first slot in its order that is free.  The table is filled on the driver (its size is a parameter,
at most MOST_SLOTS) and broadcast, so a document's shard is one look-up of its key's hash: no
shuffle, whatever the input.  When a shard leaves, few of the other slots change hands.

Defined results: a null key is placed by the text's hash, so rows without ids spread; equal keys go
to one shard; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
MOST_SLOTS = 1_000_003
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(*parts) -> int:
    return int.from_bytes(hashlib.sha256("\0".join(map(str, parts)).encode()).digest()[:8], "big")


def fill(shards=SHARDS, slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """For each slot the index of its shard.  A shard of weight w claims w slots a turn."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, each once")
    if slots > MOST_SLOTS or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime of at most {MOST_SLOTS}")
    at = [_number("offset", s) % slots for s in shards]
    skip = [_number("skip", s) % (slots - 1) + 1 for s in shards]
    turns = [(weights or {}).get(s, 1) for s in shards]
    if min(turns) < 0 or not sum(turns):
        raise ValueError("weights must not be negative, and one must be above 0")
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            for _ in range(turns[i]):
                if not free:
                    break
                while table[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                table[at[i]] = i
                free -= 1
    return table


def slot_of(key: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.when(key.isNull(), F.xxhash64(F.coalesce(text, F.lit("")))).otherwise(F.xxhash64(key)), F.lit(slots)).cast("int")


def place(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards=SHARDS, slots: int = SLOTS, weights=None) -> DataFrame:
    """df with columns slot and shard (replacing columns of these names)."""
    table = fill(shards, slots, weights)
    rows = df.sparkSession.createDataFrame([(i, shards[x]) for i, x in enumerate(table)], "slot int, shard string")
    kept = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(id_col), F.col(text_col), slots))
    return kept.join(F.broadcast(rows), "slot").select(*[c for c in kept.columns if c != "slot"], "slot", "shard")


def write_shards(df: DataFrame, path: str, files: int = 8, **kwargs) -> None:
    """Write each shard to a folder of its own, of about `files` files."""
    placed = place(df, **kwargs)
    placed.repartition(F.col("shard"), F.pmod(F.xxhash64(*placed.columns), F.lit(files))).write.partitionBy("shard").parquet(path)
