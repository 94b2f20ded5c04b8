"""Placement of rows on shards by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: offset, offset + skip, offset + 2 * skip...
Shards take turns, and each claims its first free slot; a shard of weight w takes w turns a round. A key goes to the slot of its
hash, so placement is one look into a broadcast table of fixed size. A shard that joins or leaves moves
few keys besides its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The default table size, a prime; over 100 slots for each of up to 655 shards keep shares within about 1 %.
SLOTS = 65_537


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[str], slots: int = SLOTS, weights: Mapping[str, int] | None = None) -> list[int]:
    """For each slot the index of its shard in sorted(shards); empty without shards."""
    if not is_prime(slots):
        raise ValueError("the number of slots must be prime")
    if len(set(shards)) != len(shards):
        raise ValueError("shards repeat")
    if len(shards) > slots:
        raise ValueError("more shards than slots")
    names = sorted(shards)
    turns = [i for i, s in enumerate(names) for _ in range((weights or {}).get(s, 1))]
    if not turns:
        return []
    start = [_hash(f"offset:{s}") % slots for s in names]
    skip = [_hash(f"skip:{s}") % (slots - 1) + 1 for s in names]
    table, left = [-1] * slots, slots
    at = list(start)
    while left:
        for i in turns:
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key; null counts as the text 'null'."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS, weights: Mapping[str, int] | None = None) -> DataFrame:
    """df with the columns slot and shard; columns of df by these names are replaced.

    Rows of equal keys share a shard, null keys too. Without shards the shard is null.
    """
    names, spark = sorted(shards), df.sparkSession
    rows = [(slot, names[i]) for slot, i in enumerate(fill(shards, slots, weights))]
    lookup = spark.createDataFrame(rows, "slot int, shard string")  # at most `slots` rows, whatever the data
    return df.drop("shard").withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(lookup), "slot", "left")


def write_shards(df: DataFrame, key: str, shards: Sequence[str], path: str, files_per_shard: int = 1, **options) -> None:
    """Writes df as Parquet with a folder for each shard, in files_per_shard files at most.

    A shard's rows are spread over its files by the hash of the whole row, so that a hot key isn't one task's; rows that repeat
    whole stay, and null keys go to a shard like any other. An empty table gives no folders. Without shards there is nowhere to write: ValueError.
    """
    if not shards:
        raise ValueError("no shards")
    placed = place(df, key, shards, **options)
    number = F.array_position(F.array(*(F.lit(s) for s in sorted(shards))), F.col("shard")).cast("int") - 1
    whole = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard"))))
    part = number * files_per_shard + F.pmod(F.xxhash64(whole), F.lit(files_per_shard)).cast("int")
    placed.repartitionById(len(shards) * files_per_shard, part).write.partitionBy("shard").mode("overwrite").parquet(path)


def oracle(shards: Sequence[str], slots: int = SLOTS) -> str:
    """DuckDB SQL for doc_id, slot and shard of place() over the view documents; the lookup table is given as text, and tests fill it in another way."""
    names, table = sorted(shards), fill(shards, slots)
    return f"""WITH held AS (SELECT unnest(range({slots})) AS slot, unnest(string_split('{",".join(map(str, table))}', ',')) AS i),
named AS (SELECT unnest(range({len(names)})) AS i, unnest({names}) AS shard),
d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) % {slots} AS INTEGER) AS slot FROM documents)
SELECT doc_id, d.slot, shard FROM d JOIN held ON held.slot = d.slot JOIN named ON named.i = CAST(held.i AS BIGINT)"""
