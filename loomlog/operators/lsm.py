"""Multi-version sorted tables: merges with tombstones, scans, compaction, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.hashing import MASK32, fnv1a64

DELETE, PUT = 0, 1
# Bits a key, the least number of bits, and probes of a Bloom filter.
BITS_A_KEY, LEAST_BITS, PROBES = 10, 64, 7


def sources(log: DataFrame, width: int) -> DataFrame:
    """(source_rank, key, kind, value): a table for each `width` of idx, the newest with rank 0, each with the newest version of its keys."""
    cut = log.where(F.col("op") != "GET").withColumn("run", F.floor(F.col("idx") / width))
    top = cut.agg(F.max("run").alias("top")).scalar()
    newest = cut.groupBy("run", "key").agg(F.max_by(F.struct(F.when(F.col("op") == "DELETE", DELETE).otherwise(PUT).alias("kind"), F.col("val").alias("value")), "idx").alias("v"))
    return newest.select((top - F.col("run")).cast("int").alias("source_rank"), "key", "v.kind", F.when(F.col("v.kind") == PUT, F.col("v.value")).alias("value"))


def merge(tables: DataFrame) -> DataFrame:
    """The newest version of each key, tombstones included: those may only go when the oldest table takes part."""
    v = F.min_by(F.struct("kind", "value", "source_rank"), "source_rank")
    return tables.groupBy("key").agg(v.alias("v")).select("key", "v.kind", "v.value", "v.source_rank")


def compact(tables: DataFrame) -> DataFrame:
    """All tables as one: no overwritten versions, no tombstones."""
    return merge(tables).where(F.col("kind") == PUT).select("key", "value")


def get(tables: DataFrame, keys: list[str]) -> DataFrame:
    return compact(tables.where(F.col("key").isin(keys)))


def scan(tables: DataFrame, prefix: str = "", limit: int | None = None) -> DataFrame:
    """Live keys with a prefix in key order; the filter is below the merge and reaches the files."""
    out = compact(tables.where(F.col("key").startswith(prefix)) if prefix else tables).orderBy("key")
    return out if limit is None else out.limit(limit)


def key_range(tables: DataFrame, start: str, stop: str | None = None) -> DataFrame:
    part = F.col("key") >= start
    return compact(tables.where(part if stop is None else part & (F.col("key") < stop)))


def stats(tables: DataFrame) -> DataFrame:
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return tables.groupBy("source_rank").agg(F.count("*").alias("entries"), F.count(F.when(F.col("kind") == DELETE, 1)).alias("tombstones"), F.sum(size).alias("bytes"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys whose values differ or that one side lacks."""
    both = left.select("key", F.col("value").alias("left_value")).join(right.select("key", F.col("value").alias("right_value")), "key", "full_outer")
    kind = F.when(F.col("left_value").isNull(), "added").when(F.col("right_value").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value"))).select("key", kind.alias("change"), "left_value", "right_value")


def semi_join(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key is a member. Spark builds a Bloom filter of the members at run time where it pays; the join makes the result exact."""
    return rows.join(members.select(key).distinct(), key, "left_semi")


def bloom_bits(keys: int) -> int:
    """The size of a filter of so many keys, in whole bytes."""
    return -(-max(LEAST_BITS, keys * BITS_A_KEY) // 8) * 8


def probes(key: Column, bits: int) -> Column:
    """The places of a key in a filter: h1 + i * h2 in 32 bits, modulo its size, with the halves of a 64-bit hash."""
    h = fnv1a64(key)
    step = h["hi"].bitwiseOR(F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: (h["lo"] + i * step).bitwiseAND(F.lit(MASK32)) % F.lit(bits))


def bloom(members: DataFrame, key: str, bits: int) -> DataFrame:
    """A Bloom filter of a column's keys as a table (word, mask) of 32-bit words that aren't 0; it is of bits / 32 rows at most."""
    at = members.select(F.explode(probes(F.col(key), bits)).alias("at"))
    one = F.lit(1).cast("long")
    return at.groupBy(F.floor(F.col("at") / 32).alias("word")).agg(F.bit_or(F.call_function("shiftleft", one, (F.col("at") % 32).cast("int"))).alias("mask"))


def might_contain(rows: DataFrame, key: str, filter: DataFrame, bits: int) -> DataFrame:
    """The distinct keys of rows with might_contain: false only for keys that aren't members."""
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct()
    asked = keys.select(key, F.explode(probes(F.col(key), bits)).alias("at")).withColumn("word", F.floor(F.col("at") / 32))
    hit = F.coalesce(F.getbit("mask", (F.col("at") % 32).cast("int")), F.lit(0)) == 1
    return asked.join(filter, "word", "left").groupBy(key).agg(F.bool_and(hit).alias("might_contain"))
