"""A log's state: exactly-once writes, last values with appends, reads as of an index, statuses and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WRITES = ("PUT", "APPEND", "DELETE")


def accepted(log: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Writes with the flag accepted: the sequence number is over all earlier ones of its client in its shard (0 before the first).

    Not a set: a number that comes after a higher one is dropped though it never took effect. Reads don't count. last
    (shard, client_id, seq) are numbers that came with a snapshot or with a shard that moved here.
    """
    before = Window.partitionBy("shard", "client_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    writes, known = log.where(F.col("op") != "GET"), F.lit(0)
    if last is not None:
        writes = writes.join(last.select("shard", "client_id", F.col("seq").alias("known")), ["shard", "client_id"], "left")
        known = F.coalesce("known", F.lit(0))
    return writes.withColumn("accepted", F.col("seq") > F.greatest(F.coalesce(F.max("seq").over(before), F.lit(0)), known)).drop("known")


def last_numbers(log: DataFrame) -> DataFrame:
    """(shard, client_id, seq): the highest number of each client in a shard, which a snapshot keeps and a migration takes along."""
    return log.where(F.col("op") != "GET").groupBy("shard", "client_id").agg(F.max("seq").alias("seq"))


def replay(log: DataFrame, as_of: int | None = None, snapshot: DataFrame | None = None, last: DataFrame | None = None) -> DataFrame:
    """(key, shard, value) of each live key after the accepted writes up to as_of.

    A put or delete starts a key's epoch; only the last epoch is gathered, so what came before never
    reaches one task. An append to a missing key acts as a put. With a snapshot (key, shard, value) and its last numbers
    (see accepted), the log is what came after it.
    """
    writes = accepted(log if as_of is None else log.where(F.col("idx") <= as_of), last).where("accepted").select("shard", "key", "idx", "op", "val")
    if snapshot is not None:
        writes = writes.unionByName(snapshot.select("shard", "key", F.lit(-1).cast("long").alias("idx"), F.lit("PUT").alias("op"), F.col("value").alias("val")))
    last = writes.where(F.col("op").isin("PUT", "DELETE")).groupBy("shard", "key").agg(F.max("idx").alias("epoch"))
    kept = writes.join(last, ["shard", "key"], "left").where((F.col("idx") >= F.coalesce("epoch", F.lit(-1))) & (F.col("op") != "DELETE"))
    parts = F.array_sort(F.collect_list(F.struct("idx", "val")))
    return kept.groupBy("key", "shard").agg(F.array_join(F.transform(parts, lambda p: p["val"]), "").alias("value"))


def lookup(keys: DataFrame, state: DataFrame) -> DataFrame:
    """keys (key) with value and status; a missing key is a status, and differs from an empty value."""
    return keys.join(state.select("key", "value"), "key", "left").withColumn("status", F.when(F.col("value").isNull(), "NO_KEY").otherwise("OK"))


def statuses(log: DataFrame, owned: Column) -> DataFrame:
    """Each request with its status. Ownership comes before sequence numbers: what a group doesn't own uses up none."""
    writes = accepted(log.where(owned & F.col("op").isin(*WRITES))).select("idx", "accepted")
    out = log.withColumn("owned", owned).join(writes, "idx", "left")
    status = F.when(~F.col("op").isin("GET", *WRITES), "WRONG_LEADER").when(~F.col("owned"), "WRONG_GROUP").otherwise("OK")
    return out.withColumn("status", status).withColumn("effect", F.coalesce("accepted", F.lit(False)))


def route(keys: DataFrame, assignment: DataFrame) -> DataFrame:
    """keys (key, shard) with the group of the shard; assignment has at most 64 rows."""
    return keys.join(F.broadcast(assignment.select("shard", "gid")), "shard", "left").withColumn("gid", F.coalesce("gid", F.lit(0)))
