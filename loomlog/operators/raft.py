"""What a replicated log says: commit rule, effective entries, compaction, agreement, leaders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def quorum_value(acks: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """For each group the largest value that a majority of its members has reached: an order statistic of a few rows."""
    n = F.size("all")
    out = acks.groupBy(by).agg(F.sort_array(F.collect_list(value)).alias("all"))
    return out.select(by, F.element_at("all", n - (F.floor(n / 2) + 1).cast("int") + 1).alias(name))


def commit_index(acks: DataFrame, terms: DataFrame) -> DataFrame:
    """acks (group_id, node, match_idx); terms (group_id, idx, term, current_term): an index commits if its entry is of the current term, else 0."""
    found = quorum_value(acks, "group_id", "match_idx", "idx")
    now = terms.where("term = current_term").select("group_id", "idx", F.lit(True).alias("own"))
    return found.join(now, ["group_id", "idx"], "left").select("group_id", F.when(F.col("own"), F.col("idx")).otherwise(0).alias("commit_idx"))


def effective(records: DataFrame, base: int) -> DataFrame:
    """records (node, rec_no, idx, ...): those over the base that no later record of an index at most theirs cuts off."""
    # backwards, so that the frame grows row by row
    later = Window.partitionBy("node").orderBy(F.desc("rec_no")).rowsBetween(Window.unboundedPreceding, -1)
    live = records.where(F.col("idx") > base).withColumn("cut", F.min("idx").over(later))
    return live.where(F.col("cut").isNull() | (F.col("cut") > F.col("idx"))).drop("cut")


def agreement(entries: DataFrame) -> DataFrame:
    """entries (node, idx, cmd): for each index whether all nodes that have it hold the same command, and for each whether its own index before is there."""
    gaps = entries.withColumn("gap", F.coalesce(F.col("idx") - F.lag("idx").over(Window.partitionBy("node").orderBy("idx")), F.lit(1)) != 1)
    return gaps.groupBy("idx").agg(F.count("*").alias("nodes"), (F.count_distinct("cmd") == 1).alias("agrees"), F.count(F.when(F.col("gap"), 1)).alias("gaps"))


def leaders(claims: DataFrame) -> DataFrame:
    """claims (term, leader): a term has one leader at most."""
    return claims.groupBy("term").agg(F.count_distinct("leader").alias("leaders")).withColumn("valid", F.col("leaders") <= 1)


def gaps(records: DataFrame, base: int) -> DataFrame:
    """Records over the base whose index is past the end of the log at that time, with that end: such a log can't be read.

    After a record the log ends at its index, since it cuts off what was there from it on.
    """
    kept = records.where(F.col("idx") > base)
    kept = kept.withColumn("log_end", F.coalesce(F.lag("idx").over(Window.partitionBy("node").orderBy("rec_no")), F.lit(base)))
    return kept.where(F.col("idx") > F.col("log_end") + 1)


def recovered(records: DataFrame, compactions: DataFrame, files: DataFrame) -> DataFrame:
    """What each node has after a restart: its compaction point, whether its snapshot file counts, and the entries kept.

    records (node, rec_no, idx, ..) after the compaction; compactions (node, base, term); files (node, idx, term) are
    the snapshots found. A file counts only if index and term are those of the compaction: a crash between two writes leaves an older one.
    """
    found = files.select("node", F.col("idx").alias("base"), "term", F.lit(True).alias("match"))
    point = compactions.join(found, ["node", "base", "term"], "left").select("node", "base", F.coalesce("match", F.lit(False)).alias("snapshot"))
    live = records.join(point, "node").where(F.col("idx") > F.col("base"))
    later = Window.partitionBy("node").orderBy(F.desc("rec_no")).rowsBetween(Window.unboundedPreceding, -1)
    live = live.withColumn("cut", F.min("idx").over(later)).where(F.col("cut").isNull() | (F.col("cut") > F.col("idx")))
    kept = live.groupBy("node").agg(F.count("*").alias("entries"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    return point.join(kept, "node", "left").select("node", "base", "snapshot", F.coalesce("entries", F.lit(0)).alias("entries"), "first_idx", "last_idx")
