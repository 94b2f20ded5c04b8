"""Readers, and the adapters that make ordered command logs from the events table.

idx orders a log; it is unique and needs no global sort. A GET never enters a log's state.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.functions.hashing import key_shard


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new temporary folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomlog-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, client_id, seq, op, key, val, shard) of each event: views read, purchases append, errors delete, others put."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("client_id"), "event_type", "props")
    op = F.when(F.col("event_type") == "view", "GET").when(F.col("event_type") == "purchase", "APPEND").when(F.col("event_type") == "error", "DELETE").otherwise("PUT")
    key = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    val = F.concat(F.lit("["), F.col("client_id"), F.lit("."), F.col("event_id"), F.lit("]"))
    seq = F.row_number().over(Window.partitionBy("client_id").orderBy("event_id")).cast("long")
    return ev.select("event_id", "ts", "client_id", seq.alias("seq"), op.alias("op"), key.alias("key"), val.alias("val")).withColumn("shard", key_shard(F.col("key")))


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with a delayed retry of each seventh event."""
    ev = commands(spark, sf_dir)
    twice = F.when(F.col("event_id") % 7 == 0, F.array(F.lit(0), F.lit(41))).otherwise(F.array(F.lit(0)))
    return ev.withColumn("late", F.explode(twice)).withColumn("idx", 2 * F.col("event_id") + F.col("late")).drop("late")


def kv_log_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log where each eleventh event also comes late for the first time, so that some sequence numbers fall back."""
    ev = commands(spark, sf_dir)
    late = F.when(F.col("event_id") % 11 == 0, 121).otherwise(0)
    twice = F.when(F.col("event_id") % 7 == 0, F.array(late, F.lit(82))).otherwise(F.array(late))
    return ev.withColumn("late", F.explode(twice)).withColumn("idx", 4 * F.col("event_id") + F.col("late")).drop("late")
