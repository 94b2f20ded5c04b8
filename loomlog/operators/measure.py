"""Measurements: nearest-rank percentiles, rates, histograms, medians of runs, gauges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.functions.hashing import draw

# Bounds of the latency histogram are FIRST * 2**k seconds for k below BUCKETS.
FIRST, BUCKETS = 1e-4, 16


def percentiles(samples: DataFrame, by: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """For each group its number of samples and, for each share q, the sample of rank floor(q*n + 0.5), at least the first and at most the last.

    Equal values are counted before they are ranked, so a window holds a group's distinct values, and a group with few of them is no hot spot.
    """
    counts = samples.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(upto))
    ranked = ranked.withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    rank = lambda q: F.greatest(F.lit(1), F.least(F.col("n"), F.floor(q * F.col("n") + 0.5)))
    return ranked.groupBy(by).agg(F.max("n").alias("samples"), *(F.min(F.when(F.col("upto") >= rank(q), F.col(value))).alias(f"p{round(q * 100)}") for q in shares))


def throughput(samples: DataFrame, by: list[str], at: str) -> DataFrame:
    """Samples and samples a second between the first and the last."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    seconds = micros(F.max(at)) / 1e6 - micros(F.min(at)) / 1e6
    return samples.groupBy(*by).agg(F.count("*").alias("ops"), (F.count("*") / F.greatest(seconds, F.lit(1e-6))).alias("ops_per_sec"))


def per_window(samples: DataFrame, at: str, width: str) -> DataFrame:
    return samples.groupBy(F.window(at, width)["start"].alias("start")).agg(F.count("*").alias("ops"))


def histogram(samples: DataFrame, by: str, seconds) -> DataFrame:
    """(by, le, n): cumulative counts at each bound and at +Inf, from one pass over the samples."""
    bounds = [FIRST * 2**k for k in range(BUCKETS)]
    counts = samples.groupBy(by).agg(*(F.count(F.when(seconds <= b, 1)).alias(f"b{k}") for k, b in enumerate(bounds)), F.count(seconds).alias("inf"))
    cells = [F.struct(F.lit(b).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)] + [F.struct(F.lit(float("inf")).alias("le"), F.col("inf").alias("n"))]
    return counts.select(by, F.explode(F.array(*cells)).alias("cell")).select(by, "cell.le", "cell.n")


def median_run(runs: DataFrame, by: str, rate: str, tie: str) -> DataFrame:
    """Of each group the run in the middle by rate, the upper one of two."""
    order = Window.partitionBy(by).orderBy(rate, tie)
    ranked = runs.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(by)))
    return ranked.where(F.col("k") == F.floor(F.col("n") / 2) + 1).drop("k", "n")


def leader_changes(observed: DataFrame, by: str, at: str) -> DataFrame:
    """observed (.., leader, -1 for none): each new leader counts; that one steps down doesn't."""
    before = F.coalesce(F.lag("leader").over(Window.partitionBy(by).orderBy(at)), F.lit(-1))
    marked = observed.withColumn("change", (F.col("leader") != -1) & (F.col("leader") != before))
    return marked.groupBy(by).agg(F.count(F.when(F.col("change"), 1)).alias("changes"))


def lag(observed: DataFrame, by: list[str], at: str) -> DataFrame:
    """observed (.., last_idx, match_idx): each member's latest distance."""
    return observed.groupBy(*by).agg(F.max_by(F.col("last_idx") - F.col("match_idx"), at).alias("lag"))


def bench_report(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """A row for each of runs (run, start, stop): what a load generator says of its samples (run, at, ok, is_read, lat_ns).

    Only operations that ended in [start, stop) count, failed ones as errors and not among the latencies. Latencies are nearest-rank
    percentiles in whole microseconds, as milliseconds, over all, reads and writes; of no operations they are 0.
    """
    inside = samples.join(runs, "run").where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("stop")))
    done = inside.where("ok").select("run", F.explode(F.array(F.lit("all"), F.when(F.col("is_read"), "read").otherwise("write"))).alias("part"), F.floor(F.col("lat_ns") / 1000).alias("us"))
    shares = {"all": (0.5, 0.99, 0.999), "read": (0.5, 0.99), "write": (0.5, 0.99)}
    ranked = percentiles(done.withColumn("of", F.struct("run", "part")), "of", "us", (0.5, 0.99, 0.999)).select("of.run", "of.part", "samples", "p50", "p99", "p100")
    pick = lambda part, c: F.coalesce(F.max(F.when(F.col("part") == part, F.col(c))), F.lit(0))
    column = {0.5: "p50", 0.99: "p99", 0.999: "p100"}
    name = {0.5: "p50_ms", 0.99: "p99_ms", 0.999: "p999_ms"}
    latencies = [(pick(part, column[q]) / 1000).alias(("" if part == "all" else f"{part}_") + name[q]) for part, qs in shares.items() for q in qs]
    out = ranked.groupBy("run").agg(*(pick(part, "samples").alias(c) for part, c in (("all", "ops"), ("read", "reads"), ("write", "writes"))), *latencies)
    errors = inside.where("not ok").groupBy("run").agg(F.count("*").alias("errors"))
    seconds = (F.unix_micros(F.col("stop").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1e6
    out = runs.withColumn("seconds", seconds).join(out, "run", "left").join(errors, "run", "left").na.fill(0)
    return out.withColumn("ops_per_sec", F.col("ops") / F.col("seconds")).drop("start", "stop")


def store_gauges(steps: DataFrame) -> DataFrame:
    """steps (group_id, n, step, bytes): flushes, each with its new table's size, and compactions, with the one table's that they leave.

    Gives (group_id, tables, table_bytes, flushes, compactions): live tables are the last compaction's and those flushed since; an empty one is none.
    """
    last = F.max(F.when(F.col("step") == "compact", F.col("n"))).over(Window.partitionBy("group_id"))
    count = lambda c: F.count(F.when(c, 1))
    marked = steps.withColumn("live", F.col("n") >= F.coalesce(last, F.lit(-1)))
    live = F.col("live") & (F.col("bytes") > 0)
    return marked.groupBy("group_id").agg(count(live).alias("tables"), F.sum(F.when(live, F.col("bytes")).otherwise(0)).alias("table_bytes"), count(F.col("step") == "flush").alias("flushes"), count(F.col("step") == "compact").alias("compactions"))


def load(spark: SparkSession, clients: int, ops: int, keys: int, read_ratio: float, value_size: int, seed: int, preload: bool = True) -> DataFrame:
    """(client, n, op, key, value): requests of a load generator, each client's in order of n, and before them (client -1) a put of each key; a seed decides all of it."""
    name = lambda k: F.concat(F.lit("key"), F.lpad(k.cast("string"), 8, "0"))
    value = F.lit("v" * value_size)
    client, n = F.floor(F.col("id") / ops), F.col("id") % ops
    rows = spark.range(0, clients * ops).select(client.cast("int").alias("client"), n.cast("int").alias("n"))
    rows = rows.withColumn("read", draw(1000, F.lit(seed), F.lit("read"), F.col("client"), F.col("n")) < round(1000 * read_ratio)).withColumn("k", draw(keys, F.lit(seed), F.lit("key"), F.col("client"), F.col("n")))
    out = rows.select("client", "n", F.when(F.col("read"), "get").otherwise("put").alias("op"), name(F.col("k")).alias("key"), F.when(~F.col("read"), value).alias("value"))
    if preload:
        first = spark.range(0, keys).select(F.lit(-1).alias("client"), F.col("id").cast("int").alias("n"), F.lit("put").alias("op"), name(F.col("id")).alias("key"), value.alias("value"))
        out = first.unionByName(out)
    return out


def raft_gauges(observed: DataFrame, by: str, at: str) -> DataFrame:
    """observed (.., term, leader, commit_idx, applied, idx): each group's latest leader (-1 for none), its highest term and indexes, and the entries of its log from the first idx seen."""
    return observed.groupBy(by).agg(F.max("term").alias("term"), F.max_by("leader", at).alias("leader"), F.max("commit_idx").alias("commit_idx"), F.max("applied").alias("applied"), (F.max("idx") - F.min("idx") + 1).alias("entries"))
