"""Operation histories: linearizability, stale reads, audits of acknowledged writes, roll-ups of runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.functions.hashing import draw

OPEN = (1 << 63) - 1  # the return of an operation that never came back
#: States that a search enters before it gives up; a bound of steps and not of time, so that a verdict repeats.
STATES = 1_000_000


def check_register(ops: list[tuple], states: int = STATES) -> str:
    """Ok, Illegal or Unknown for one key's operations (op, value, out, call, return).

    A depth-first search over orders that respect real time: an operation may be next if no other pending one returned before
    it was called. A state is the register's value and the set of operations done; none is entered twice. A
    missing key reads as ''. Unfinished writes may come at any time after their call or never count; unfinished reads say nothing.
    """
    ops = sorted((o for o in ops if not (o[0] == "get" and o[4] == OPEN)), key=lambda o: (o[3], o[4]))
    n = len(ops)
    must = sum(1 << i for i, o in enumerate(ops) if o[4] != OPEN)
    stack, seen = [(0, "")], {(0, "")}
    while stack:
        if len(seen) > states:
            return "Unknown"
        done, value = stack.pop()
        if done & must == must:
            return "Ok"
        first = min(ops[i][4] for i in range(n) if not done >> i & 1)
        for i in range(n):
            op, arg, out, call, _ = ops[i]
            if call > first:
                break
            if done >> i & 1 or op == "get" and out != value:
                continue
            state = (done | 1 << i, arg if op == "put" else value + arg if op == "append" else value)
            if state not in seen:
                seen.add(state)
                stack.append(state)
    return "Ok" if not n else "Illegal"


def check(history: DataFrame, states: int = STATES) -> DataFrame:
    """history (key, op, value, out, call_ns, return_ns) to (key, ops, verdict); keys are independent, and a key's history is one task's."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        ops = list(t[["op", "value", "out", "call_ns", "return_ns"]].fillna("").itertuples(index=False, name=None))
        return pd.DataFrame({"key": [t["key"].iloc[0]], "ops": [len(t)], "verdict": [check_register(ops, states)]})

    return history.groupBy("key").applyInPandas(one, "key string, ops long, verdict string")


def stale_reads(history: DataFrame) -> DataFrame:
    """(key, reads): reads that began after a put had returned and yet found no value; such a history is illegal.

    The least return of a key's puts decides, so no pairs of writes and reads are made.
    """
    wrote = history.where("op = 'put' and value <> ''").groupBy("key").agg(F.min("return_ns").alias("written"))
    reads = history.where((F.col("op") == "get") & (F.coalesce("out", F.lit("")) == ""))
    return reads.join(wrote, "key").where("written < call_ns").groupBy("key").agg(F.count("*").alias("reads"))


def pick(seeds: DataFrame, every: int, kinds: list[str]) -> DataFrame:
    """seeds (seed) with their scenario: each every-th is sharded, the others go round the kinds."""
    names = F.array(*(F.lit(k) for k in kinds))
    return seeds.withColumn("scenario", F.when(F.col("seed") % every == 0, "sharded").otherwise(F.element_at(names, (F.col("seed") % len(kinds) + 1).cast("int"))))


def roll_up(runs: DataFrame) -> DataFrame:
    """runs (scenario, verdict, ops) to counts for each scenario and TOTAL. Runs that failed count as runs but not in ops; min_ops is over the others."""
    good = F.col("verdict") != "error"
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1)).alias(v)
    out = runs.rollup("scenario").agg(F.count("*").alias("runs"), count("ok"), count("illegal"), count("unknown"), count("error"), F.coalesce(F.sum(F.when(good, F.col("ops"))), F.lit(0)).alias("ops"), F.min(F.when(good, F.col("ops"))).alias("min_ops"))
    return out.withColumn("scenario", F.coalesce("scenario", F.lit("TOTAL"))).withColumn("mean_ops", F.col("ops") / F.greatest("runs", F.lit(1)))


def lost_writes(acked: DataFrame, state: DataFrame) -> DataFrame:
    """acked (key, value) that state (key, value) lacks or holds otherwise."""
    found = acked.join(state.select("key", F.col("value").alias("found")), "key", "left")
    return found.where(~F.col("value").eqNullSafe(F.col("found"))).select("key", "value", "found")


def prefix_check(written: DataFrame, recovered: DataFrame) -> DataFrame:
    """written (run, pos, data, acked) and recovered (run, pos, data): whether what came back is a prefix that has all that was acknowledged."""
    both = written.join(recovered.select("run", "pos", F.col("data").alias("got")), ["run", "pos"], "full_outer")
    out = both.groupBy("run").agg(F.count("data").alias("n"), F.count("got").alias("recovered"), F.count(F.when(F.col("acked"), 1)).alias("acked"), F.count(F.when(F.col("got").isNotNull() & ~F.col("got").eqNullSafe(F.col("data")), 1)).alias("wrong"), F.max(F.when(F.col("got").isNotNull(), F.col("pos"))).alias("top"))
    ok = (F.col("wrong") == 0) & (F.col("recovered") >= F.col("acked")) & (F.col("recovered") <= F.col("n")) & (F.coalesce("top", F.lit(-1)) + 1 == F.col("recovered"))
    return out.select("run", "n", "recovered", "acked", ok.alias("valid"))


def crash_audit(acked: DataFrame, state: DataFrame, iterations: DataFrame, sample: int = 200, seed: int = 1) -> DataFrame:
    """(it, kind, acked, checked, lost, valid) of each iteration (it, kind) of a crash test; acked (it, key, value), each key once; state (key, value).

    Checked are all writes that the iteration acknowledged and `sample` draws, with replacement, from those of earlier ones. None may be
    lost, and an iteration without an acknowledged write fails, unless it killed all nodes.
    """
    per = iterations.join(acked.groupBy("it").agg(F.count("*").alias("acked")), "it", "left").select("it", "kind", F.coalesce("acked", F.lit(0)).alias("acked"))
    # sums over iterations, not writes
    older = F.coalesce(F.sum("acked").over(Window.orderBy("it").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("older", older)
    place = F.row_number().over(Window.partitionBy("it").orderBy("key")) - 1
    placed = acked.withColumn("own", place).join(per.select("it", "older"), "it").select("key", "value", (F.col("older") + F.col("own")).alias("place"), "it")
    drawn = per.where("older > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(sample - 1))))
    drawn = drawn.select("it", F.pmod(draw(1 << 40, F.lit(seed), F.col("it"), F.col("j")), F.col("older")).alias("place"))
    asked = placed.select("it", "key", "value").unionByName(drawn.join(placed.drop("it"), "place").select("it", "key", "value"))
    found = asked.join(state.select("key", F.col("value").alias("found")), "key", "left")
    lost = found.groupBy("it").agg(F.count("*").alias("checked"), F.count(F.when(~F.col("value").eqNullSafe(F.col("found")), 1)).alias("lost"))
    out = per.join(lost, "it", "left").select("it", "kind", "acked", F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("lost", F.lit(0)).alias("lost"))
    return out.withColumn("valid", (F.col("lost") == 0) & ((F.col("acked") > 0) | (F.col("kind") == "all")))


def workload(spark: SparkSession, clients: int, ops: int, keys: int, seed: int) -> DataFrame:
    """(client, n, op, key, value): half reads, a fifth puts, the rest appends of [client.n]; a seed decides all of it."""
    client, n = F.floor(F.col("id") / ops), F.col("id") % ops
    rows = spark.range(0, clients * ops).select(client.cast("int").alias("client"), n.cast("int").alias("n"))
    rows = rows.withColumn("p", draw(10, F.lit(seed), F.lit("op"), F.col("client"), F.col("n"))).withColumn("k", draw(keys, F.lit(seed), F.lit("key"), F.col("client"), F.col("n")))
    op = F.when(F.col("p") < 5, "get").when(F.col("p") < 7, "put").otherwise("append")
    value = F.when(F.col("p") >= 5, F.concat(F.lit("["), "client", F.lit("."), "n", F.lit("]")))
    return rows.select("client", "n", op.alias("op"), F.concat(F.lit("k"), "k").alias("key"), value.alias("value"))
