"""Shards on groups: the ring with bounded loads, configuration history, and what a change moves.

Rings and configurations are planner metadata of a few thousand points, made on the driver; they become small
tables that join with data.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.functions.hashing import SHARDS, mixed64

# Points of a group, the load factor, and the word that is hashed before a shard's number ("SHARD").
POINTS, LOAD, SHARD_WORD = 64, 1.25, 0x5348415244
ABSENT, SERVING, PULLING, OFFERING, CLEANING = range(5)


class Ring:
    """Points of groups in the order of their hashes."""

    def __init__(self, gids: Iterable[int]):
        spots = sorted((mixed64(g, k), g) for g in gids for k in range(POINTS))
        self.hashes, self.gids = [h for h, _ in spots], [g for _, g in spots]

    def clockwise(self, shard: int) -> list[int]:
        """Groups of all points from the shard's place on."""
        at = bisect.bisect_left(self.hashes, mixed64(SHARD_WORD, shard)) % max(len(self.gids), 1)
        return self.gids[at:] + self.gids[:at]

    def owner(self, shard: int) -> int:
        return next(iter(self.clockwise(shard)), 0)


def assign(gids: Iterable[int], pinned: Mapping[int, int] | None = None) -> list[int]:
    """The group of each shard: pins to present groups first, whatever the load; then in order the next group below the bound."""
    present = set(gids)
    if not present:
        return [0] * SHARDS
    bound, ring = math.ceil(LOAD * SHARDS / len(present)), Ring(present)
    owner = {s: g for s, g in (pinned or {}).items() if g in present and 0 <= s < SHARDS}
    load = dict.fromkeys(present, 0)
    for g in owner.values():
        load[g] += 1
    for shard in (s for s in range(SHARDS) if s not in owner):
        g = next((g for g in ring.clockwise(shard) if load[g] < bound), 0)
        owner[shard] = g
        if g:
            load[g] += 1
    return [owner[s] for s in range(SHARDS)]


@dataclass(frozen=True)
class Config:
    num: int = 0
    shards: tuple[int, ...] = (0,) * SHARDS
    groups: frozenset[int] = frozenset()
    pinned: Mapping[int, int] = field(default_factory=dict)


def history(changes: Sequence[tuple]) -> list[Config]:
    """All configurations after ('join', gids), ('leave', gids) and ('move', shard, gid) in order; a move that isn't valid makes none."""
    out = [Config()]
    for kind, *args in changes:
        now = out[-1]
        if kind == "move":
            shard, gid = args
            if gid not in now.groups or not 0 <= shard < SHARDS:
                continue
            shards = tuple(gid if s == shard else g for s, g in enumerate(now.shards))
            out.append(Config(now.num + 1, shards, now.groups, {**now.pinned, shard: gid}))
            continue
        groups = now.groups | set(args[0]) if kind == "join" else now.groups - set(args[0])
        pinned = {s: g for s, g in now.pinned.items() if g in groups}
        out.append(Config(now.num + 1, tuple(assign(groups, pinned)), frozenset(groups), pinned))
    return out


def table(spark: SparkSession, configs: Sequence[Config]) -> DataFrame:
    """(num, shard, gid)."""
    rows = [(c.num, s, g) for c in configs for s, g in enumerate(c.shards)]
    return spark.createDataFrame(rows, "num long, shard int, gid long")


def query(configs: DataFrame, num: int) -> DataFrame:
    """One configuration; a number below 0 or past the last gives the latest."""
    last = configs.agg(F.max("num").alias("last"))
    wanted = F.when((F.lit(num) < 0) | (F.lit(num) > F.col("last")), F.col("last")).otherwise(F.lit(num))
    return configs.join(F.broadcast(last.select(wanted.alias("num"))), "num", "left_semi")


def transitions(configs: DataFrame) -> DataFrame:
    """(num, shard, gid, prev_gid, gained_state, lost_state) where a shard's group changes.

    A shard from nobody is served at once. One that nobody gets is still offered by its old group, which no one pulls.
    """
    moved = configs.withColumn("prev_gid", F.lag("gid").over(Window.partitionBy("shard").orderBy("num")))
    moved = moved.where("prev_gid is not null and gid <> prev_gid")
    gained = F.when(F.col("gid") == 0, ABSENT).when(F.col("prev_gid") == 0, SERVING).otherwise(PULLING)
    return moved.select("num", "shard", "gid", "prev_gid", gained.alias("gained_state"), F.when(F.col("prev_gid") == 0, ABSENT).otherwise(OFFERING).alias("lost_state"))


def plan(configs: DataFrame) -> DataFrame:
    """(num, gid, prev_gid, shards): which shards a group pulls from which."""
    pulls = transitions(configs).where(F.col("gained_state") == PULLING)
    return pulls.groupBy("num", "gid", "prev_gid").agg(F.array_join(F.sort_array(F.collect_list("shard")), ",").alias("shards"), F.count("*").alias("moves"))


def settled(states: DataFrame, num: int) -> DataFrame:
    """states (node, num, state): whether each node is at the number with all shards absent or served."""
    return states.groupBy("node").agg(F.bool_and((F.col("num") == num) & F.col("state").isin(ABSENT, SERVING)).alias("settled"))


def store(state: DataFrame, last: DataFrame) -> DataFrame:
    """(kind, shard, key, value): what a group holds of its shards, their data and their clients' last numbers (shard, client_id, seq)."""
    data = state.select(F.lit("data").alias("kind"), "shard", "key", "value")
    return data.unionByName(last.select(F.lit("dedup").alias("kind"), "shard", F.col("client_id").cast("string").alias("key"), F.col("seq").cast("string").alias("value")))


def last_numbers(held: DataFrame) -> DataFrame:
    """(shard, client_id, seq) of a store."""
    return held.where("kind = 'dedup'").select("shard", F.col("key").cast("long").alias("client_id"), F.col("value").cast("long").alias("seq"))


def export(held: DataFrame, shards: Sequence[int]) -> DataFrame:
    """The rows of a store that move with the shards: data and last numbers, so that a retry after the move is still known."""
    return held.where(F.col("shard").isin(list(shards)))


def _pulling(states: DataFrame, num: int) -> DataFrame:
    return states.where((F.col("state") == PULLING) & (F.col("num") == num)).select("shard")


def install(target: DataFrame, image: DataFrame, states: DataFrame, num: int) -> DataFrame:
    """The store target with an image of shards, both (kind, shard, key, value).

    states (shard, state, num) are the target's, with the number of its configuration. Only a shard that is still being pulled for
    configuration num goes in: an image that comes again after new writes changes nothing. A group has 64 states.
    """
    new = image.join(F.broadcast(_pulling(states, num)), "shard", "left_semi").select(target.columns)
    return target.join(new, ["kind", "shard", "key"], "left_anti").unionByName(new)


def installed(states: DataFrame, shards: Sequence[int], num: int) -> DataFrame:
    """The target's states after an image of shards: those that were pulled are to be cleaned at their old group."""
    came = F.col("shard").isin(list(shards)) & (F.col("num") == num)
    return states.withColumn("state", F.when(came, next_state(F.col("state"), F.lit("install"))).otherwise(F.col("state")))


def delete(state: DataFrame, offered: DataFrame) -> DataFrame:
    """state without the shards of offered (shard)."""
    return state.join(F.broadcast(offered.select("shard").distinct()), "shard", "left_anti")


def next_state(state: Column, event: Column) -> Column:
    """A shard's state after install, delete or cleaned; an event that doesn't fit the state changes nothing, so that it may repeat."""
    step = {("install", PULLING): CLEANING, ("cleaned", CLEANING): SERVING, ("delete", OFFERING): ABSENT}
    out = state
    for (name, before), after in step.items():
        out = F.when((event == name) & (state == before), F.lit(after)).otherwise(out)
    return out


def missing_groups(wanted: DataFrame, configs: DataFrame) -> DataFrame:
    """Groups (gid) of wanted that the latest configuration has no shard of: those that are still to join."""
    return wanted.select("gid").distinct().join(query(configs, -1).select("gid"), "gid", "left_anti")
