"""Named queries over the tables of a folder, each with the DuckDB SQL that it is held against.

The tables hold no command log, so adapters make one from events (loomlog.sources.tables); measurements take events'
values and times as stand-ins for latencies.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.functions import codecs
from loomlog.functions.hashing import SHARDS, key_shard
from loomlog.operators import history, lsm, measure, placement, raft, state
from loomlog.sources.tables import commands, kv_log, kv_log_reordered, shared_dir, table
from loomlog.streaming import state_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CHANGES = (("join", [1]), ("join", [2, 3]), ("move", 5, 3), ("join", [4]), ("leave", [2]), ("move", 6, 9), ("join", [5, 6]), ("leave", [1]))
CONFIGS = placement.history(CHANGES)
AS_OF, RUN = 5000, 4000


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


# SQL that several oracles begin with.
SHARD = "CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295) % 64 AS INTEGER)"
EV = f"""ev0 AS (SELECT event_id, ts, user_id AS client_id, 'k' || json_extract_string(props, '$.k') AS key,
  CASE event_type WHEN 'view' THEN 'GET' WHEN 'purchase' THEN 'APPEND' WHEN 'error' THEN 'DELETE' ELSE 'PUT' END AS op,
  '[' || user_id || '.' || event_id || ']' AS val, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
ev AS (SELECT *, {SHARD} AS shard FROM ev0)"""
LOG = f"{EV}, log AS (SELECT *, 2 * event_id AS idx FROM ev UNION ALL SELECT *, 2 * event_id + 41 FROM ev WHERE event_id % 7 = 0)"
LATE = f"{EV}, log AS (SELECT *, 4 * event_id + CASE WHEN event_id % 11 = 0 THEN 121 ELSE 0 END AS idx FROM ev UNION ALL SELECT *, 4 * event_id + 82 FROM ev WHERE event_id % 7 = 0)"
ACC = "acc AS (SELECT *, seq > coalesce(max(seq) OVER (PARTITION BY shard, client_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS accepted FROM log WHERE op <> 'GET')"


def _state(where: str = "TRUE") -> str:
    return f"""{ACC.replace("WHERE op <> 'GET'", f"WHERE op <> 'GET' AND {where}")},
ep AS (SELECT *, coalesce(max(CASE WHEN op IN ('PUT', 'DELETE') THEN idx END) OVER (PARTITION BY key), -1) AS epoch FROM acc WHERE accepted),
st AS (SELECT key, any_value(shard) AS shard, string_agg(val, '' ORDER BY idx) AS value FROM ep WHERE idx >= epoch AND op <> 'DELETE' GROUP BY key)"""


# Data operators


@query(f"WITH {LOG}, {_state()} SELECT key, shard, value FROM st")
def kv_final_state(spark, d):
    return state.replay(kv_log(spark, d))


@query(f"WITH {LOG}, {_state(f'idx <= {AS_OF}')} SELECT key, shard, value FROM st")
def kv_state_asof(spark, d):
    return state.replay(kv_log(spark, d), AS_OF)


@query(f"WITH {LATE}, {_state()} SELECT key, shard, value FROM st")
def kv_resume(spark, d):
    """The state as of an index and the last numbers then, and the rest of the log on top of them."""
    log = kv_log_reordered(spark, d)
    first = log.where(F.col("idx") <= AS_OF)
    return state.replay(log.where(F.col("idx") > AS_OF), snapshot=state.replay(first), last=state.last_numbers(first))


DEDUP = "SELECT shard, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS duplicates FROM acc GROUP BY shard"


def _dedup(log: DataFrame) -> DataFrame:
    return state.accepted(log).groupBy("shard").agg(F.count(F.when(F.col("accepted"), 1)).alias("accepted"), F.count(F.when(~F.col("accepted"), 1)).alias("duplicates"))


@query(f"WITH {LOG}, {ACC} {DEDUP}")
def kv_dedup(spark, d):
    return _dedup(kv_log(spark, d))


@query(f"WITH {LATE}, {ACC} {DEDUP}")
def kv_dedup_reordered(spark, d):
    return _dedup(kv_log_reordered(spark, d))


@query(f"WITH {LOG}, {_state()}, req AS (SELECT 'k' || range AS key FROM range(130)) SELECT key, value, CASE WHEN value IS NULL THEN 'NO_KEY' ELSE 'OK' END AS status FROM req LEFT JOIN st USING (key)")
def kv_get(spark, d):
    keys = spark.range(130).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    return state.lookup(keys, state.replay(kv_log(spark, d)))


@query(
    f"""WITH {LATE}, r AS (SELECT *, shard % 5 <> 0 AS owned, CASE WHEN event_id % 97 = 0 THEN 'NOP' ELSE op END AS o FROM log),
s AS (SELECT o, owned, CASE WHEN o = 'NOP' THEN 'WRONG_LEADER' WHEN NOT owned THEN 'WRONG_GROUP' ELSE 'OK' END AS status,
  seq > coalesce(max(CASE WHEN owned AND o IN ('PUT', 'APPEND', 'DELETE') THEN seq END) OVER (PARTITION BY shard, client_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AND owned AND o IN ('PUT', 'APPEND', 'DELETE') AS effect FROM r)
SELECT o AS op, status, count(*) AS requests, count(*) FILTER (effect) AS effects FROM s GROUP BY ALL"""
)
def kv_status(spark, d):
    log = kv_log_reordered(spark, d).withColumn("op", F.when(F.col("event_id") % 97 == 0, "NOP").otherwise(F.col("op")))
    out = state.statuses(log, F.col("shard") % 5 != 0)
    return out.groupBy("op", "status").agg(F.count("*").alias("requests"), F.count(F.when(F.col("effect"), 1)).alias("effects"))


@query(f"WITH {LOG} SELECT shard, max(idx) AS applied, count(*) AS commands FROM log WHERE op <> 'GET' GROUP BY shard")
def kv_applied_index(spark, d):
    return kv_log(spark, d).where("op <> 'GET'").groupBy("shard").agg(F.max("idx").alias("applied"), F.count("*").alias("commands"))


@query(f"WITH ks AS (SELECT DISTINCT 'k' || json_extract_string(props, '$.k') AS key FROM events UNION SELECT p_name FROM part) SELECT key, {SHARD} AS shard FROM ks")
def kv_shard_of(spark, d):
    keys = table(spark, d, "events").select(F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("key"))
    return keys.union(table(spark, d, "part").select("p_name")).distinct().withColumn("shard", key_shard(F.col("key")))


# The ring and all configurations in SQL alone, from the list of changes: 64-bit arithmetic in 128-bit integers, and a
# recursion over changes and, within one, over shards.
WORD = 1 << 64


def _octets(word: str) -> str:
    return ", ".join(f"CAST(({word}) // {256**i} % 256 AS UHUGEINT)" for i in range(8))


def _mixed(*words: str) -> str:
    h = f"list_reduce([14695981039346656037::UHUGEINT, {', '.join(map(_octets, words))}], lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % {WORD}::UHUGEINT)"
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = f"list_transform([{h}], lambda x: (xor(x, x // {1 << shift}::UHUGEINT) * {factor}::UHUGEINT) % {WORD}::UHUGEINT)[1]"
    return f"list_transform([{h}], lambda x: xor(x, x // {1 << 31}::UHUGEINT))[1]"


RING = f"""pts AS MATERIALIZED (SELECT g.range AS gid, {_mixed("g.range", "v.range")} AS h FROM range(1, 11) g, range(64) v),
spot AS MATERIALIZED (SELECT range AS shard, {_mixed(str(0x5348415244), "range")} AS h FROM range(64)),
near AS (SELECT shard, gid, min((pts.h < spot.h, pts.h)) AS place FROM spot, pts GROUP BY ALL),
pref AS MATERIALIZED (SELECT shard, list(gid ORDER BY place, gid) AS gids FROM near GROUP BY shard)"""
ASSIGNED = """asg(n, shard, gid, load) AS (SELECT range, -1, 0, [0 for i in range(10)] FROM range(1, 11) UNION ALL
SELECT n, shard, gid, list_transform(load, lambda x, i: CASE WHEN i = gid THEN x + 1 ELSE x END) FROM
 (SELECT a.n, p.shard, a.load, list_filter(p.gids, lambda g: g <= a.n AND a.load[g] < ceil(80.0 / a.n))[1] AS gid FROM asg a JOIN pref p ON p.shard = a.shard + 1))"""
_args = ", ".join(f"({k}, '{c[0]}', {list(c[1]) if c[0] != 'move' else list(c[1:])})" for k, c in enumerate(CHANGES, 1))
CFG = f"""{RING}, chg(k, kind, args) AS (VALUES {_args}),
cs(num, k, s, gids, pins, load, shards) AS (
SELECT 0, 0, 64, CAST([] AS BIGINT[]), [CAST(0 AS BIGINT) for i in range(64)], [CAST(0 AS BIGINT) for i in range(10)], [CAST(0 AS BIGINT) for i in range(64)]
UNION ALL SELECT * FROM (
SELECT num, k, s + 1, gids, pins, CASE WHEN pins[s + 1] = 0 THEN list_transform(load, lambda x, i: CASE WHEN i = gid THEN x + 1 ELSE x END) ELSE load END, list_append(shards, gid) FROM
 (SELECT cs.*, CASE WHEN pins[s + 1] <> 0 THEN pins[s + 1] WHEN len(cs.gids) = 0 THEN 0 ELSE list_filter(p.gids, lambda g: list_contains(cs.gids, g) AND load[g] < ceil(80.0 / len(cs.gids)))[1] END AS gid FROM cs JOIN pref p ON p.shard = s WHERE s < 64)
UNION ALL
SELECT num + 1, k, 0, gids, pins, list_transform([CAST(range AS BIGINT) for range in range(1, 11)], lambda g: CAST(len(list_filter(pins, lambda p: p = g)) AS BIGINT)), CAST([] AS BIGINT[]) FROM
 (SELECT num, c.k, g.gids, list_transform(pins, lambda p: CASE WHEN list_contains(g.gids, p) THEN p ELSE 0 END) AS pins FROM cs JOIN chg c ON c.k = cs.k + 1,
  LATERAL (SELECT CASE WHEN c.kind = 'join' THEN list_distinct(list_concat(cs.gids, CAST(c.args AS BIGINT[]))) ELSE list_filter(cs.gids, lambda x: NOT list_contains(c.args, x)) END AS gids) g WHERE s = 64 AND c.kind <> 'move')
UNION ALL
SELECT CASE WHEN ok THEN num + 1 ELSE num END, k, 64, gids, CASE WHEN ok THEN list_transform(pins, lambda p, i: CASE WHEN i = a + 1 THEN b ELSE p END) ELSE pins END, load, CASE WHEN ok THEN list_transform(shards, lambda p, i: CASE WHEN i = a + 1 THEN b ELSE p END) ELSE shards END FROM
 (SELECT num, c.k, gids, pins, load, shards, CAST(c.args[1] AS BIGINT) AS a, CAST(c.args[2] AS BIGINT) AS b, list_contains(gids, c.args[2]) AND c.args[1] BETWEEN 0 AND 63 AS ok FROM cs JOIN chg c ON c.k = cs.k + 1 WHERE s = 64 AND c.kind = 'move'))),
cfg AS MATERIALIZED (SELECT CAST(num AS BIGINT) AS num, CAST(unnest(range(64)) AS INTEGER) AS shard, unnest(shards) AS gid FROM (SELECT DISTINCT num, shards FROM cs WHERE s = 64))"""
LATEST = f"{CFG}, latest AS (SELECT * FROM cfg WHERE num = (SELECT max(num) FROM cfg))"


@query(f"WITH RECURSIVE {LATEST}, {LOG} SELECT gid, count(*) AS requests, count(DISTINCT key) AS keys FROM log JOIN latest USING (shard) GROUP BY gid")
def kv_route(spark, d):
    out = state.route(kv_log(spark, d).select("key", "shard"), placement.table(spark, CONFIGS[-1:]))
    return out.groupBy("gid").agg(F.count("*").alias("requests"), F.count_distinct("key").alias("keys"))


# Storage operators

SOURCES = f"""{LOG}, v AS (SELECT CAST(floor(idx / {RUN}) AS BIGINT) AS run, key, arg_max(CASE WHEN op = 'DELETE' THEN 0 ELSE 1 END, idx) AS kind, arg_max(val, idx) AS val FROM log WHERE op <> 'GET' GROUP BY ALL),
src AS (SELECT CAST((SELECT max(run) FROM v) - run AS INTEGER) AS source_rank, key, kind, CASE WHEN kind = 1 THEN val END AS value FROM v),
mrg AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY key ORDER BY source_rank) = 1),
live AS (SELECT key, value FROM mrg WHERE kind = 1)"""


def _sources(spark, d):
    return lsm.sources(kv_log(spark, d), RUN)


@query(f"WITH {SOURCES} SELECT key, kind, value, source_rank FROM mrg")
def lsm_merge(spark, d):
    return lsm.merge(_sources(spark, d))


@query(f"WITH {SOURCES} SELECT * FROM live")
def lsm_compact(spark, d):
    return lsm.compact(_sources(spark, d))


@query(f"WITH {SOURCES} SELECT * FROM live WHERE key IN ('k1', 'k17', 'k42', 'none')")
def lsm_get(spark, d):
    return lsm.get(_sources(spark, d), ["k1", "k17", "k42", "none"])


@query(f"WITH {SOURCES} SELECT * FROM live WHERE starts_with(key, 'k1')")
def lsm_scan_prefix(spark, d):
    return lsm.scan(_sources(spark, d), "k1")


@query(f"WITH {SOURCES} SELECT * FROM live WHERE starts_with(key, 'k') ORDER BY key LIMIT 10")
def lsm_scan_limit(spark, d):
    return lsm.scan(_sources(spark, d), "k", 10)


@query(f"WITH {SOURCES} SELECT * FROM live WHERE key >= 'k3' AND key < 'k6'")
def lsm_range(spark, d):
    return lsm.key_range(_sources(spark, d), "k3", "k6")


@query(f"WITH {SOURCES} SELECT source_rank, count(*) AS entries, count(*) FILTER (kind = 0) AS tombstones, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes, min(key) AS first_key, max(key) AS last_key FROM src GROUP BY source_rank")
def lsm_stats(spark, d):
    return lsm.stats(_sources(spark, d))


@query(
    f"""WITH {SOURCES}, old AS (SELECT key, value FROM (SELECT * FROM src WHERE source_rank >= 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY source_rank) = 1) WHERE kind = 1)
SELECT key, CASE WHEN o.value IS NULL THEN 'added' WHEN l.value IS NULL THEN 'removed' ELSE 'changed' END AS change, o.value AS left_value, l.value AS right_value
FROM old o FULL JOIN live l USING (key) WHERE o.value IS DISTINCT FROM l.value"""
)
def lsm_diff(spark, d):
    src = _sources(spark, d)
    return lsm.diff(lsm.compact(src.where("source_rank >= 2")), lsm.compact(src))


HASH64 = f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS UHUGEINT))), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % {WORD}::UHUGEINT)"


@query(
    f"""WITH c AS (SELECT 'c' || c_custkey AS key, c_custkey % 2 = 0 AS member FROM customer), n AS (SELECT count(*) FILTER (member) AS members, ceil(greatest(64, 10 * count(*) FILTER (member)) / 8.0) * 8 AS bits FROM c),
h AS (SELECT key, member, CAST(x % {1 << 32}::UHUGEINT AS BIGINT) AS h1, CAST(x // {1 << 32}::UHUGEINT AS BIGINT) | 1 AS h2 FROM (SELECT key, member, {HASH64} AS x FROM c)),
p AS (SELECT key, member, (h1 + unnest(range(7)) * h2) % {1 << 32} % CAST(bits AS BIGINT) AS place FROM h, n), held AS (SELECT DISTINCT place FROM p WHERE member),
m AS (SELECT key, any_value(member) AS member, bool_and(place IN (SELECT place FROM held)) AS might FROM p GROUP BY key)
SELECT any_value(CAST(bits AS BIGINT)) AS bits, any_value(members) AS members, count(*) FILTER (member AND NOT might) AS missed, count(*) FILTER (NOT member) AS others, count(*) FILTER (NOT member AND might) AS false_positives FROM m, n"""
)
def bloom_false_positives(spark, d):
    """A filter of every second customer asked for all of them."""
    keys = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("key"), (F.col("c_custkey") % 2 == 0).alias("member"))
    members = keys.where("member").count()
    bits = lsm.bloom_bits(members)
    asked = lsm.might_contain(keys, "key", lsm.bloom(keys.where("member"), "key", bits), bits).join(keys, "key")
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    might, member = F.col("might_contain"), F.col("member")
    return asked.agg(F.lit(bits).cast("long").alias("bits"), F.lit(members).cast("long").alias("members"), count(member & ~might, "missed"), count(~member, "others"), count(~member & might, "false_positives"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000)")
def bloom_semi_join(spark, d):
    members = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return lsm.semi_join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), members, "o_custkey")


# Log persistence and consensus

RECORDS = "rec AS (SELECT user_id % 5 AS node, event_id AS rec_no, CASE WHEN event_id % 53 = 0 THEN event_id - 40 ELSE event_id END AS idx, event_type AS cmd FROM events)"


def _records(spark, d):
    ev = table(spark, d, "events")
    idx = F.when(F.col("event_id") % 53 == 0, F.col("event_id") - 40).otherwise(F.col("event_id"))
    return ev.select((F.col("user_id") % 5).alias("node"), F.col("event_id").alias("rec_no"), idx.alias("idx"), F.col("event_type").alias("cmd"))


LIVE = "live AS (SELECT * FROM rec r WHERE idx > 100 QUALIFY coalesce(min(idx) OVER (PARTITION BY node ORDER BY rec_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), idx + 1) > idx)"


@query(f"WITH {RECORDS}, {LIVE} SELECT node, rec_no, idx, cmd FROM live")
def raft_log_effective(spark, d):
    return raft.effective(_records(spark, d), 100)


@query(f"WITH {RECORDS}, {LIVE} SELECT node, count(*) AS entries, min(idx) AS first_idx, max(idx) AS last_idx FROM live WHERE idx > 2000 GROUP BY node")
def log_compact(spark, d):
    kept = raft.effective(_records(spark, d), 100).where("idx > 2000")
    return kept.groupBy("node").agg(F.count("*").alias("entries"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


# A log of its own for each node, dense but for rewrites and some gaps.
DENSE = "dense AS (SELECT *, CASE WHEN rec_no % 41 = 0 THEN rec_no - 7 WHEN rec_no % 59 = 0 THEN rec_no + 3 ELSE rec_no END AS idx FROM (SELECT user_id % 5 AS node, event_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS rec_no FROM events))"


def _dense(spark, d):
    ev = table(spark, d, "events").select((F.col("user_id") % 5).alias("node"), "event_id")
    ev = ev.withColumn("rec_no", F.row_number().over(Window.partitionBy("node").orderBy("event_id")).cast("long"))
    n = F.col("rec_no")
    return ev.withColumn("idx", F.when(n % 41 == 0, n - 7).when(n % 59 == 0, n + 3).otherwise(n))


@query(f"WITH {DENSE}, g AS (SELECT node, rec_no, idx, coalesce(lag(idx) OVER (PARTITION BY node ORDER BY rec_no), 50) AS log_end FROM dense WHERE idx > 50) SELECT * FROM g WHERE idx > log_end + 1")
def raft_log_gaps(spark, d):
    return raft.gaps(_dense(spark, d).drop("event_id"), 50)


@query(
    f"""WITH {DENSE}, c AS (SELECT range AS node, 20 + 10 * range AS base, 3 AS term FROM range(6)), f AS (SELECT range AS node, 20 + 10 * range - CASE WHEN range = 1 THEN 10 ELSE 0 END AS idx, CASE WHEN range = 2 THEN 2 ELSE 3 END AS term FROM range(5)),
r AS (SELECT d.node, rec_no, idx, min(idx) OVER (PARTITION BY d.node ORDER BY rec_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS cut FROM dense d JOIN c ON c.node = d.node WHERE idx > base),
k AS (SELECT node, count(*) AS entries, min(idx) AS first_idx, max(idx) AS last_idx FROM r WHERE cut IS NULL OR cut > idx GROUP BY node)
SELECT c.node, c.base, EXISTS (SELECT 1 FROM f WHERE f.node = c.node AND f.idx = c.base AND f.term = c.term) AS snapshot, coalesce(entries, 0) AS entries, first_idx, last_idx FROM c LEFT JOIN k ON k.node = c.node"""
)
def raft_recovery(spark, d):
    """Nodes with a snapshot of their compaction, of an older index, of another term, and without one; node 5 has no entries."""
    n = F.col("id")
    compactions = spark.range(6).select(n.alias("node"), (20 + 10 * n).alias("base"), F.lit(3).alias("term"))
    files = spark.range(5).select(n.alias("node"), (20 + 10 * n - F.when(n == 1, 10).otherwise(0)).alias("idx"), F.when(n == 2, 2).otherwise(3).alias("term"))
    return raft.recovered(_dense(spark, d), compactions, files)


ACKS = "acks AS (SELECT user_id % 11 AS group_id, event_id % 5 AS node, max(event_id) AS match_idx FROM events GROUP BY ALL)"


def _acks(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 11).alias("group_id"), (F.col("event_id") % 5).alias("node")).agg(F.max("event_id").alias("match_idx"))


QUORUM = "q AS (SELECT group_id, list_sort(list(match_idx))[len(list(match_idx)) - (len(list(match_idx)) // 2 + 1) + 1] AS idx FROM acks GROUP BY group_id)"


@query(f"WITH {ACKS}, {QUORUM} SELECT q.group_id, CASE WHEN e.event_id % 3 <> 0 THEN idx ELSE 0 END AS commit_idx FROM q JOIN events e ON e.event_id = q.idx")
def raft_commit_index(spark, d):
    ev = table(spark, d, "events")
    terms = ev.select((F.col("user_id") % 11).alias("group_id"), F.col("event_id").alias("idx"), F.when(F.col("event_id") % 3 != 0, 7).otherwise(6).alias("term"), F.lit(7).alias("current_term"))
    return raft.commit_index(_acks(spark, d), terms)


@query(f"WITH {ACKS}, {QUORUM} SELECT group_id, idx AS read_round FROM q")
def read_quorum(spark, d):
    return raft.quorum_value(_acks(spark, d), "group_id", "match_idx", "read_round")


COPIES = "cp AS (SELECT n.node, event_id AS idx, CASE WHEN event_id % 101 = 0 AND n.node = 2 THEN 'other' ELSE event_type END AS cmd FROM events, (VALUES (0), (1), (2)) n(node) WHERE NOT (n.node = 1 AND event_id % 211 = 5))"


@query(f"WITH {COPIES}, g AS (SELECT *, coalesce(idx - lag(idx) OVER (PARTITION BY node ORDER BY idx), 1) <> 1 AS gap FROM cp) SELECT idx, count(*) AS nodes, count(DISTINCT cmd) = 1 AS agrees, count(*) FILTER (gap) AS gaps FROM g GROUP BY idx")
def replica_agreement(spark, d):
    ev = table(spark, d, "events").select(F.explode(F.array(*(F.lit(n) for n in range(3)))).alias("node"), F.col("event_id").alias("idx"), "event_type")
    ev = ev.where(~((F.col("node") == 1) & (F.col("idx") % 211 == 5)))
    return raft.agreement(ev.select("node", "idx", F.when((F.col("idx") % 101 == 0) & (F.col("node") == 2), "other").otherwise(F.col("event_type")).alias("cmd")))


@query("SELECT event_id // 100 AS term, count(DISTINCT CASE WHEN event_id % 997 = 3 THEN 9 ELSE (event_id // 100) % 5 END) AS leaders, count(DISTINCT CASE WHEN event_id % 997 = 3 THEN 9 ELSE (event_id // 100) % 5 END) <= 1 AS valid FROM events GROUP BY 1")
def leaders_per_term(spark, d):
    term = F.floor(F.col("event_id") / 100)
    claims = table(spark, d, "events").select(term.alias("term"), F.when(F.col("event_id") % 997 == 3, 9).otherwise(term % 5).alias("leader"))
    return raft.leaders(claims)


# Placement


@query(f"WITH RECURSIVE {RING}, {ASSIGNED} SELECT CAST(n AS INTEGER) AS groups, CAST(shard AS INTEGER) AS shard, CAST(gid AS BIGINT) AS gid FROM asg WHERE shard >= 0")
def ring_assign(spark, d):
    rows = [(n, s, g) for n in range(1, 11) for s, g in enumerate(placement.assign(range(1, n + 1)))]
    return spark.createDataFrame(rows, "groups int, shard int, gid long")


@query(f"WITH {RING} SELECT CAST(shard AS INTEGER) AS shard, CAST(arg_min(gid, (place, gid)) AS BIGINT) AS gid FROM near WHERE gid <= 5 GROUP BY shard")
def ring_owner(spark, d):
    ring = placement.Ring([1, 2, 3, 4, 5])
    return spark.createDataFrame([(s, ring.owner(s)) for s in range(SHARDS)], "shard int, gid long")


@query(f"WITH RECURSIVE {CFG} SELECT num, gid, count(*) AS shards FROM cfg GROUP BY ALL")
def cfg_history(spark, d):
    return placement.table(spark, CONFIGS).groupBy("num", "gid").agg(F.count("*").alias("shards"))


@query(f"WITH RECURSIVE {CFG} SELECT 'negative' AS asked, * FROM cfg WHERE num = (SELECT max(num) FROM cfg) UNION ALL SELECT 'third', * FROM cfg WHERE num = 3 UNION ALL SELECT 'past', * FROM cfg WHERE num = (SELECT max(num) FROM cfg)")
def cfg_query(spark, d):
    cfg = placement.table(spark, CONFIGS)
    parts = [placement.query(cfg, n).select(F.lit(name).alias("asked"), "num", "shard", "gid") for name, n in (("negative", -1), ("third", 3), ("past", 99))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {LATE}, a AS (SELECT *, seq > coalesce(max(seq) OVER (PARTITION BY client_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ok FROM log) SELECT client_id % 10 AS bucket, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS duplicates FROM a GROUP BY 1")
def ctrl_dedup(spark, d):
    """The controller's rule: numbers of a client count over all shards."""
    log = kv_log_reordered(spark, d).withColumn("shard", F.lit(0)).withColumn("op", F.lit("JOIN"))
    out = state.accepted(log).groupBy((F.col("client_id") % 10).alias("bucket"))
    return out.agg(F.count(F.when(F.col("accepted"), 1)).alias("accepted"), F.count(F.when(~F.col("accepted"), 1)).alias("duplicates"))


MOVED = "mv AS (SELECT *, lag(gid) OVER (PARTITION BY shard ORDER BY num) AS prev_gid FROM cfg), tr AS (SELECT num, shard, gid, prev_gid, CASE WHEN gid = 0 THEN 0 WHEN prev_gid = 0 THEN 1 ELSE 2 END AS gained_state, CASE WHEN prev_gid = 0 THEN 0 ELSE 3 END AS lost_state FROM mv WHERE prev_gid <> gid)"


@query(f"WITH RECURSIVE {CFG}, {MOVED} SELECT * FROM tr")
def shard_transitions(spark, d):
    return placement.transitions(placement.table(spark, CONFIGS))


@query(f"WITH RECURSIVE {CFG}, {MOVED} SELECT num, gid, prev_gid, string_agg(shard, ',' ORDER BY shard) AS shards, count(*) AS moves FROM tr WHERE gained_state = 2 GROUP BY num, gid, prev_gid")
def migration_plan(spark, d):
    return placement.plan(placement.table(spark, CONFIGS))


@query("SELECT user_id % 7 AS node, bool_and((CASE WHEN user_id % 7 = 3 THEN 4 ELSE 5 END) = 5 AND (CASE WHEN event_id % 1009 = 0 THEN 2 ELSE event_id % 2 END) IN (0, 1)) AS settled FROM events GROUP BY 1")
def cfg_settled(spark, d):
    node = F.col("user_id") % 7
    states = table(spark, d, "events").select(node.alias("node"), F.when(node == 3, 4).otherwise(5).alias("num"), F.when(F.col("event_id") % 1009 == 0, 2).otherwise(F.col("event_id") % 2).alias("state"))
    return placement.settled(states, 5)


@query(
    """WITH s AS (SELECT event_id % 5 AS state, CASE event_id // 5 % 3 WHEN 0 THEN 'install' WHEN 1 THEN 'cleaned' ELSE 'delete' END AS event FROM events)
SELECT state, event, CASE WHEN event = 'install' AND state = 2 THEN 4 WHEN event = 'cleaned' AND state = 4 THEN 1 WHEN event = 'delete' AND state = 3 THEN 0 ELSE state END AS after, count(*) AS n FROM s GROUP BY ALL"""
)
def shard_states(spark, d):
    e = F.col("event_id")
    event = F.element_at(F.array(F.lit("install"), F.lit("cleaned"), F.lit("delete")), (F.floor(e / 5) % 3 + 1).cast("int"))
    rows = table(spark, d, "events").select((e % 5).alias("state"), event.alias("event"))
    return rows.withColumn("after", placement.next_state(F.col("state"), F.col("event"))).groupBy("state", "event", "after").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {LATEST} SELECT range AS gid FROM range(1, 9) WHERE range NOT IN (SELECT gid FROM latest)")
def bootstrap_groups(spark, d):
    return placement.missing_groups(spark.range(1, 9).withColumnRenamed("id", "gid"), placement.table(spark, CONFIGS))


HELD = "held AS (SELECT 'data' AS kind, shard, key, value FROM st UNION ALL SELECT 'dedup', shard, CAST(client_id AS VARCHAR), CAST(max(seq) AS VARCHAR) FROM acc GROUP BY shard, client_id)"


def _held(spark, d) -> DataFrame:
    log = kv_log(spark, d)
    return placement.store(state.replay(log), state.last_numbers(log))


@query(f"WITH {LOG}, {_state()}, {HELD} SELECT * FROM held WHERE shard = 21")
def shard_export(spark, d):
    return placement.export(_held(spark, d), [21])


@query(
    f"""WITH {LOG}, {_state()}, {HELD} SELECT kind, shard, key, CASE WHEN shard <> 21 THEN value WHEN kind = 'data' THEN value || '+' ELSE CAST(CAST(value AS BIGINT) + 1 AS VARCHAR) END AS value FROM held WHERE shard = 21 OR shard < 16"""
)
def shard_install(spark, d):
    """Shards 21 and 22 come to a group that pulls 21; then each of its keys is written again, and the image comes a second time."""
    held = _held(spark, d)
    image = placement.export(held, [21, 22])
    states = spark.createDataFrame([(s, 2 if s == 21 else int(s < 16), 7) for s in range(SHARDS)], "shard int, state int, num long")
    target = placement.install(held.where("shard < 16"), image, states, 7)
    states = placement.installed(states, [21, 22], 7)
    again = F.when(F.col("kind") == "data", F.concat("value", F.lit("+"))).otherwise((F.col("value").cast("long") + 1).cast("string"))
    target = target.withColumn("value", F.when(F.col("shard") == 21, again).otherwise(F.col("value")))
    return placement.install(target, image, states, 7)


@query(f"WITH RECURSIVE {CFG}, {MOVED}, {LOG}, {_state()} SELECT key, shard, value FROM st WHERE shard NOT IN (SELECT shard FROM tr WHERE num = 4 AND lost_state = 3)")
def shard_delete(spark, d):
    offered = placement.transitions(placement.table(spark, CONFIGS)).where("num = 4 AND lost_state = 3")
    return placement.delete(state.replay(kv_log(spark, d)), offered)


@query(f"WITH {LOG}, {_state()} SELECT shard, key, value FROM st")
def snapshot_roundtrip(spark, d):
    """A state as images of pairs of one shard each, and back."""
    return codecs.unpacked(codecs.packed(state.replay(kv_log(spark, d))))


@query("WITH p AS (SELECT s_suppkey AS node, s_suppkey % 3 AS side FROM supplier) SELECT a.node AS from_node, count(*) AS reached FROM p a JOIN p b ON a.side = b.side AND a.node <> b.node GROUP BY 1")
def reachability(spark, d):
    """Nodes reach those of their side of a partition; counts of sides, so no pairs are made."""
    side = (F.col("s_suppkey") % 3).alias("side")
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("from_node"), side)
    sizes = p.groupBy("side").agg(F.count("*").alias("n"))
    return p.join(F.broadcast(sizes), "side").where("n > 1").select("from_node", (F.col("n") - 1).alias("reached"))


# Histories

HIST = """h AS (SELECT 'k' || json_extract_string(props, '$.k') || '.' || (event_id // 400) AS key, event_id, CASE event_type WHEN 'view' THEN 'get' WHEN 'purchase' THEN 'append' ELSE 'put' END AS op, '[' || event_id || ']' AS value, event_id * 10 AS call_ns, event_id * 10 + 4 + event_id % 17 AS return_ns FROM events),
hh AS (SELECT *, CASE WHEN op = 'get' AND event_id % 5 <> 0 THEN 'seen' ELSE '' END AS out FROM h)"""


def _stale_history(spark, d):
    ev = table(spark, d, "events")
    op = F.when(F.col("event_type") == "view", "get").when(F.col("event_type") == "purchase", "append").otherwise("put")
    key = F.concat(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("."), F.floor(F.col("event_id") / 400))
    h = ev.select(key.alias("key"), "event_id", op.alias("op"), F.concat(F.lit("["), "event_id", F.lit("]")).alias("value"), (F.col("event_id") * 10).alias("call_ns"), (F.col("event_id") * 10 + 4 + F.col("event_id") % 17).alias("return_ns"))
    return h.withColumn("out", F.when((F.col("op") == "get") & (F.col("event_id") % 5 != 0), "seen").otherwise(""))


@query(f"WITH {HIST}, w AS (SELECT key, min(return_ns) AS written FROM hh WHERE op = 'put' GROUP BY key) SELECT key, count(*) AS reads FROM hh JOIN w USING (key) WHERE op = 'get' AND out = '' AND written < call_ns GROUP BY key")
def lin_stale_reads(spark, d):
    return history.stale_reads(_stale_history(spark, d))


@query("WITH h AS (SELECT 'k' || json_extract_string(props, '$.k') || '.' || (event_id // 2000) AS key, event_type = 'view' AND event_id % 499 = 0 AS wrong FROM events WHERE event_type <> 'error') SELECT key, count(*) AS ops, CASE WHEN bool_or(wrong) THEN 'Illegal' ELSE 'Ok' END AS verdict FROM h GROUP BY key")
def lin_check(spark, d):
    """Each key's events as a history with some overlap, where each read gives what the order of calls says, but for planted reads of what was never written."""
    log = commands(spark, d).where("op <> 'DELETE'").withColumn("key", F.concat("key", F.lit("."), F.floor(F.col("event_id") / 2000)))
    order = Window.partitionBy("key").orderBy("event_id")
    put = F.max(F.when(F.col("op") == "PUT", F.col("event_id"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = log.withColumn("epoch", F.coalesce(put, F.lit(-1)))
    upto = Window.partitionBy("key", "epoch").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    value = F.array_join(F.collect_list(F.when(F.col("op") != "GET", F.col("val"))).over(upto), "")
    out = F.when(F.col("op") == "GET", F.when(F.col("event_id") % 499 == 0, "stale").otherwise(value))
    call = F.col("event_id") * 10
    hist = marked.select("key", F.lower("op").alias("op"), F.col("val").alias("value"), out.alias("out"), call.alias("call_ns"), (call + 5 + F.col("event_id") % 3 * 400).alias("return_ns"))
    return history.check(hist)


@query(
    """WITH w AS (SELECT c.range AS client, n.range AS n FROM range(6) c, range(100) n), r AS (SELECT client, n, CAST('0x' || substr(md5('9:op:' || client || ':' || n), 1, 12) AS BIGINT) % 10 AS p, CAST('0x' || substr(md5('9:key:' || client || ':' || n), 1, 12) AS BIGINT) % 4 AS k FROM w)
SELECT CAST(client AS INTEGER) AS client, CAST(n AS INTEGER) AS n, CASE WHEN p < 5 THEN 'get' WHEN p < 7 THEN 'put' ELSE 'append' END AS op, 'k' || k AS key, CASE WHEN p >= 5 THEN '[' || client || '.' || n || ']' END AS value FROM r"""
)
def lin_workload(spark, d):
    return history.workload(spark, 6, 100, 4, 9)


@query("SELECT event_id AS seed, CASE WHEN event_id % 10 = 0 THEN 'sharded' ELSE list_extract(['basic', 'unreliable', 'partitions', 'crash'], CAST(event_id % 4 + 1 AS INTEGER)) END AS scenario FROM events")
def lin_pick(spark, d):
    return history.pick(table(spark, d, "events").select(F.col("event_id").alias("seed")), 10, ["basic", "unreliable", "partitions", "crash"])


RUNS = "r AS (SELECT event_type AS scenario, CASE WHEN event_id % 50 = 0 THEN 'error' WHEN event_id % 77 = 0 THEN 'unknown' WHEN event_id % 91 = 0 THEN 'illegal' ELSE 'ok' END AS verdict, 100 + event_id % 400 AS ops FROM events)"


@query(
    f"""WITH {RUNS} SELECT coalesce(scenario, 'TOTAL') AS scenario, count(*) AS runs, count(*) FILTER (verdict = 'ok') AS ok, count(*) FILTER (verdict = 'illegal') AS illegal, count(*) FILTER (verdict = 'unknown') AS unknown, count(*) FILTER (verdict = 'error') AS error,
CAST(coalesce(sum(ops) FILTER (verdict <> 'error'), 0) AS BIGINT) AS ops, min(ops) FILTER (verdict <> 'error') AS min_ops, coalesce(sum(ops) FILTER (verdict <> 'error'), 0) / greatest(count(*), 1) AS mean_ops FROM r GROUP BY ROLLUP (scenario)"""
)
def lin_rollup(spark, d):
    e = F.col("event_id")
    verdict = F.when(e % 50 == 0, "error").when(e % 77 == 0, "unknown").when(e % 91 == 0, "illegal").otherwise("ok")
    return history.roll_up(table(spark, d, "events").select(F.col("event_type").alias("scenario"), verdict.alias("verdict"), (100 + e % 400).alias("ops")))


@query("SELECT 'o' || o_orderkey AS key, 'v-o' || o_orderkey AS value, CASE WHEN o_orderkey % 1000 = 7 THEN NULL ELSE 'old' END AS found FROM orders WHERE o_orderkey % 1000 = 7 OR o_orderkey % 1500 = 11")
def acked_lost(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("o"), "o_orderkey").alias("key"))
    held = orders.where("o_orderkey % 1000 <> 7").select("key", F.when(F.col("o_orderkey") % 1500 == 11, "old").otherwise(F.concat(F.lit("v-"), "key")).alias("value"))
    return history.lost_writes(orders.select("key", F.concat(F.lit("v-"), "key").alias("value")), held)


KILLED = "it AS (SELECT range AS it, CASE range % 3 WHEN 0 THEN 'leader' WHEN 1 THEN 'minority' ELSE 'all' END AS kind FROM range(64)), acked AS (SELECT o_orderkey % 60 AS it, 'o' || o_orderkey AS key, 'v-o' || o_orderkey AS value FROM orders)"


@query(
    f"""WITH {KILLED}, per AS (SELECT it, kind, coalesce(n, 0) AS acked, coalesce(sum(coalesce(n, 0)) OVER (ORDER BY it ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS older FROM it LEFT JOIN (SELECT it, count(*) AS n FROM acked GROUP BY it) USING (it)),
pl AS (SELECT *, row_number() OVER (ORDER BY it, key) - 1 AS place FROM acked), j AS (SELECT range AS j FROM range(200)),
dr AS (SELECT it, CAST('0x' || substr(md5('1:' || it || ':' || j), 1, 12) AS BIGINT) % {1 << 40} % CAST(older AS BIGINT) AS place FROM per, j WHERE older > 0),
asked AS (SELECT it, key, value FROM acked UNION ALL SELECT dr.it, key, value FROM dr JOIN pl USING (place)),
held AS (SELECT key, CASE WHEN substr(key, 2)::BIGINT % 1500 = 11 THEN 'old' ELSE value END AS found FROM acked WHERE substr(key, 2)::BIGINT % 1000 <> 7),
c AS (SELECT it, count(*) AS checked, count(*) FILTER (value IS DISTINCT FROM found) AS lost FROM asked LEFT JOIN held USING (key) GROUP BY it)
SELECT it, kind, acked, coalesce(checked, 0) AS checked, coalesce(lost, 0) AS lost, coalesce(lost, 0) = 0 AND (acked > 0 OR kind = 'all') AS valid FROM per LEFT JOIN c USING (it)"""
)
def crash_audit(spark, d):
    """64 iterations of kills; the last four acknowledge nothing."""
    orders = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("o"), "o_orderkey").alias("key"))
    acked = orders.select((F.col("o_orderkey") % 60).alias("it"), "key", F.concat(F.lit("v-"), "key").alias("value"))
    held = orders.where("o_orderkey % 1000 <> 7").select("key", F.when(F.col("o_orderkey") % 1500 == 11, "old").otherwise(F.concat(F.lit("v-"), "key")).alias("value"))
    kind = F.when(F.col("id") % 3 == 0, "leader").when(F.col("id") % 3 == 1, "minority").otherwise("all")
    return history.crash_audit(acked, held, spark.range(64).select(F.col("id").alias("it"), kind.alias("kind")))


@query(
    """WITH w AS (SELECT l_orderkey % 500 AS run, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey % 500 ORDER BY l_orderkey, l_linenumber) - 1 AS pos FROM lineitem),
n AS (SELECT run, count(*) AS n FROM w GROUP BY run)
SELECT run, n, n - run % 4 AS recovered, n - run % 3 AS acked, n - run % 4 >= n - run % 3 AS valid FROM n"""
)
def wal_prefix_check(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("run"), "l_orderkey", "l_linenumber")
    pos = F.row_number().over(Window.partitionBy("run").orderBy("l_orderkey", "l_linenumber")) - 1
    rows = li.select("run", pos.alias("pos"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("data")).withColumn("n", F.count("*").over(Window.partitionBy("run")))
    written = rows.select("run", "pos", "data", (F.col("pos") < F.col("n") - F.col("run") % 3).alias("acked"))
    return history.prefix_check(written, rows.where(F.col("pos") < F.col("n") - F.col("run") % 4).select("run", "pos", "data"))


@query("SELECT o_custkey % 40 AS run, count(*) AS framed, CASE WHEN (o_custkey % 40) % 2 = 0 THEN count(*) ELSE count(*) // 2 END AS valid FROM orders GROUP BY o_custkey % 40")
def wal_valid_prefix(spark, d):
    """Frames of each run's orders; every second run has one damaged byte in its middle record."""

    def one(t):
        import pandas as pd

        run, n = int(t["run"].iloc[0]), len(t)
        frames = [codecs.frame(k % 7, str(x).encode()) for k, x in enumerate(sorted(t["o_orderkey"]))]
        if run % 2:
            bad = frames[n // 2]
            frames[n // 2] = bad[:-1] + bytes([bad[-1] ^ 1])
        return pd.DataFrame({"run": [run], "framed": [n], "valid": [len(codecs.valid_prefix(b"".join(frames))[0])]})

    orders = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("run"), "o_orderkey")
    return orders.groupBy("run").applyInPandas(one, "run long, framed long, valid long")


# Measurements

RANK = "greatest(1, least(n, CAST(floor({q} * n + 0.5) AS BIGINT)))"


@query(f"WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(n) AS samples, min(value) FILTER (k = {RANK.format(q=0.5)}) AS p50, min(value) FILTER (k = {RANK.format(q=0.9)}) AS p90, min(value) FILTER (k = {RANK.format(q=0.99)}) AS p99 FROM r GROUP BY event_type")
def latency_percentiles(spark, d):
    return measure.percentiles(table(spark, d, "events"), "event_type", "value", (0.5, 0.9, 0.99))


@query("SELECT event_type = 'view' AS is_read, count(*) AS ops, round(count(*) / greatest(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 1e-6), 9) AS ops_per_sec FROM events GROUP BY 1")
def throughput(spark, d):
    ev = table(spark, d, "events").select((F.col("event_type") == "view").alias("is_read"), "ts")
    return measure.throughput(ev, ["is_read"], "ts").withColumn("ops_per_sec", F.round("ops_per_sec", 9))


@query("SELECT date_trunc('second', ts) AS start, count(*) AS ops FROM events GROUP BY 1")
def ops_per_second(spark, d):
    return measure.per_window(table(spark, d, "events"), "ts", "1 second")


@query("SELECT user_id % 20 AS client, count(*) FILTER (event_type = 'view') AS reads, count(*) FILTER (event_type <> 'view') AS writes FROM events GROUP BY 1")
def read_write_split(spark, d):
    read = F.col("event_type") == "view"
    return table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("client")).agg(F.count(F.when(read, 1)).alias("reads"), F.count(F.when(~read, 1)).alias("writes"))


@query("WITH b AS (SELECT 1e-4::DOUBLE * (1 << i) AS le FROM range(16) t(i) UNION ALL SELECT 'inf'::DOUBLE) SELECT event_type, le, count(*) FILTER (value / 1000 <= le) AS n FROM events, b GROUP BY ALL")
def latency_histogram(spark, d):
    return measure.histogram(table(spark, d, "events"), "event_type", F.col("value") / 1000)


@query("WITH r AS (SELECT o_custkey AS run, o_custkey % 25 AS config, round(sum(o_totalprice), 2) AS rate, count(*) AS ops FROM orders GROUP BY o_custkey), k AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY rate, run) AS k, count(*) OVER (PARTITION BY config) AS n FROM r) SELECT run, config, rate, ops FROM k WHERE k = n // 2 + 1")
def median_run(spark, d):
    runs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.round(F.sum("o_totalprice"), 2).alias("rate"), F.count("*").alias("ops"))
    return measure.median_run(runs.select("run", (F.col("run") % 25).alias("config"), "rate", "ops"), "config", "rate", "run")


@query("WITH o AS (SELECT user_id % 9 AS group_id, event_id, CASE WHEN event_type = 'error' THEN -1 ELSE event_id // 50 % 3 END AS leader FROM events), l AS (SELECT *, lag(leader, 1, -1) OVER (PARTITION BY group_id ORDER BY event_id) AS prev FROM o) SELECT group_id, count(*) FILTER (leader <> -1 AND leader <> prev) AS changes FROM l GROUP BY group_id")
def leader_changes(spark, d):
    leader = F.when(F.col("event_type") == "error", -1).otherwise(F.floor(F.col("event_id") / 50) % 3)
    return measure.leader_changes(table(spark, d, "events").select((F.col("user_id") % 9).alias("group_id"), "event_id", leader.alias("leader")), "group_id", "event_id")


@query("SELECT user_id % 9 AS group_id, event_id % 4 AS peer, arg_max(event_id % 13, event_id) AS lag FROM events GROUP BY ALL")
def replication_lag(spark, d):
    ev = table(spark, d, "events").select((F.col("user_id") % 9).alias("group_id"), (F.col("event_id") % 4).alias("peer"), "event_id", F.col("event_id").alias("last_idx"), (F.col("event_id") - F.col("event_id") % 13).alias("match_idx"))
    return measure.lag(ev, ["group_id", "peer"], "event_id")


@query(f"WITH {LOG} SELECT shard, max(idx) AS last_idx, max(idx) FILTER (op <> 'GET') AS applied, count(*) AS entries, count(DISTINCT client_id) AS clients FROM log GROUP BY shard")
def state_gauges(spark, d):
    return kv_log(spark, d).groupBy("shard").agg(F.max("idx").alias("last_idx"), F.max(F.when(F.col("op") != "GET", F.col("idx"))).alias("applied"), F.count("*").alias("entries"), F.count_distinct("client_id").alias("clients"))


PCT = "coalesce(max(us) FILTER (k = greatest(1, least(n, CAST(floor({q} * n + 0.5) AS BIGINT))) AND part = '{p}'), 0) / 1000 AS {c}"
PARTS = [("all", 0.5, "p50_ms"), ("all", 0.99, "p99_ms"), ("all", 0.999, "p999_ms"), ("read", 0.5, "read_p50_ms"), ("read", 0.99, "read_p99_ms"), ("write", 0.5, "write_p50_ms"), ("write", 0.99, "write_p99_ms")]


@query(
    f"""WITH runs AS (SELECT range AS run, TIMESTAMP '2024-01-05' AS a, TIMESTAMP '2024-01-25' AS b FROM range(6)), s AS (SELECT user_id % 5 AS run, ts, event_type <> 'error' AND user_id % 5 <> 4 AS ok, event_type = 'view' AS is_read, CAST(floor(value * 1234567) AS BIGINT) AS lat_ns FROM events WHERE value IS NOT NULL),
i AS (SELECT * FROM s JOIN runs USING (run) WHERE ts >= a AND ts < b), d AS (SELECT run, unnest(['all', CASE WHEN is_read THEN 'read' ELSE 'write' END]) AS part, lat_ns // 1000 AS us FROM i WHERE ok),
r AS (SELECT *, row_number() OVER (PARTITION BY run, part ORDER BY us) AS k, count(*) OVER (PARTITION BY run, part) AS n FROM d),
g AS (SELECT run, count(*) FILTER (part = 'all') AS ops, count(*) FILTER (part = 'read') AS reads, count(*) FILTER (part = 'write') AS writes, {", ".join(PCT.format(p=p, q=q, c=c) for p, q, c in PARTS)} FROM r GROUP BY run),
e AS (SELECT run, count(*) AS errors FROM i WHERE NOT ok GROUP BY run)
SELECT run, 1728000.0::DOUBLE AS seconds, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("ops", "reads", "writes", *(x[2] for x in PARTS), "errors"))}, coalesce(ops, 0) / 1728000.0::DOUBLE AS ops_per_sec FROM runs LEFT JOIN g USING (run) LEFT JOIN e USING (run)"""
)
def bench_report(spark, d):
    """Twenty days as the measured window; run 4 has failures only, and run 5 nothing."""
    run = F.col("user_id") % 5
    samples = table(spark, d, "events").where("value is not null").select(run.alias("run"), F.col("ts").alias("at"), ((F.col("event_type") != "error") & (run != 4)).alias("ok"), (F.col("event_type") == "view").alias("is_read"), F.floor(F.col("value") * 1234567).alias("lat_ns"))
    kind = dict(table(spark, d, "events").dtypes)["ts"]
    runs = spark.range(6).select(F.col("id").alias("run"), F.lit("2024-01-05").cast(kind).alias("start"), F.lit("2024-01-25").cast(kind).alias("stop"))
    return measure.bench_report(samples, runs)


@query(
    """WITH s AS (SELECT user_id % 9 AS group_id, event_id AS n, CASE WHEN event_id % 23 = 0 THEN 'compact' ELSE 'flush' END AS step, event_id % 7 * 100 AS bytes FROM events), l AS (SELECT *, n >= coalesce(max(n) FILTER (step = 'compact') OVER (PARTITION BY group_id), -1) AND bytes > 0 AS live FROM s)
SELECT group_id, count(*) FILTER (live) AS tables, CAST(coalesce(sum(bytes) FILTER (live), 0) AS BIGINT) AS table_bytes, count(*) FILTER (step = 'flush') AS flushes, count(*) FILTER (step = 'compact') AS compactions FROM l GROUP BY group_id"""
)
def store_gauges(spark, d):
    e = F.col("event_id")
    steps = table(spark, d, "events").select((F.col("user_id") % 9).alias("group_id"), e.alias("n"), F.when(e % 23 == 0, "compact").otherwise("flush").alias("step"), (e % 7 * 100).alias("bytes"))
    return measure.store_gauges(steps)


@query(
    """WITH o AS (SELECT user_id % 9 AS group_id, event_id, event_id // 50 AS term, CASE WHEN event_type = 'error' THEN -1 ELSE event_id // 50 % 3 END AS leader, event_id - event_id % 13 AS commit_idx, event_id - event_id % 29 AS applied FROM events)
SELECT group_id, max(term) AS term, arg_max(leader, event_id) AS leader, max(commit_idx) AS commit_idx, max(least(applied, commit_idx)) AS applied, max(event_id) - min(event_id) + 1 AS entries FROM o GROUP BY group_id"""
)
def raft_gauges(spark, d):
    e = F.col("event_id")
    leader = F.when(F.col("event_type") == "error", -1).otherwise(F.floor(e / 50) % 3)
    seen = table(spark, d, "events").select((F.col("user_id") % 9).alias("group_id"), e.alias("at"), F.floor(e / 50).alias("term"), leader.alias("leader"), (e - e % 13).alias("commit_idx"), F.least(e - e % 29, e - e % 13).alias("applied"), e.alias("idx"))
    return measure.raft_gauges(seen, "group_id", "at")


@query(
    """WITH p AS (SELECT -1 AS client, CAST(range AS INTEGER) AS n, 'put' AS op, 'key' || lpad(CAST(range AS VARCHAR), 8, '0') AS key, repeat('v', 100) AS value FROM range(50)), w AS (SELECT c.range AS client, n.range AS n FROM range(8) c, range(200) n),
r AS (SELECT client, n, CAST('0x' || substr(md5('3:read:' || client || ':' || n), 1, 12) AS BIGINT) % 1000 < 900 AS rd, CAST('0x' || substr(md5('3:key:' || client || ':' || n), 1, 12) AS BIGINT) % 50 AS k FROM w)
SELECT * FROM p UNION ALL SELECT CAST(client AS INTEGER), CAST(n AS INTEGER), CASE WHEN rd THEN 'get' ELSE 'put' END, 'key' || lpad(CAST(k AS VARCHAR), 8, '0'), CASE WHEN NOT rd THEN repeat('v', 100) END FROM r"""
)
def bench_load(spark, d):
    return measure.load(spark, 8, 200, 50, 0.9, 100, 3)


# Streaming


@query(f"WITH {LATE}, {ACC} {DEDUP}")
def stream_dedup(spark, d):
    """The reordered log as files of a stream; the same result as in one batch."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    log = kv_log_reordered(spark, d).select("shard", "client_id", "idx", "seq", "op", "key", "val")
    edges = log.agg(F.expr("percentile_approx(idx, 0.5)")).head()[0]
    schema = log.schema
    # two halves in the order of the log, each in a micro-batch of its own
    for k, part in enumerate((log.where(F.col("idx") <= (edges or 0)), log.where(F.col("idx") > (edges or 0)))):
        part.write.mode("append").parquet(f"{base}/in/part={k}")
        state_stream.run_available(spark, f"{base}/in/part=*", schema, f"{base}/out", f"{base}/checkpoint", files=1 << 20)
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy("shard").agg(F.count(F.when(F.col("accepted"), 1)).alias("accepted"), F.count(F.when(~F.col("accepted"), 1)).alias("duplicates"))
