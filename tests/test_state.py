"""The log's state against a brute-force fold, with numbers out of order, number 0 and shards that aren't owned."""

import random

import pytest
from pyspark.sql import functions as F

from loomlog.functions.hashing import key_shard
from loomlog.operators import history, lsm, measure, placement, raft, state

LOG = "idx long, client_id long, seq long, op string, key string, val string, shard int"


def random_log(seed, n=120):
    rng = random.Random(seed)
    rows, seqs = [], {}
    for idx in range(1, n):
        c = rng.randrange(4)
        seqs[c] = seqs.get(c, -1) + 1
        seq = max(0, seqs[c] - rng.choice([0, 0, 0, 1, 2]))
        k = rng.randrange(6)
        rows.append((idx, c, seq, rng.choice(["PUT", "APPEND", "APPEND", "DELETE", "GET"]), f"k{k}", f"[{idx}]", k % 3))
    return rows


def fold(rows, owned=lambda s: True, dedup=True):
    last, kv, effect = {}, {}, []
    for idx, c, seq, op, key, val, shard in sorted(rows):
        if op == "GET" or not owned(shard) or dedup and seq <= last.get((shard, c), 0):
            continue
        last[shard, c] = seq
        effect.append(idx)
        if op == "PUT":
            kv[key] = val
        elif op == "APPEND":
            kv[key] = kv.get(key, "") + val
        else:
            kv.pop(key, None)
    return kv, effect


@pytest.mark.parametrize("seed", range(6))
def test_replay_is_the_fold(spark, seed):
    rows = random_log(seed)
    log = spark.createDataFrame(rows, LOG).repartition(3)
    assert {r["key"]: r["value"] for r in state.replay(log).collect()} == fold(rows)[0]
    assert {r["key"]: r["value"] for r in state.replay(log, 60).collect()} == fold([r for r in rows if r[0] <= 60])[0]
    effect = state.statuses(log, F.col("shard") != 1).where("effect").select("idx").collect()
    assert sorted(r[0] for r in effect) == fold(rows, lambda s: s != 1)[1]


def test_numbers_out_of_order_tell_a_running_maximum_from_a_set(spark):
    rows = [(1, 1, 1, "PUT", "a", "x", 0), (2, 1, 3, "APPEND", "a", "y", 0), (3, 1, 2, "APPEND", "a", "z", 0), (4, 2, 0, "PUT", "b", "n", 0)]
    log = spark.createDataFrame(rows, LOG)
    assert [(r["key"], r["value"]) for r in state.replay(log).collect()] == [("a", "xy")]
    assert fold(rows, dedup=False)[0] != fold(rows)[0]


def test_empty_and_missing_values_differ(spark):
    rows = [(1, 1, 1, "PUT", "", "", 0), (2, 1, 2, "APPEND", "é", "v", 0)]
    got = state.lookup(spark.createDataFrame([("",), ("é",), ("no",)], "key string"), state.replay(spark.createDataFrame(rows, LOG))).collect()
    assert {r["key"]: (r["value"], r["status"]) for r in got} == {"": ("", "OK"), "é": ("v", "OK"), "no": (None, "NO_KEY")}


def test_shards_of_known_keys(spark):
    def fnv(b):
        h = 2166136261
        for x in b:
            h = (h ^ x) * 16777619 % 2**32
        return h % 64

    keys = ["", "a", "foobar", "ключ", "é" * 50]
    got = spark.createDataFrame([(k,) for k in keys], "key string").select("key", key_shard(F.col("key")).alias("s")).collect()
    assert {r["key"]: r["s"] for r in got} == {k: fnv(k.encode()) for k in keys}


def test_merge_scan_and_compact(spark):
    rows = [(1, "a/1", 1, "old"), (1, "b/1", 1, "x"), (0, "a/1", 1, "new"), (0, "a/2", 0, None), (1, "a/2", 1, "two"), (0, "a/3", 1, "three")]
    t = spark.createDataFrame(rows, "source_rank int, key string, kind int, value string")
    assert [(r["key"], r["value"]) for r in lsm.scan(t, "a/").collect()] == [("a/1", "new"), ("a/3", "three")]
    assert [r["key"] for r in lsm.scan(t, "a/", 1).collect()] == ["a/1"]
    assert {(r["key"], r["kind"]) for r in lsm.merge(t).collect()} == {("a/1", 1), ("a/2", 0), ("a/3", 1), ("b/1", 1)}
    assert lsm.diff(lsm.compact(t.where("source_rank = 1")), lsm.compact(t)).count() == 3


def test_ring_assignments_keep_their_bounds():
    before = placement.assign([])
    counts = {1: [64], 2: [26, 38], 3: [17, 22, 25], 4: [15, 17, 19, 13], 5: [16, 16, 16, 11, 5], 8: [6, 10, 10, 10, 4, 9, 10, 5]}
    moved = []
    for n in range(1, 9):
        now = placement.assign(reversed(range(1, n + 1)))
        assert now == placement.assign(range(1, n + 1)) and max(map(now.count, set(now))) <= -(-64 * 5 // (4 * n))
        if n in counts:
            assert [now.count(g) for g in range(1, n + 1)] == counts[n]
        moved.append(sum(a != b for a, b in zip(before, now, strict=True)))
        before = now
    assert moved == [64, 38, 25, 13, 7, 10, 16, 10]
    pinned = placement.assign([1, 2], {5: 2, 6: 1, 7: 9})
    assert pinned[5] == 2 and pinned[6] == 1 and pinned[7] in (1, 2)


def test_invalid_moves_make_no_configuration():
    configs = placement.history([("join", [1]), ("move", 3, 7), ("move", 64, 1), ("leave", [5]), ("move", 3, 1)])
    assert [c.num for c in configs] == [0, 1, 2, 3] and configs[3].pinned == {3: 1}


def test_effective_log_against_a_fold(spark):
    rng = random.Random(3)
    for trial in range(4):
        rows, last, kept, base = [], 5, {}, 8
        for rec in range(60):
            idx = last + 1 if rng.random() < 0.7 else rng.randint(1, last + 1)
            rows.append((trial, rec, idx, f"c{rec}"))
            last = idx if idx > base else last
            if idx > base:
                kept = {i: c for i, c in kept.items() if i < idx} | {idx: f"c{rec}"}
        got = raft.effective(spark.createDataFrame(rows, "node int, rec_no int, idx long, cmd string"), base).collect()
        assert {r["idx"]: r["cmd"] for r in got} == kept and len(got) == len(kept)


def test_percentiles_take_the_nearest_rank(spark):
    rows = [("a", float(x)) for x in range(1, 11)] + [("b", 5.0)] * 7
    got = {r[0]: r for r in measure.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", (0.5, 0.99)).collect()}
    assert got["a"]["p50"] == 5.0 and got["a"]["p99"] == 10.0 and got["b"]["p50"] == got["b"]["p99"] == 5.0 and got["b"]["samples"] == 7


def test_illegal_histories_are_found():
    assert history.check_register([("put", "a", None, 0, 10), ("get", "", "", 20, 30)]) == "Illegal"
    assert history.check_register([("put", "a", None, 0, 40), ("get", "", "", 20, 30)]) == "Ok"
    assert history.check_register([("put", "a", None, 0, history.OPEN), ("get", "", "a", 20, 30), ("get", "", "", 40, 50)]) == "Illegal"
    assert history.check_register([("append", "a", None, 0, 9), ("append", "b", None, 1, 8), ("get", "", "ba", 10, 12)]) == "Ok"
    assert history.check_register([("append", "a", None, 0, 9), ("append", "b", None, 10, 18), ("get", "", "ba", 20, 22)]) == "Illegal"
    many = [("append", str(i), None, 0, 100) for i in range(14)] + [("get", "", "x", 101, 102)]
    assert history.check_register(many, states=2000) == "Unknown"
    assert history.check_register([]) == "Ok"


def test_leader_changes_count_none_as_a_state(spark):
    rows = [(0, t, x) for t, x in enumerate([1, 1, -1, 1, 2, -1, -1])]
    assert measure.leader_changes(spark.createDataFrame(rows, "g int, t int, leader int"), "g", "t").head()["changes"] == 3


def test_a_shard_moves_with_its_numbers_and_only_once(spark):
    """A retry after the move changes nothing, and an image that comes again after new writes doesn't undo them."""
    log = "idx long, client_id long, seq long, op string, key string, val string, shard int"
    before = spark.createDataFrame([(1, 1, 1, "PUT", "a", "x", 0), (2, 1, 2, "APPEND", "a", "y", 0), (3, 2, 1, "PUT", "b", "b", 1)], log)
    held = placement.store(state.replay(before), state.last_numbers(before))
    image = placement.export(held, [0])
    assert {r["kind"] for r in image.collect()} == {"data", "dedup"}
    states = spark.createDataFrame([(0, placement.PULLING, 4), (1, placement.PULLING, 4)], "shard int, state int, num long")
    empty = held.limit(0)
    assert placement.install(empty, image, states, 3).count() == 0  # another configuration
    target = placement.install(empty, image, states, 4)
    states = placement.installed(states, [0], 4)
    assert {r["shard"]: r["state"] for r in states.collect()} == {0: placement.CLEANING, 1: placement.PULLING}
    after = spark.createDataFrame([(4, 1, 2, "APPEND", "a", "y", 0), (5, 1, 3, "APPEND", "a", "z", 0)], log)
    moved = target.where("kind = 'data'").select("shard", "key", "value")
    now = state.replay(after, snapshot=moved, last=placement.last_numbers(target))
    assert [(r["key"], r["value"]) for r in now.collect()] == [("a", "xyz")]
    again = placement.install(placement.store(now, state.last_numbers(after)), image, states, 4)
    assert sorted((r["kind"], r["key"], r["value"]) for r in again.collect()) == [("data", "a", "xyz"), ("dedup", "1", "3")]


@pytest.mark.parametrize("seed", range(3))
def test_a_snapshot_and_the_rest_of_the_log_are_the_log(spark, seed):
    rows = [r for r in random_log(seed) if r[3] != "DELETE"]
    log = spark.createDataFrame(rows, LOG).repartition(2)
    first = log.where("idx <= 50")
    got = state.replay(log.where("idx > 50"), snapshot=state.replay(first), last=state.last_numbers(first)).collect()
    assert {r["key"]: r["value"] for r in got} == fold(rows)[0]


def test_gaps_and_snapshots_of_a_log(spark):
    rows = [(0, 1, 5, "a"), (0, 2, 6, "b"), (0, 3, 8, "c"), (0, 4, 6, "d"), (0, 5, 7, "e")]
    log = spark.createDataFrame(rows, "node int, rec_no int, idx long, cmd string")
    assert [(r["idx"], r["log_end"]) for r in raft.gaps(log, 4).collect()] == [(8, 6)]
    points = spark.createDataFrame([(0, 5, 2), (1, 9, 2)], "node int, base long, term int")
    for term, there in ((2, True), (1, False)):
        files = spark.createDataFrame([(0, 5, term)], "node int, idx long, term int")
        got = {r["node"]: tuple(r)[1:] for r in raft.recovered(log, points, files).collect()}
        assert got == {0: (5, there, 2, 6, 7), 1: (9, False, 0, None, None)}


def test_a_bloom_filter_misses_no_member(spark):
    def fnv(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = (h ^ x) * 0x100000001B3 % 2**64
        return h

    keys = spark.createDataFrame([(f"key-{i}",) for i in range(4000)] + [("é",), ("",)], "key string")
    bits = lsm.bloom_bits(4002)
    held = lsm.bloom(keys, "key", bits)
    others = keys.select(F.concat(F.lit("no-"), "key").alias("key"))
    assert lsm.might_contain(keys, "key", held, bits).where("not might_contain").count() == 0
    assert lsm.might_contain(others, "key", held, bits).where("might_contain").count() < 0.03 * 4002
    h = fnv("é".encode())
    want = {(h % 2**32 + i * (h >> 32 | 1)) % 2**32 % bits for i in range(7)}
    assert set(spark.createDataFrame([("é",)], "key string").select(lsm.probes(F.col("key"), bits).alias("p")).head()["p"]) == want


def test_a_report_of_no_operations_is_zero(spark):
    runs = spark.createDataFrame([(1, 0, 10), (2, 0, 10)], "run int, a long, b long").select("run", F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("b").alias("stop"))
    rows = [(1, 1, True, True, 1_999), (1, 2, True, False, 5_000_999), (1, 3, False, True, 9), (1, 10, True, True, 9), (1, -1, True, True, 9)]
    samples = spark.createDataFrame(rows, "run int, t long, ok boolean, is_read boolean, lat_ns long").select("run", F.timestamp_seconds("t").alias("at"), "ok", "is_read", "lat_ns")
    got = {r["run"]: r.asDict() for r in measure.bench_report(samples, runs).collect()}
    assert (got[1]["ops"], got[1]["errors"], got[1]["read_p50_ms"], got[1]["write_p99_ms"], got[1]["p50_ms"], got[1]["ops_per_sec"]) == (2, 1, 0.001, 5.0, 0.001, 0.2)
    assert set(v for k, v in got[2].items() if k not in ("run", "seconds")) == {0}


def test_a_load_repeats_for_a_seed(spark):
    got = measure.load(spark, 4, 300, 10, 0.9, 5, 1)
    ops = {r["op"]: r["count"] for r in got.where("client >= 0").groupBy("op").count().collect()}
    assert got.where("client = -1").count() == 10 and 1000 < ops["get"] < 1150 and sum(ops.values()) == 1200


def test_workloads_repeat_for_a_seed(spark):
    a, b = (sorted(map(str, history.workload(spark, 5, 200, 3, 7).repartition(k).collect())) for k in (1, 3))
    ops = history.workload(spark, 5, 200, 3, 7).groupBy("op").count().collect()
    assert a == b and len(a) == 1000 and 400 < {r["op"]: r["count"] for r in ops}["get"] < 600
