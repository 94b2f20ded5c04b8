"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

A configuration is a multiset of piece lengths that fits a sequence. The program asks for amounts of configurations that cover each
length's demand. Multiplicative weights solve it: lengths have prices; in each round a knapsack by dynamic programming over the
capacity gives, for each length, the best configuration with it; those of lengths that lag behind their demand are added, and
prices of lengths fall where the rounds so far gave too much of them. The rounds' mean is the fractional solution. It is rounded along
the order of its configurations, so that each comes as often as its amount says on the whole, for a share of it (SHARES); the
program is solved again for what is left, and the rest goes by best fit: the longest piece left, with the pieces that fill its sequence
best. The share that needs the fewest sequences counts. All of this works on the histogram, which has at most `capacity` entries whatever
the data, and is the same at every size. Pieces then find their place by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.llm.common import Scratch, arrow_map
from loomlog.llm.textbytes import column_bytes
from loomlog.llm.tokens import VOCABULARY, encoder

CAPACITY, END = 1024, 2
#: Rounds of the weights, the power by which prices follow what was served, solutions of the program, and shares of them that are taken.
ROUNDS, STEP, SOLUTIONS = 100, 0.1, 2
SHARES = (0.9, 1.0, 0.8, 0.7, 0.5, 0.3, 0.1)


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each filled capacity up to `capacity` a last piece of a best filling (0: one token stays free) and the tokens that the filling uses.

    prices by length, 0 for lengths that don't exist; pieces may repeat.
    """
    # best[capacity - c] is the value of capacity c, so that the values of c - 1, c - 2, .. lie in order
    best, choice, used = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    value = np.empty(capacity)
    for c in range(1, capacity + 1):
        v = np.add(best[capacity - c + 1 :], prices[1 : c + 1], out=value[:c])
        k, before = int(v.argmax()), best[capacity - c + 1]
        if prices[k + 1] > 0 and v[k] > before + 1e-12:
            best[capacity - c], choice[c], used[c] = v[k], k + 1, used[c - k - 1] + k + 1
        else:
            best[capacity - c], used[c] = before, used[c - 1]
    return choice, used


def filling(choice: np.ndarray, c: int) -> dict[int, int]:
    """Counts by length of the best filling of capacity c."""
    counts: dict[int, int] = {}
    while c > 0:
        if x := int(choice[c]):
            counts[x] = counts.get(x, 0) + 1
            c -= x
        else:
            c -= 1
    return counts


def fractional(demand: np.ndarray, capacity: int) -> list[tuple[int, float, dict[int, int]]]:
    """(tokens left free, amount, counts by length) of the configurations of a fractional solution of the program; tight ones and long pieces first."""
    lengths = np.flatnonzero(demand)
    want, size = demand.astype(float), np.arange(capacity + 1) / capacity
    sequences = float((want * size).sum())
    served = np.zeros(capacity + 1)
    found: dict[tuple, list] = {}
    for r in range(1, ROUNDS + 1):
        price = np.zeros(capacity + 1)
        price[lengths] = size[lengths] * (r * want[lengths] / (served[lengths] + want[lengths])) ** STEP
        choice, used = knapsack(price, capacity)
        # lengths that lag lead this round's configurations, in all as many as the demand's tokens need
        lag = np.maximum(r * want[lengths] - served[lengths], 0.0)
        lead = lag / lag.sum() * sequences
        for x, amount in zip(lengths.tolist(), lead.tolist(), strict=True):
            if amount <= 0:
                continue
            counts = filling(choice, capacity - x)
            counts[x] = counts.get(x, 0) + 1
            for y, n in counts.items():
                served[y] += n * amount
            entry = found.setdefault(tuple(sorted(counts.items(), reverse=True)), [capacity - x - int(used[capacity - x]), 0.0, counts])
            entry[1] += amount / ROUNDS
    return [tuple(e) for _, e in sorted(found.items(), key=lambda e: (e[1][0], [(-x, n) for x, n in e[0]]))]


def fullest(demand: np.ndarray, capacity: int) -> dict[int, int]:
    """The longest piece of the demand with those pieces of it that fill its sequence best, longer ones first."""
    lengths = np.flatnonzero(demand)[::-1].tolist()
    counts, room = {lengths[0]: 1}, capacity - lengths[0]
    items, reach = [], [1]
    mask = (2 << room) - 1
    for x in lengths:
        for _ in range(min(int(demand[x]) - counts.get(x, 0), room // x)):
            items.append(x)
            reach.append((reach[-1] | reach[-1] << x) & mask)
        if reach[-1] >> room & 1:
            break
    c = reach[-1].bit_length() - 1
    for x, before in zip(reversed(items), reversed(reach[:-1]), strict=True):
        if not before >> c & 1:
            counts[x] = counts.get(x, 0) + 1
            c -= x
    return counts


@dataclass(frozen=True)
class Plan:
    """Runs of equal sequences: for each length, intervals of ranks and where their pieces go."""

    rank: tuple[np.ndarray, ...]  # by length: first rank of each interval, ascending
    copies: tuple[np.ndarray, ...]  # pieces of the length in one sequence
    offset: tuple[np.ndarray, ...]  # place of the first of them
    sequence: tuple[np.ndarray, ...]  # id of the interval's first sequence
    sequences: int


def rounded(demand: np.ndarray, first: list, share: float, capacity: int) -> list[tuple[dict[int, int], int]]:
    """(counts by length, times) that serve all of the demand, from a share of the solution `first` and of those of what it leaves."""
    demand, runs = demand.copy(), []

    def take(counts: dict[int, int], times: int) -> None:
        times = min(times, *(int(demand[x]) // n for x, n in counts.items()))
        if times > 0:
            for x, n in counts.items():
                demand[x] -= n * times
            runs.append((counts, times))

    for k in range(SOLUTIONS):
        if not demand.any():
            break
        due = taken = 0
        for waste, amount, counts in first if not k else fractional(demand, capacity):
            if waste > 0:
                break  # best fit does as well
            due += amount * share
            if due - taken >= 1:
                take(counts, int(due) - taken)
                taken = int(due)
    while demand.any():
        counts = fullest(demand, capacity)
        take(counts, min(int(demand[x]) // n for x, n in counts.items()))
    return runs


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """histogram[l] pieces of length l, for l up to capacity."""
    demand = histogram.astype(np.int64).copy()
    demand[0] = 0
    whole = [({capacity: 1}, int(demand[capacity]))] if demand[capacity] else []
    demand[capacity] = 0
    least = max(-(-int((demand * np.arange(capacity + 1)).sum()) // capacity), int(demand[capacity // 2 + 1 :].sum()))
    first = fractional(demand, capacity) if demand.any() else []
    best, fewest = [], None
    for share in SHARES:
        runs = rounded(demand, first, share, capacity)
        if fewest is None or sum(t for _, t in runs) < fewest:
            best, fewest = runs, sum(t for _, t in runs)
        if fewest <= least:
            break
    runs = whole + best
    spans: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
    done, sequence = np.zeros(capacity + 1, np.int64), 0
    for counts, times in runs:
        offset = 0
        for length in sorted(counts, reverse=True):
            spans[length].append((int(done[length]), counts[length], offset, sequence))
            done[length] += counts[length] * times
            offset += length * counts[length]
        sequence += times
    column = lambda k: tuple(np.array([s[k] for s in x], np.int64) for x in spans)
    return Plan(column(0), column(1), column(2), column(3), sequence)


def _pieces(vocabulary: str, capacity: int):
    def make():
        from pyspark import TaskContext

        part, ranks = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, at = encoder(vocabulary).encode(*column_bytes(batch["text"]), END)
            size = np.diff(at)
            pieces = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = (size - 1) % capacity + 1
            stop = first[doc] + piece * capacity
            start = np.where(piece > 0, stop - capacity, 0)
            length, raw = stop - start, memoryview(ids.astype("<u4").view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((at[doc] + start).tolist(), (at[doc] + stop).tolist(), strict=True)]
            # ranks among pieces of a length: those of earlier batches, then those before it here
            order = np.argsort(length, kind="stable")
            counts = np.bincount(length, minlength=capacity + 1)
            local = np.empty(len(length), np.int64)
            local[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
            local += ranks[length]
            ranks[:] += counts
            return pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(local), pa.array(np.full(len(doc), part, np.int32))], ["doc_id", "piece", "start", "length", "ids_crc32", "local", "part"])

        return run

    return make


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs (doc_id, text).

    A null or empty text has the end id alone. Rows that repeat a doc_id are packed each on its own, with
    pieces from 0. A text of over `capacity` ids is cut so that only its first piece may be shorter. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = arrow_map(docs, _pieces(vocabulary, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, local long, part int", per_task=True, caches=True)
    pieces = scratch.write(pieces, "pieces")
    # ranks of a length: those in earlier partitions of the first pass, then those in its own, fixed by what was written
    counts = scratch.write(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[r["length"]] = r["n"]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    packed = plan(histogram, capacity)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = batch["length"].to_numpy(), batch["local"].to_numpy() + batch["before"].to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length):
            at = np.flatnonzero(length == x)
            k = np.searchsorted(packed.rank[x], rank[at], "right") - 1
            extra, copies = rank[at] - packed.rank[x][k], packed.copies[x][k]
            sequence[at] = packed.sequence[x][k] + extra // copies
            offset[at] = packed.offset[x][k] + extra % copies * x
        return pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = pieces.join(counts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", "local", "before")
    return arrow_map(placed, place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
