"""Documents that hold benchmark items, found by latent semantic retrieval.

Terms are words of letters and digits, hashed to TERMS columns and weighted by their inverse frequency in all passages.
A randomised SVD of the passages' TF-IDF matrix A gives the latent space: each partition sums a sparse random projection S A, in
which each passage adds to a few of ROWS rows with random signs, and the right singular vectors of the sum span the
space. Windows of each document slide in steps of STRIDE words; a window about as long as an item, and with at least
COSINE to it in the latent space, is a candidate, and so is any window in which enough of an item's rarest words stand for
PART of the item to be there in order, whatever its cosine. The longest common subsequence of the words decides: either most of the
item is there in order, or a good part of it and nearly all of its answer, the item's last sentence.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import Scratch, arrow_map, summed
from loomlog.llm.textbytes import ALNUM, U, column_bytes, fmix, words

TERMS = 1 << 14
RANK, ROWS, EACH = 96, 128, 4
COMMON = 4
STRIDE, PASSAGE = 8, 8  # words of a step; steps of a passage of the SVD
COSINE = 0.4
#: The shares of an item, and of its answer, that must be found in order.
ITEM, PART, ANSWER = 0.8, 0.6, 0.8
#: The share of an item that a window must have in the item's rarest words; more of them are looked for until that follows from PART.
SHARED = 0.3
#: Items that one pass holds, on the driver as in tasks; more items take more passes.
ITEMS = 8192
#: Words that are looked at together; a longer document is taken in parts that overlap by the longest window.
SPAN = 1 << 19


def _terms(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(50)).astype(np.int64)


def sketch(terms: np.ndarray, at: np.ndarray, first_word: np.ndarray, total: np.ndarray) -> None:
    """Adds to total: passages with each term, and the ROWS by TERMS projection. first_word seeds the signs of each document's passages."""
    size = STRIDE * PASSAGE
    count = -(-np.diff(at) // size)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    within = (np.arange(len(terms)) - at[doc]) // size
    key = (np.concatenate([[0], np.cumsum(count)[:-1]])[doc] + within) * TERMS + terms
    key.sort()
    seen = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    total[:TERMS] += np.bincount(seen % TERMS, minlength=TERMS)
    seed = fmix(first_word[doc] + within.astype(U) * U(0x9E3779B97F4A7C15))
    for k in range(EACH):
        row = (seed >> U(16 * k) & U(ROWS - 1)).astype(np.int64) + 1
        np.add.at(total, row * TERMS + terms, np.where(seed >> U(16 * k + 12) & U(1), 1.0, -1.0))


def _sketched(batch: pa.RecordBatch, total: np.ndarray) -> None:
    hashes, _, _, at = words(*column_bytes(batch["text"]), ALNUM)
    sketch(_terms(hashes), at, np.append(hashes, U(0))[np.minimum(at[:-1], len(hashes))], total)


def space_of(total: np.ndarray) -> np.ndarray:
    """TERMS by RANK: each term's coordinates with its weight. Terms of over COMMON times the median frequency, which say nothing of a passage, weigh 0."""
    df = total[:TERMS]
    if not np.any(df):
        return np.zeros((TERMS, RANK))
    most = COMMON * float(np.median(df[df > 0]))
    weight = np.maximum(np.log((1 + most) / (1 + df)), 0.0)
    # right singular vectors by way of the small side
    m = total[TERMS:].reshape(ROWS, TERMS) * weight
    w, v = np.linalg.eigh(m @ m.T)
    kept = np.flatnonzero(w > max(w.max(), 1e-300) * 1e-9)[::-1][:RANK]
    return weight[:, None] * (m.T @ (v[:, kept] / np.sqrt(w[kept])))


def latent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The latent space of all passages of all documents, and the passages with each term."""
    total = summed(docs.select("text"), _sketched, (1 + ROWS) * TERMS, "<f4")
    return (np.zeros((TERMS, RANK)), np.zeros(TERMS)) if total is None else (space_of(total), total[:TERMS])


def stepped(terms: np.ndarray, at: np.ndarray, table: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sums of table rows over each STRIDE words of each document, with `gap` rows of zeros after it, and the n + 1 step offsets; the last row of table is zero."""
    steps = -(-np.diff(at) // STRIDE)
    steps[steps > 0] += gap
    first = np.concatenate([[0], np.cumsum(steps)])
    padded = np.full(int(first[-1]) * STRIDE, len(table) - 1)
    padded[np.arange(len(terms)) + np.repeat(first[:-1] * STRIDE - at[:-1], np.diff(at))] = terms
    out, k = np.empty((int(first[-1]), table.shape[1]), np.float32), table.shape[1]
    held, ones = np.empty((256 * STRIDE, k), np.float32), np.ones((1, STRIDE), np.float32)
    for lo in range(0, len(out), 256):
        at_once = padded[lo * STRIDE : (lo + 256) * STRIDE]
        got = np.take(table, at_once, axis=0, out=held[: len(at_once)], mode="clip")
        np.matmul(ones, got.reshape(-1, STRIDE, k), out=out[lo : lo + 256, None])
    return out, first


def _with_zero(table: np.ndarray) -> np.ndarray:
    return np.concatenate([table, np.zeros((1, table.shape[1]))]).astype(np.float32)


@dataclass(frozen=True)
class Items:
    """Benchmark items, with their latent coordinates by the number of steps of the window that they are held against."""

    ids: list
    words: list[tuple[int, ...]]
    answer: list[int]  # the answer's number of words, at the end
    classes: dict[int, tuple[np.ndarray, np.ndarray]]
    steps: np.ndarray  # of the window that each is held against
    slot: np.ndarray  # its place in the class of these steps
    needed: np.ndarray  # places of a window that must hold rare words of an item for PART of it to be a subsequence, 1 at least
    rare: np.ndarray  # hashes of rare words, ascending
    holders: list[np.ndarray]  # the items with each of them


def _subsequence(item: tuple[int, ...], text: list[int], low: int = 0) -> int:
    """The length of the longest common subsequence of item[low:] and text, with a bit for each word of the item."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item[low:]):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(item) - low) - 1
    v = full
    for w in text:
        if m := masks.get(w):
            u = v & m
            v = (v + u | v - u) & full
    return len(item) - low - v.bit_count()


def prepare(rows: list[tuple], table: np.ndarray, df: np.ndarray) -> Items:
    """rows: (item_id, text). Items without a word can't be found and are left out."""
    col = pa.array([t or "" for _, t in rows], pa.string())
    data, off = column_bytes(col)
    hashes, starts, _, at = words(data, off, ALNUM)
    zero = _with_zero(table)
    ids, own, answer, classes, taken, slot = [], [], [], {}, [], []
    for i, (item, _) in enumerate(rows):
        h = hashes[at[i] : at[i + 1]]
        if not len(h):
            continue
        # the answer starts after the last full stop, question mark or line end before the last four words
        signs = np.flatnonzero(np.isin(data[off[i] : off[i + 1]], [10, 33, 46, 63])) + off[i]
        begin = starts[at[i] : at[i + 1]]
        breaks = np.searchsorted(begin, signs)
        breaks = breaks[breaks <= len(h) - 4]
        answer.append(len(h) - int(breaks[-1]) if len(breaks) and breaks[-1] > 0 else len(h))
        v = zero[_terms(h)].sum(axis=0)
        v = v / max(float(np.linalg.norm(v)), 1e-12)
        steps = -(-len(h) // STRIDE) + 1
        classes.setdefault(steps, ([], []))
        taken.append(steps)
        slot.append(len(classes[steps][0]))
        classes[steps][0].append(len(ids))
        classes[steps][1].append(v)
        ids.append(item)
        own.append(tuple(h.tolist()))
    # words of weight in the latent space, and the next rarest until a window must hold SHARED of the item in them; a
    # subsequence of PART of an item misses 1 - PART of its places at most
    rare, needed = [], []
    for x in own:
        times, miss = Counter(x), len(x) - int(np.ceil(PART * len(x)))
        term = dict(zip(times, _terms(np.array(list(times), U)).tolist(), strict=True))
        chosen, places = [], 0
        for w in sorted(times, key=lambda w: (df[term[w]], w)):
            if places >= miss + SHARED * len(x) and not zero[term[w]].any():
                break
            chosen.append(w)
            places += times[w]
        rare.append(chosen)
        needed.append(places - miss)
    held: dict[int, list[int]] = {}
    for j, r in enumerate(rare):
        for w in r:
            held.setdefault(w, []).append(j)
    order = sorted(held)
    return Items(ids, own, answer, {s: (np.array(k), np.array(v, np.float32)) for s, (k, v) in classes.items()}, np.array(taken, np.int64), np.array(slot, np.int64), np.array(needed, np.int64), np.array(order, U), [np.array(held[w]) for w in order])


def _search(items: Items, table: np.ndarray, rows: bool = False):
    """Batches (doc_id, text) to what documents hold, or, with rows, batches (row, text) to the rows that hold nothing."""
    zero = _with_zero(table)
    longest = max(items.classes, default=1)

    flagged = np.zeros(TERMS, bool)
    flagged[_terms(items.rare)] = True
    sizes = np.array([len(h) for h in items.holders], np.int64)
    flat = np.concatenate([*items.holders, np.zeros(0, np.int64)]).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    counts = [Counter(w) for w in items.words]
    none = np.zeros(0, np.int64)

    def found(hashes: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], tuple]:
        best: dict[tuple[int, int], tuple] = {}
        terms = _terms(hashes)
        y, first = stepped(terms, at, zero, longest)
        if not len(y) or not len(items.ids):
            return best
        # where rare words of items stand, by item and place
        place = np.flatnonzero(flagged[terms])
        k = np.minimum(np.searchsorted(items.rare, hashes[place]), max(len(items.rare) - 1, 0))
        if len(place):
            same = items.rare[k] == hashes[place]
            place, k = place[same], k[same]
        n = sizes[k] if len(k) else np.zeros(0, np.int64)
        item_at = flat[np.repeat(begin[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] if len(k) else n
        # each place counts once for an item: repeats may only raise the bound
        spots = np.sort(item_at * (len(hashes) + 1) + np.repeat(place, n))
        doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
        held = _holding(spots, at, first)
        for at_once in range(0, len(y) - longest, 4096):
            window = y[at_once : min(at_once + 4096, len(y) - longest)].copy()
            for steps in range(1, longest + 1):
                if steps > 1:
                    window += y[at_once + steps - 1 : at_once + steps - 1 + len(window)]
                if steps not in items.classes:
                    continue
                which, v = items.classes[steps]
                norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-12)
                cos = (window / norm[:, None]) @ v.T
                begins, slots = held.get(steps, (none, none))
                a, b = np.searchsorted(begins, [at_once, at_once + len(window)])
                hit = np.union1d(np.flatnonzero(cos >= COSINE), (begins[a:b] - at_once) * len(which) + slots[a:b])
                if not len(hit):
                    continue
                s, item = np.divmod(hit, len(which))
                cosine = cos.reshape(-1)[hit]
                s, d, j = s + at_once, doc[at_once + s], which[item]
                lo = at[d] + np.maximum(s - first[d] - 1, 0) * STRIDE
                hi = np.minimum(at[d] + (s - first[d] + steps + 1) * STRIDE, at[d + 1])
                base = j * (len(hashes) + 1)
                enough = np.searchsorted(spots, base + hi) - np.searchsorted(spots, base + lo) >= items.needed[j]
                _check(hashes, at, best, *(x[enough].tolist() for x in (d, j, lo, hi, cosine)))
        return best

    def _holding(spots: np.ndarray, at: np.ndarray, first: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By steps: first step, ascending, and slot of the item, for each window with as many places of its rare words as needed."""
        item, place = np.divmod(spots, at[-1] + 1)
        end = np.arange(len(spots)) + items.needed[item] - 1
        k = np.flatnonzero(end < len(spots))
        k = k[item[end[k]] == item[k]]
        k = k[place[end[k]] - place[k] < (items.steps[item[k]] + 2) * STRIDE]
        d = np.searchsorted(at, place[k], "right") - 1
        inside = place[end[k]] < at[d + 1]
        k, d = k[inside], d[inside]
        # windows that reach from the first to the last of these places
        steps = items.steps[item[k]]
        low = np.maximum((place[end[k]] - at[d]) // STRIDE - steps, 0)
        high = np.minimum((place[k] - at[d]) // STRIDE + 1, (at[d + 1] - at[d] - 1) // STRIDE)
        n = np.maximum(high - low + 1, 0)
        begins = np.repeat(first[d] + low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        begins, which = np.divmod(np.unique(begins * len(items.ids) + np.repeat(item[k], n)), len(items.ids))
        return {int(x): (begins[of], items.slot[which[of]]) for x in np.unique(items.steps[which]) for of in [items.steps[which] == x]}

    def _check(hashes, at, best, *columns) -> None:
        for d, j, lo, hi, c in zip(*columns, strict=True):
            own, before = items.words[j], best.get((d, j), (0,))[0]
            text = hashes[lo:hi].tolist()
            times = counts[j]
            # words of the item that the window has at all bound the subsequence
            bound = sum(map(times.__getitem__, times.keys() & text)) / len(own)
            if bound < PART or bound <= before:
                continue
            share = _subsequence(own, text) / len(own)
            if share < PART or share <= before:
                continue
            n = items.answer[j]
            answer = _subsequence(own, text, len(own) - n) / n
            if share >= ITEM or answer >= ANSWER:
                best[d, j] = (share, answer, float(c), int(lo - at[d]), int(hi - at[d]))

    def held_by(batch: pa.RecordBatch) -> dict[tuple[int, int], tuple]:
        """What is found in each document, by its number and the item's."""
        hashes, _, _, at = words(*column_bytes(batch["text"]), ALNUM)
        best: dict[tuple[int, int], tuple] = {}
        if len(hashes) <= SPAN:
            best = found(hashes, at)
        else:  # few documents, one of them long
            over = (longest + 2) * STRIDE
            for d in range(len(at) - 1):
                for lo in range(int(at[d]), max(int(at[d + 1]), int(at[d]) + 1), SPAN - over):
                    part = hashes[lo : min(lo + SPAN, at[d + 1])]
                    for (_, j), x in found(part, np.array([0, len(part)])).items():
                        x = (*x[:3], x[3] + lo - int(at[d]), x[4] + lo - int(at[d]))
                        if x[0] > best.get((d, j), (0,))[0]:
                            best[d, j] = x
        return best

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        best = held_by(batch)
        if not best:
            return None
        keys = sorted(best)
        cols = list(zip(*(best[k] for k in keys), strict=True))
        return pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array([d for d, _ in keys], pa.int64())), pa.array([items.ids[j] for _, j in keys], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[:3]), *(pa.array(c, pa.int64()) for c in cols[3:])], ["doc_id", "item_id", "share", "answer", "cosine", "first_word", "last_word"])

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = np.zeros(batch.num_rows, bool)
        held[[d for d, _ in held_by(batch)]] = True
        return batch.select(["row"]).filter(pa.array(~held))

    return clean if rows else run


def _folded() -> Column:
    return F.lower(F.col("text").cast("string")).alias("text")  # of all alphabets


def _passes(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[Broadcast, bool]]:
    """What a pass over the documents needs, for each ITEMS items, and whether it is the last; the driver holds one at a time."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _folded())
    passes = -(-items.count() // ITEMS)
    if not passes:
        return
    table, df = latent(docs.select(_folded()))
    rows = items.toLocalIterator()
    for k in range(passes):
        yield spark.sparkContext.broadcast((prepare([(r["item_id"], r["text"]) for r in islice(rows, ITEMS)], table, df), table.astype(np.float32))), k == passes - 1


def without(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs (text, ..), with all columns, that hold no item; rows are told apart by nothing, so that ids may be null or repeat."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _folded())
    for k, (given, last) in enumerate(_passes(docs, benchmark)):
        rows = arrow_map(rows, lambda given=given: _search(*given.value, rows=True), f"row {rows.schema['row'].dataType.simpleString()}", per_task=True)
        if not last:
            rows = scratch.write(rows, f"pass-{k}").select("row", F.lower(F.col("row.text").cast("string")).alias("text"))
            given.destroy()
            scratch.drop(f"pass-{k - 1}")
    return rows.select("row.*")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, share, answer, cosine, first_word, last_word): a row for each row of docs and item of benchmark that it holds.

    share and answer are the parts of the item's and of its answer's words found in order; first_word and last_word bound the
    window that holds most of it. Null and empty texts hold nothing, and items without a word are held by nothing. Rows that
    repeat a doc_id are each looked at. Other columns are ignored. With no documents or items there are no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, share double, answer double, cosine double, first_word long, last_word long"
    scratch, parts = Scratch(docs.sparkSession), []
    for k, (given, last) in enumerate(_passes(docs, benchmark)):
        part = arrow_map(docs.select("doc_id", _folded()), lambda given=given: _search(*given.value), schema, per_task=True)
        parts.append(part if last else scratch.write(part, f"pass-{k}"))
        if not last:
            given.destroy()
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)
