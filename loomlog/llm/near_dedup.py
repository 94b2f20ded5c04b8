"""Near duplicates of documents with HyperMinHash registers.

Every document gets K registers. Register i keeps the smallest hash of the document's shingles in bucket i as its
count of leading zeros (6 bits) and the next bits after the leading one (10 bits mantissa). Buckets have hash functions of their
own, so that short documents fill all of them. Bands of ROWS registers give candidates; the share of equal
registers, corrected for chance collisions of the compressed values, drops unlikely candidates; links are
confirmed on the full shingle sets.

Links inside one group are not all written out. Documents that share a band and are likely near form a cluster: those of a band's
bucket are held against its smallest, and then, but for those in one cluster, against each other by their registers. In a cluster, each
document is first held against the smallest that it shares a band with. What is then in other components than the cluster's main one
is compared with all of the cluster: first by longer sketches of LONG registers, then, only where those are near enough, by full
sets. All takes place in cells of two blocks, bounded in rows and in shingles, so that a task's work is bounded and only links that join
components leave it. At a similarity of 0.8, 32 bands of 4 registers miss a link with probability (1 - 0.8**4)**32 = 5e-8;
an estimate below its cut, five standard deviations off, is as unlikely. Work grows with the square of a cluster only in sketches, and in texts for those
of its documents that are in other components and yet within about 0.1 of the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import Scratch, arrow_map, components, sliced
from loomlog.llm.textbytes import U, column_bytes, fmix, shingles, words

K, ROWS = 128, 4
BANDS = K // ROWS
MANTISSA = 10
#: Registers of the longer sketches.
LONG = 512
#: A pair goes on if its estimated similarity is this far below the threshold at most: five standard deviations, of K and of LONG registers.
SLACK, CLOSE = 0.18, 0.09
#: Rows and shingles of a block of full sets; such blocks in a block of sketches at most, and blocks of sketches that a cluster has before they grow to that.
BLOCK, SHINGLES, BLOCKS, SPREAD = 256, 1 << 17, 8, 8
MUL = fmix(np.arange(1, LONG + 1, dtype=U) * U(0xA24BAED4963EE407)) | U(1)
ADD = fmix(np.arange(1, LONG + 1, dtype=U) * U(0x9FB21C651E98DF25))


def compress(least: np.ndarray) -> np.ndarray:
    """64-bit minima as leading zeros and mantissa; order-preserving in reverse."""
    zeros = np.zeros(least.shape, np.int64)
    x = least.copy()
    for s in (32, 16, 8, 4, 2, 1):
        small = x < (U(1) << U(64 - s))
        zeros += s * small
        x = np.where(small, x << U(s), x)
    mantissa = (x << U(1)) >> U(64 - MANTISSA)
    return (np.minimum(zeros, 63) << MANTISSA | mantissa.astype(np.int64)).astype(np.uint16)


def registers(shingle_hashes: np.ndarray, k: int = K) -> np.ndarray:
    least = np.full(k, np.iinfo(np.uint64).max, U)
    for at in range(0, len(shingle_hashes), 512):
        np.minimum(least, (shingle_hashes[None, at : at + 512] * MUL[:k, None] + ADD[:k, None]).min(axis=1), out=least)
    return compress(least)


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, k: int = K) -> np.ndarray:
    """Jaccard similarity from the share of equal registers of k.

    Two independent minima of n and m hashes fall into the same cell with the chance sum over cells of the product
    of both cell chances; with densities n*exp(-n*x) and m*exp(-m*x) a cell of relative width 2**-MANTISSA around x
    adds n*m*x*exp(-(n+m)*x)*2**-MANTISSA dx/x..., which sums to n*m/(n+m)**2 * 2**-MANTISSA / ln 2 to first order.
    """
    n_a, n_b = np.maximum(n_a, 1).astype(float), np.maximum(n_b, 1).astype(float)
    chance = n_a * n_b / (n_a + n_b) ** 2 * 2.0**-MANTISSA / np.log(2)
    return np.clip((equal / k - chance) / (1 - chance), 0, 1)


def _sketch(n_words: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = column_bytes(batch["text"])
        hashes, _, _, at = words(data, off)
        n, sums, xors, sigs = [], [], [], []
        for i in range(batch.num_rows):
            s = shingles(hashes[at[i] : at[i + 1]], n_words)
            n.append(len(s))
            mixed = fmix(s * U(0x9FB21C651E98DF25))
            sums.append(np.add.reduce(s))
            xors.append(np.add.reduce(mixed))
            sigs.append(registers(s).tobytes() if len(s) else None)
        as_long = lambda x: np.array(x, U).view(np.int64)
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(as_long(sums)), pa.array(as_long(xors)), pa.array(sigs, pa.binary())], ["doc_id", "n", "h1", "h2", "sig"])

    return run


def _long(n_words: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = _sets(n_words)(batch)
        return pa.RecordBatch.from_arrays([batch["rep"], pa.array([len(x) for x in sets], pa.int64()), pa.array([registers(x, LONG).tobytes() for x in sets], pa.binary())], ["rep", "n", "sig"])

    return run


def _estimated(batch: pa.RecordBatch) -> pa.RecordBatch:
    a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, K) for c in ("sig_a", "sig_b"))
    est = estimate((a == b).sum(axis=1), batch["n_a"].to_numpy(), batch["n_b"].to_numpy())
    return pa.RecordBatch.from_arrays([*(batch[c] for c in ("a", "b", "n_a", "n_b")), pa.array(est)], ["a", "b", "n_a", "n_b", "est"])


def _verify(n_words: int, percent: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = []
        for c in ("text_a", "text_b"):
            data, off = column_bytes(batch[c])
            hashes, _, _, at = words(data, off)
            sets.append((hashes, at))
        a = batch["a"].to_numpy()
        keep, last, left = np.zeros(batch.num_rows, bool), None, None
        for i in range(batch.num_rows):
            if a[i] != last:
                last, left = a[i], shingles(sets[0][0][sets[0][1][i] : sets[0][1][i + 1]], n_words)
            right = shingles(sets[1][0][sets[1][1][i] : sets[1][1][i + 1]], n_words)
            both = np.concatenate([left, right])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep[i] = 100 * common >= percent * (len(both) - common)
        return batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of components that a link between a row of left and a row of right joins, as few as join the same.

    Intersections are products of 0/1 matrices over the shingles that several sets share, a few thousand columns at a time.
    """
    size = np.array([len(s) for s in sets])
    values, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, row = column[shared], row[shared]
    common = np.zeros((len(left), len(right)))
    if len(column):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
        for lo in range(0, int(column[-1]) + 1, 4096):
            s, e = np.searchsorted(column, [lo, lo + 4096])
            flags = np.zeros((len(sets), 4096), np.float32)
            flags[row[s:e], column[s:e] - lo] = 1
            common += flags[left] @ flags[right].T
    near = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
    return joining(near & (size[left] > 0)[:, None] & (size[right] > 0)[None, :], left, right, comp)


def joining(near: np.ndarray, left: np.ndarray, right: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of components that the near pairs of rows of left and right join, as few as join the same."""
    near = near & (comp[left][:, None] != comp[right][None, :])
    found, root = [], {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = top(int(comp[left[i]])), top(int(comp[right[j]]))
        if a != b:
            root[max(a, b)] = min(a, b)
            found.append((min(a, b), max(a, b)))
    return found


def _near(n: np.ndarray, sig: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Which rows of left and right, by shingles and registers, have an estimate of at least `least`."""
    other, near = sig[right], np.empty((len(left), len(right)), bool)
    for k, row in enumerate(left):
        near[k] = estimate((other == sig[row]).sum(axis=1), n[row], n[right], sig.shape[1]) >= least
    return near


def _cells(key: tuple[str, ...], columns: tuple[str, ...], load: Callable[[pa.RecordBatch], list], done: Callable):
    """Rows sorted by key: done(key, rows) for all rows of each, a row being the given columns' values and what load makes of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            for part in sliced(batch):
                names = zip(*(part[c].to_pylist() for c in key), strict=True)
                for name, *row in zip(names, *(part[c].to_pylist() for c in columns), load(part), strict=True):
                    if name != last:
                        if rows and (out := done(last, rows)) is not None:
                            yield out
                        last, rows = name, []
                    rows.append(row)
        if rows and (out := done(last, rows)) is not None:
            yield out

    return run


def _sets(n_words: int):
    def load(part: pa.RecordBatch) -> list:
        hashes, _, _, at = words(*column_bytes(part["text"]))
        return [shingles(hashes[at[k] : at[k + 1]], n_words) for k in range(part.num_rows)]

    return load


def _sketches(part: pa.RecordBatch) -> list:
    return [(n, np.frombuffer(sig, np.uint16)) for n, sig in zip(part["n"].to_pylist(), part["sig"].to_pylist(), strict=True)]


def _roles(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.flatnonzero([r[k] for r in rows]) for k in (0, 1))


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch | None:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"]) if found else None


def _across_texts(n_words: int, percent: int):
    """Rows (cluster, i, j, home, odd, comp, text) to the components that links between rows at home and odd ones join."""

    def done(_, rows: list) -> pa.RecordBatch | None:
        home, odd = _roles(rows)
        return _pairs(linked([r[3] for r in rows], home, odd, np.array([r[2] for r in rows]), percent)) if len(home) and len(odd) else None

    return _cells(("cluster", "i", "j"), ("home", "odd", "comp"), _sets(n_words), done)


def _across_sketches(least: float):
    """Rows (cluster, bi, bj, home, odd, comp, n, sig) to the components that estimates between rows at home and odd ones join."""

    def done(_, rows: list) -> pa.RecordBatch | None:
        home, odd = _roles(rows)
        if not len(home) or not len(odd):
            return None
        n, sig, comp = np.array([r[3][0] for r in rows]), np.stack([r[3][1] for r in rows]), np.array([r[2] for r in rows])
        return _pairs(joining(_near(n, sig, home, odd, least), home, odd, comp))

    return _cells(("cluster", "bi", "bj"), ("home", "odd", "comp"), _sketches, done)


def _close(least: float, percent: int):
    """Rows (cluster, bi, bj, home, odd, comp, rep, i, j, n, sig) to those (cluster, i, j, rep, comp, home, odd) whose full sets must be compared, in their blocks of full sets."""

    def done(key: tuple, rows: list) -> pa.RecordBatch | None:
        home, odd = _roles(rows)
        if not len(home) or not len(odd):
            return None
        n, sig, comp = np.array([r[6][0] for r in rows]), np.stack([r[6][1] for r in rows]), np.array([r[2] for r in rows])
        near = _near(n, sig, home, odd, least) & (comp[home][:, None] != comp[odd][None, :])
        near &= 100 * np.minimum(n[home][:, None], n[odd][None, :]) >= percent * np.maximum(n[home][:, None], n[odd][None, :])
        a, b = np.nonzero(near)
        if not len(a):
            return None
        i, j = np.array([r[4] for r in rows])[home[a]], np.array([r[5] for r in rows])[odd[b]]
        cells = np.concatenate([np.stack([i, j, home[a], np.zeros(len(a), np.int64)], axis=1), np.stack([i, j, odd[b], np.ones(len(a), np.int64)], axis=1)])
        cells = np.unique(cells, axis=0)
        row = cells[:, 2]
        cols = [pa.array(np.full(len(row), key[0])), pa.array(cells[:, 0], pa.int32()), pa.array(cells[:, 1], pa.int32()), pa.array([rows[k][3] for k in row], pa.int64()), pa.array(comp[row]), pa.array(cells[:, 3] == 0), pa.array(cells[:, 3] == 1)]
        return pa.RecordBatch.from_arrays(cols, ["cluster", "i", "j", "rep", "comp", "home", "odd"])

    return _cells(("cluster", "bi", "bj"), ("home", "odd", "comp", "rep", "i", "j"), _sketches, done)


def celled(named: DataFrame, what: DataFrame) -> DataFrame:
    """Rows (rep, cluster, comp, main, n), a written table, dealt to cells of blocks (bi, bj) so that each one outside its cluster's main component meets all of the cluster, with the columns of what (rep, ...).

    i and j number the row's blocks of full sets, up to BLOCKS of which make a block here. Blocks are bounded in rows and in shingles n. A
    join by cluster stands alone before a shuffle on something else, so that adaptive execution can split a large cluster.
    """
    odd = F.col("comp") != F.col("main")
    blocks = lambda rows, n: F.ceil(F.greatest(rows / BLOCK, n / SHINGLES)).cast("int")
    split = named.groupBy("cluster").agg(blocks(F.count("*"), F.sum("n")).alias("ni"), blocks(F.count(F.when(odd, 1)), F.coalesce(F.sum(F.when(odd, F.col("n"))), F.lit(0))).alias("nj")).where("nj > 0")
    left = named.join(split, "cluster")
    place = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    left = left.select("rep", "cluster", "comp", odd.alias("odd"), place("ni", 1).alias("i"), place("nj", 2).alias("j"), "ni", "nj")
    size = lambda n: F.least(F.lit(BLOCKS), F.ceil(F.col(n) / SPREAD))
    left = left.select("rep", "cluster", "comp", "odd", "i", "j", *(F.floor(F.col(c) / size(n)).cast("int").alias(f"b{c}") for c, n in (("i", "ni"), ("j", "nj"))), *(F.ceil(F.col(n) / size(n)).cast("int").alias(n) for n in ("ni", "nj")))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda bi, bj, home: F.struct(bi.alias("bi"), bj.alias("bj"), F.lit(home).alias("home"), F.lit(not home).alias("away"))
    cells = F.transform(each("nj"), lambda bj: cell(F.col("bi"), bj, True))
    cells = F.when(F.col("odd"), F.concat(cells, F.transform(each("ni"), lambda bi: cell(bi, F.col("bj"), False)))).otherwise(cells)
    placed = left.select("rep", "cluster", "comp", "i", "j", F.explode(cells).alias("at"))
    # a row can be at home and odd in the same cell
    placed = placed.groupBy("rep", "cluster", "comp", "i", "j", "at.bi", "at.bj").agg(F.max("at.home").alias("home"), F.max("at.away").alias("odd"))
    return placed.join(what, "rep").repartition("cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj")


def merged(comp: DataFrame, links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """comp (node, comp) with the components, or nodes without one, that links (a, b) join."""
    second = components(links, scratch, tag)
    nodes = comp.unionByName(second.join(comp, "node", "left_anti").select("node", F.col("node").alias("comp")))
    return scratch.write(nodes.join(second.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), f"{tag}-merged")


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text); other columns are ignored.

    Null and empty texts, and those of white space alone, have no shingles and link with nothing. Rows that repeat a
    doc_id stay, each with its own set; the id's component joins all of them. A null doc_id is compared like any
    other text but joins no component: its component_id is null and it is not kept. Two documents link if 100 * intersection >= percent * union.
    component_id is the smallest doc_id that links reach.
    """
    spark, threshold = docs.sparkSession, percent / 100
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = scratch.write(arrow_map(docs, _sketch(n_words), "doc_id long, n long, h1 long, h2 long, sig binary"), "sketches")
    full = sketches.where("n > 0 and doc_id is not null")
    classes = scratch.write(full.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    # a doc_id that repeats with other texts ties the classes it is in
    repeats = full.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    tied = full.join(repeats, "doc_id", "left_semi").join(classes, ["n", "h1", "h2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    tied = scratch.write(tied.distinct(), "tied")
    reps = scratch.write(full.select(F.col("doc_id").alias("rep"), "n", "h1", "h2", "sig").join(classes.select("n", "h1", "h2", "rep"), ["n", "h1", "h2", "rep"]).dropDuplicates(["rep", "h1", "h2"]).select("rep", "n", "sig"), "reps")
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    bands = reps.select("rep", F.explode(keys).alias("key"))
    buckets = bands.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("size")).where("size > 1")
    followers = scratch.write(bands.join(buckets, "key").where("rep <> lead"), "followers")
    pairs = followers.select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    sig = lambda side: reps.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}"))
    sized = pairs.join(sig("b"), "b").join(sig("a"), "a").select("a", "b", "n_a", "n_b", "sig_a", "sig_b")
    pairs = scratch.write(arrow_map(sized, _estimated, "a long, b long, n_a long, n_b long, est double").where(F.col("est") >= threshold - SLACK), "pairs")
    near = components(pairs, scratch, "near")
    # the rest of each bucket, which has met the lead: those in other clusters than most of it against all of it
    members = followers.where("size > 2").select("rep", F.col("key").alias("cluster"))
    members = members.join(near.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("rep", "cluster", F.coalesce("comp", "rep").alias("comp"), F.lit(1).alias("n"))
    several = members.groupBy("cluster").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("cluster")
    members = scratch.write(members.join(several, "cluster"), "members")
    main = members.groupBy("cluster", "comp").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    members = scratch.write(members.join(main, "cluster"), "members-main")
    met = celled(members, reps).select("cluster", "bi", "bj", "home", "odd", "comp", "n", "sig").mapInArrow(_across_sketches(threshold - SLACK), "a long, b long")
    met = scratch.write(met.distinct(), "met")
    if not met.isEmpty():
        near = merged(near, met, scratch, "nearer")
    cluster = scratch.write(near.select(F.col("node").alias("rep"), F.col("comp").alias("cluster")), "cluster")
    # where a doc_id has several texts, any of them can link
    texts = docs.where("doc_id is not null").join(cluster.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    texts = scratch.write(texts.select(F.col("doc_id").alias("rep"), "text"), "texts")

    # each document against the smallest that it shares a band with
    likely = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    likely = likely.groupBy("b").agg(F.min("a").alias("a"))
    both = likely.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    links = scratch.write(arrow_map(both.select("a", "b", "text_a", "text_b"), _verify(n_words, percent), "a long, b long"), "links")
    comp = components(links.union(tied), scratch, "first")

    # then what is left of each cluster: one of its components is its main one; rows of others are odd
    named = cluster.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("rep", "cluster", F.coalesce("comp", "rep").alias("comp"))
    named = scratch.write(named.join(reps.groupBy("rep").agg(F.max("n").alias("n")), "rep"), "named")
    main = named.where("rep = cluster").select("cluster", F.col("comp").alias("main"))
    named = scratch.write(named.join(main, "cluster"), "named-main")
    apart = named.where("comp <> main").select("cluster").distinct()
    named = scratch.write(named.join(apart, "cluster", "left_semi"), "apart")
    whose = named.select("rep")
    long = scratch.write(arrow_map(texts.join(whose, "rep", "left_semi"), _long(n_words), "rep long, n long, sig binary"), "long")
    close = celled(named, long).select("cluster", "bi", "bj", "home", "odd", "comp", "rep", "i", "j", "n", "sig").mapInArrow(_close(threshold - CLOSE, percent), "cluster long, i int, j int, rep long, comp long, home boolean, odd boolean")
    close = scratch.write(close.groupBy("cluster", "i", "j", "rep", "comp").agg(F.max("home").alias("home"), F.max("odd").alias("odd")), "close")
    rest = close.join(texts, "rep").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    rest = rest.select("cluster", "i", "j", "home", "odd", "comp", "text").mapInArrow(_across_texts(n_words, percent), "a long, b long")
    rest = scratch.write(rest.distinct(), "rest")
    if not rest.isEmpty():
        comp = merged(comp, rest, scratch, "second")
    classes = classes.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("n", "h1", "h2", F.coalesce("comp", "rep").alias("comp"))
    # only classes of several documents or links differ from the document itself
    out = sketches.join(classes, ["n", "h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


#: SQL that ends an oracle: components of the view pairs (a, b), which holds both directions, as reach (a, least).
REACH = """reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b), least_of AS (SELECT a, min(b) AS least FROM reach GROUP BY a)"""


def oracle(percent: int = 80) -> str:
    """DuckDB SQL for near_duplicates() on two-word shingles over the view documents, whose ids don't repeat: all pairs that share a shingle."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
sets AS MATERIALIZED (SELECT hash(s) AS h, s, min(doc_id) AS rep, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) WHERE len(s) > 0 GROUP BY s),
x AS MATERIALIZED (SELECT rep, n, unnest(s) AS x FROM sets),
common AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS shared FROM x a JOIN x b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * shared >= {percent} * (n - shared)),
pairs AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), {REACH},
own AS (SELECT s.doc_id, len(s.s) AS n, sets.rep FROM s LEFT JOIN sets ON sets.s = list_sort(s.s))
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM (SELECT doc_id, n, least(coalesce(rep, doc_id), coalesce(least, rep, doc_id)) AS c FROM own LEFT JOIN least_of ON a = rep)"""
