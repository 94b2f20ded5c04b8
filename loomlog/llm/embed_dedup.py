"""Near-duplicate vectors by cosine, with cover trees and dual traversal.

Unit vectors have cosine >= c exactly where their distance is at most t = sqrt(2 - 2c). Vectors of a large label are dealt to cells around
centres, a net over a sample of them; a vector also visits each cell that a partner of it can be in: a partner y of home cell h is
nearer to h than to any other centre, so x needs to visit h only if it lies within t of the half space of h against its own
centre. Where x lies so near that all of a cell is within t, the cell's number of vectors counts as links and x doesn't visit it.
In each cell a cover tree over its own vectors, with levels of halving radii, is traversed against itself and against a tree of the
visitors; a pair of nodes is dropped once the distance of their centres exceeds both covering radii and t, and is taken whole once that
distance and both radii are within t. Pairs that are left are checked as cosines in double precision and counted in blocks, never listed.
Equal vectors are one row with a count. Centres go to vectors by a shuffle on the label with a salt, so that nothing
is broadcast and the driver sees none of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import Scratch, components
from loomlog.llm.near_dedup import REACH

#: Vectors of a cell that are aimed at, and the bound on a label's centres; with more vectors cells grow instead.
CELL, CENTRES = 1024, 16_384
#: Vectors of a label that one task deals out, with all of the label's centres.
SALT = 1 << 18
LEAF, VISITORS = 32, 2048
#: EPS is for rounding of distances; a cell or node is taken whole only if it is within t by SAFE.
EPS, SAFE = 1e-9, 1e-6


def _reach(cosine: float) -> float:
    return float(np.sqrt(max(2 - 2 * cosine, 0)))


class CoverTree:
    """Nested nets of unit vectors: level k has centres at least r * 2**-k apart and covers its points within that radius."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.points: list[np.ndarray] = []
        if len(x):
            d = np.linalg.norm(x - x[0], axis=1)
            self._build(0, np.arange(len(x)), d, float(d.max()))

    def _node(self, centre: int, radius: float, points: np.ndarray) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.children.append([])
        self.points.append(points)
        return len(self.centre) - 1

    def _build(self, centre: int, points: np.ndarray, dist: np.ndarray, scale: float) -> int:
        """scale: of the parent's net; the children's net has half of it."""
        stack = [(None, centre, points, dist, scale)]
        root = 0
        while stack:
            parent, centre, points, dist, scale = stack.pop()
            node = self._node(centre, float(dist.max()), points)
            if parent is None:
                root = node
            else:
                self.children[parent].append(node)
            if len(points) <= LEAF or self.radius[node] <= EPS:
                continue
            scale = min(scale, self.radius[node]) / 2
            left, left_dist, parts = points, dist, []
            seed = centre
            while len(left):
                # the node's own centre comes first, so that nets are nested
                d = left_dist if seed == centre else np.sqrt(np.maximum(2 - 2 * (self.x[left] @ self.x[seed]), 0))
                near = d <= scale
                near[left == seed] = True
                parts.append((seed, left[near], d[near]))
                left, left_dist = left[~near], left_dist[~near]
                if len(left):
                    seed = int(left[0])
                if len(parts) * 2 > len(points) and len(left):
                    break
            if len(left):  # nearly each point is its own ball: the tree gains nothing further down
                continue
            for seed, own, d in parts:
                stack.append((node, seed, own, d, scale))
        return root


class Links:
    """Of rows with numbers of copies: their links, weighted by copies, and the components that these join."""

    def __init__(self, copies: np.ndarray):
        self.copies, self.count, self.label = copies, np.zeros(len(copies), np.int64), np.arange(len(copies))

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Labels that belong together, pair by pair."""
        pairs = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
        root: dict[int, int] = {}

        def top(k: int) -> int:
            while root.get(k, k) != k:
                k = root[k]
            return k

        for p, q in pairs.tolist():
            p, q = top(p), top(q)
            if p != q:
                root[max(p, q)] = min(p, q)
        if root:
            old = np.array(sorted(root))
            to = np.arange(len(self.label))
            to[old] = [top(k) for k in old.tolist()]
            self.label = to[self.label]

    def near(self, p: np.ndarray, q: np.ndarray, flags: np.ndarray) -> None:
        """flags: which rows of p and q are linked; p and q have no row in common, or flags hold each pair once."""
        np.add.at(self.count, p, flags @ self.copies[q])
        np.add.at(self.count, q, self.copies[p] @ flags)
        other = flags & (self.label[p][:, None] != self.label[q][None, :])
        if other.any():
            i, j = np.nonzero(other)
            self._join(self.label[p[i]], self.label[q[j]])

    def whole(self, p: np.ndarray, q: np.ndarray, same: bool) -> None:
        """All pairs of rows of p and q, or of p alone."""
        if same:
            self.count[p] += self.copies[p].sum() - self.copies[p]
        else:
            self.count[p] += self.copies[q].sum()
            self.count[q] += self.copies[p].sum()
        every = self.label[p if same else np.concatenate([p, q])]
        self._join(np.full(len(every), every.min()), every)


def dual(a: CoverTree, b: CoverTree, cosine: float, links: Links, shift: int = 0) -> None:
    """Adds to links what rows of a and b (numbered from `shift`) with cosine at least `cosine` have; if a is b, each pair of different rows once."""
    t = _reach(cosine)
    if not len(a.x) or not len(b.x):
        return
    same = a is b
    stack = [(0, 0)]
    while stack:
        m, n = stack.pop()
        own = same and m == n
        gap = 0.0 if own else float(np.linalg.norm(a.x[a.centre[m]] - b.x[b.centre[n]]))
        if gap + a.radius[m] + b.radius[n] <= t - SAFE:
            links.whole(a.points[m], b.points[n] + shift, own)
            continue
        if a.children[m] and (not b.children[n] or a.radius[m] >= b.radius[n]):
            ms, ns = a.children[m], [n]
            if own:
                ns = ms
        elif b.children[n]:
            ms, ns = [m], b.children[n]
        else:
            p, q = a.points[m], b.points[n]
            for lo in range(0, len(p), 512):
                flags = a.x[p[lo : lo + 512]] @ b.x[q].T >= cosine
                if own:
                    flags = np.triu(flags, lo + 1)
                if flags.any():
                    links.near(p[lo : lo + 512], q + shift, flags)
            continue
        ca, cb = a.x[[a.centre[k] for k in ms]], b.x[[b.centre[k] for k in ns]]
        reach = np.array([a.radius[k] for k in ms])[:, None] + np.array([b.radius[k] for k in ns])[None, :] + t + 1e-7
        close = np.sqrt(np.maximum(2 - 2 * (ca @ cb.T), 0)) <= reach
        if own:
            close = np.triu(close)
        for i, j in zip(*np.nonzero(close), strict=True):
            stack.append((ms[i], ns[j]))


def _in_cell(cosine: float):
    """Rows (cell, home, rep, copies, v) sorted by cell, those at home first, to (rep, links, to); visitors are taken VISITORS at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, own, rows = None, None, None, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal tree, own, rows
            rep, copies = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            x = np.array([r[2] for r in rows]).reshape(len(rows), -1)
            rows = []
            if tree is None:
                tree, own, links = CoverTree(x), (rep, copies), Links(copies)
                dual(tree, tree, cosine, links)
            else:
                rep, copies = np.concatenate([own[0], rep]), np.concatenate([own[1], copies])
                links = Links(copies)
                dual(tree, CoverTree(x), cosine, links, len(own[0]))
            at = np.flatnonzero(links.count)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(links.count[at]), pa.array(rep[links.label[at]])], ["rep", "links", "to"])

        for batch in batches:
            for cell, home, rep, copies, v in zip(*(batch[c].to_pylist() for c in ("cell", "home", "rep", "copies", "v")), strict=True):
                if cell != key:
                    if rows:
                        yield from flush()
                    key, tree = cell, None
                elif rows and tree is None and not home or len(rows) >= VISITORS and tree is not None:
                    yield from flush()
                if not home and tree is None:
                    continue  # nobody is at home
                rows.append((rep, copies, np.frombuffer(v)))
        if rows:
            yield from flush()

    return run


def _by_label(batches: Iterator[pa.RecordBatch], deal) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (label, dim, salt) with those of centres first: deal(rows of centres, batch) for all others, a few hundred at a time."""
    key, held, centres = None, [], None
    for batch in batches:
        names = list(zip(*(batch[c].to_pylist() for c in ("label", "dim", "salt")), strict=True))
        is_centre = batch["is_centre"].to_pylist()
        at = 0
        while at < len(names):
            to = at + 1
            while to < len(names) and to - at < 256 and names[to] == names[at] and is_centre[to] == is_centre[at]:
                to += 1
            part = batch.slice(at, to - at)
            if names[at] != key:
                key, held, centres = names[at], [], None
            if is_centre[at]:
                held += part.to_pylist()
            elif held:
                if centres is None:
                    held.sort(key=lambda r: r["rep"])
                    centres = {c: np.array([r[c] for r in held]) for c in ("rep", "radius", "n", "first")}
                    centres["x"] = np.array([np.frombuffer(r["v"]) for r in held])
                yield from deal(centres, part)
            at = to


def _vectors(part: pa.RecordBatch) -> np.ndarray:
    return np.array([np.frombuffer(x) for x in part["v"].to_pylist()])


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, dim, rep, copies, v, home, dist): each vector's nearest centre, the first of several."""

    def deal(c, part):
        s = _vectors(part) @ c["x"].T
        home = s.argmax(axis=1)
        dist = np.linalg.norm(_vectors(part) - c["x"][home], axis=1)
        yield pa.RecordBatch.from_arrays([*(part[k] for k in ("label", "dim", "rep", "copies", "v")), pa.array(c["rep"][home]), pa.array(dist)], ["label", "dim", "rep", "copies", "v", "home", "dist"])

    yield from _by_label(batches, deal)


def _visits(cosine: float):
    """Rows with their homes to (label, dim, cell, home, rep, copies, v): where each is at home and visits. Of cells that a row needn't
    visit as all of them is near: (rep, links, to) for the row, and, without v, (cell, copies) for the cell; links between cells are
    rows without a number of links."""
    t = _reach(cosine)

    def deal(c, part):
        x, n = _vectors(part), part.num_rows
        s, copies, rep = x @ c["x"].T, part["copies"].to_numpy(), part["rep"].to_numpy()
        home = np.searchsorted(c["rep"], part["home"].to_numpy())
        gaps = np.sqrt(np.maximum(2 - 2 * (c["x"][np.unique(home)] @ c["x"].T), 0))[np.searchsorted(np.unique(home), home)]
        # pairs across cells are found in the cell with the smaller number
        near = (s[np.arange(n), home][:, None] - s <= (t + 1e-7) * gaps + EPS) & (np.arange(len(c["rep"]))[None, :] < home[:, None])
        whole = near & (np.sqrt(np.maximum(2 - 2 * s, 0)) + c["radius"][None, :] <= t - SAFE)
        i, j = np.nonzero(near & ~whole)
        label, dim = part["label"][0].as_py(), part["dim"][0].as_py()

        def rows(size, **cols):
            given = {"label": pa.array([label] * size, pa.string()), "dim": pa.array([dim] * size, pa.int32()), **cols}
            return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(size, f.type)).cast(f.type) for f in schema], schema=schema)

        v = part["v"]
        yield rows(n, cell=pa.array(c["rep"][home]), home=pa.array([True] * n), rep=part["rep"], copies=part["copies"], v=v)
        if len(i):
            take = pa.array(i)
            yield rows(len(i), cell=pa.array(c["rep"][j]), home=pa.array([False] * len(i)), rep=part["rep"].take(take), copies=part["copies"].take(take), v=v.take(take))
        if whole.any():
            at = np.flatnonzero(whole.any(axis=1))
            first = np.where(whole[at], c["first"][None, :], np.iinfo(np.int64).max).min(axis=1)
            yield rows(len(at), rep=pa.array(rep[at]), links=pa.array(whole[at] @ c["n"]), to=pa.array(first))
            cells = np.flatnonzero(whole.any(axis=0))
            yield rows(len(cells), cell=pa.array(c["rep"][cells]), copies=pa.array(copies @ whole[:, cells]))
            # cells that a row joins, by the first vectors of them
            k, m = np.nonzero(whole[at])
            pairs = np.unique(np.stack([first[k], c["first"][m]], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            if len(pairs):
                yield rows(len(pairs), rep=pa.array(pairs[:, 1]), links=pa.array(np.zeros(len(pairs), np.int64)), to=pa.array(pairs[:, 0]))

    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cell", pa.int64()), ("home", pa.bool_()), ("rep", pa.int64()), ("copies", pa.int64()), ("v", pa.binary()), ("links", pa.int64()), ("to", pa.int64())])
    return lambda batches: _by_label(batches, deal)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, dim, v) of each row; v is null where it can't link."""
    for batch in batches:
        label, dim, vec = [], [], []
        for i, x, v in zip(batch["vec_id"].to_pylist(), batch["label"].to_pylist(), batch["embedding"].to_pylist(), strict=True):
            a = np.array(v, float) if i is not None and x is not None and v and None not in v else np.zeros(1)
            most = np.abs(a).max() if np.isfinite(a).all() else 0
            if most:
                a = a / most  # so that squares neither overflow nor vanish
                a = a / np.linalg.norm(a)
            label.append(None if x is None else str(x))
            dim.append(len(a))
            vec.append((a + 0.0).tobytes() if most else None)
        yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(label, pa.string()), pa.array(dim, pa.int32()), pa.array(vec, pa.binary())], ["vec_id", "label", "dim", "v"])


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label); other columns are ignored.

    Rows are compared only if their labels are equal and not null and their vectors have the same length. Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing: no links, and a component of their own. Rows that repeat a vec_id
    are vectors of their own, with links of their own, and each other's partners if near; all get the component of their id. A null vec_id has a
    null component and isn't kept, and links with nothing. An empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    rows = scratch.write(ids.mapInArrow(_unit, "vec_id long, label string, dim int, v binary").withColumn("h1", F.xxhash64("label", "v")).withColumn("h2", F.hash("v", "label")), "unit")
    unit = rows.where("v is not null")
    classes = scratch.write(unit.groupBy("h1", "h2", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = unit.select(F.col("vec_id").alias("rep"), "label", "dim", "v", "h1", "h2").join(classes, ["rep", "h1", "h2", "dim"]).dropDuplicates(["rep", "h1", "h2"])
    # a vec_id with several vectors has a representative for each; they are told apart by a number of their own
    reps = scratch.write(reps.select(F.xxhash64("rep", "h1", "h2").alias("rep"), F.col("rep").alias("vec_id"), "copies", "label", "dim", "v"), "reps")
    found = scratch.write(_linked(reps.drop("vec_id"), cosine, scratch), "found")
    comp = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")), scratch)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = reps.select("rep", "vec_id").join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("rep", "vec_id", F.coalesce("comp", "rep").alias("comp"))
    least = named.groupBy("comp").agg(F.min("vec_id").alias("least"))
    keyed = named.join(least, "comp").join(links, "rep", "left").select("rep", "least", F.coalesce("links", F.lit(0)).alias("links"))
    of = rows.join(classes, ["h1", "h2", "dim"], "left").select("vec_id", F.when(F.col("v").isNotNull(), F.xxhash64(F.col("rep"), "h1", "h2")).alias("rep"), "copies")
    of = of.join(scratch.write(keyed, "keyed"), "rep", "left").select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"), F.coalesce("least", "vec_id").alias("least"))
    of = scratch.write(of, "of")
    # where a vec_id repeats, its rows tie their components
    again = of.where("vec_id is not null").groupBy("vec_id").agg(F.min("least").alias("a"), F.max("least").alias("b")).where("a <> b").select("vec_id")
    again = scratch.write(of.join(again, "vec_id", "left_semi").select(F.col("vec_id").alias("a"), F.col("least").alias("b")), "again")
    if not again.isEmpty():
        second = components(again, scratch, "ties-cc")
        of = of.join(second.select(F.col("node").alias("least"), "comp"), "least", "left").select("vec_id", "n_links", F.coalesce("comp", "least").alias("least"))
    out = of.select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _linked(reps: DataFrame, cosine: float, scratch: Scratch) -> DataFrame:
    """(rep, links, to) of reps (rep, copies, label, dim, v): links that add up for each row, and rows of the same component."""
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("size")).where(F.col("size") > 2 * CELL)
    sizes = scratch.write(sizes.withColumn("share", F.least(F.lit(1.0 / CELL), CENTRES / F.col("size"))).withColumn("salts", F.ceil(F.col("size") / SALT).cast("int")), "sizes")
    salt = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("salts")).cast("int").alias("salt")
    large = reps.join(sizes, ["label", "dim"])
    pick = F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    # the least of a label is always a centre, so that each has one
    first = reps.join(sizes, ["label", "dim"]).groupBy("label", "dim").agg(F.min("rep").alias("rep")).withColumn("first", F.lit(True))
    centres = scratch.write(large.join(first, ["label", "dim", "rep"], "left").where(pick | F.col("first")).select("label", "dim", "rep", "v", "salts"), "centres")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    bare = (none("radius", "double"), none("n", "long"), none("first", "long"))

    def dealt(rows: DataFrame, known: DataFrame) -> DataFrame:
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        known = known.select("label", "dim", "salt", F.lit(True).alias("is_centre"), "rep", none("copies", "long"), "v", none("home", "long"), "radius", "n", "first")
        both = known.unionByName(rows.select("label", "dim", salt, F.lit(False).alias("is_centre"), "rep", "copies", "v", "home", *bare))
        return both.repartition("label", "dim", "salt").sortWithinPartitions("label", "dim", "salt", F.desc("is_centre"))

    homes = dealt(large.withColumn("home", F.lit(None).cast("long")), centres.select("*", *bare)).mapInArrow(_homes, "label string, dim int, rep long, copies long, v binary, home long, dist double")
    homes = scratch.write(homes, "homes")
    cells = homes.groupBy("label", "dim", F.col("home").alias("rep")).agg(F.max("dist").alias("radius"), F.sum("copies").alias("n"), F.min("rep").alias("first"))
    visits = dealt(homes.join(sizes, ["label", "dim"]), centres.join(cells, ["label", "dim", "rep"])).mapInArrow(_visits(cosine), "label string, dim int, cell long, home boolean, rep long, copies long, v binary, links long, to long")
    visits = scratch.write(visits, "visits")
    small = reps.join(sizes.select("label", "dim"), ["label", "dim"], "left_anti").select("label", "dim", F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"), "rep", "copies", "v")
    name = F.concat_ws(":", F.col("dim").cast("string"), F.col("cell").cast("string"), "label").alias("cell")
    placed = visits.where("v is not null").select(small.columns).unionByName(small).select(name, "home", "rep", "copies", "v")
    inside = placed.repartition("cell").sortWithinPartitions("cell", F.desc("home")).mapInArrow(_in_cell(cosine), "rep long, links long, to long")
    # of cells that rows needn't visit: the rows' own links, and each member's
    near = visits.where("v is null and cell is null").select("rep", "links", "to")
    guests = visits.where("v is null and cell is not null").groupBy("label", "dim", "cell").agg(F.sum("copies").alias("links"))
    hosts = guests.join(cells.select("label", "dim", F.col("rep").alias("cell"), F.col("first").alias("to")), ["label", "dim", "cell"])
    members = homes.select("label", "dim", F.col("home").alias("cell"), "rep").join(hosts, ["label", "dim", "cell"]).select("rep", "links", "to")
    return inside.unionByName(near).unionByName(members)


def oracle(cosine: float = 0.98) -> str:
    """DuckDB SQL for near_vectors() over the view embeddings, whose ids don't repeat: all pairs of a label."""
    return f"""WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT vec_id, label, v, list_max(list_transform(v, lambda x: abs(x))) AS top FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
big AS (SELECT vec_id, label, list_transform(v, lambda x: x / top) AS v FROM ok WHERE top > 0),
u AS MATERIALIZED (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM big),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) >= {cosine}),
pairs AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), {REACH},
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept FROM e LEFT JOIN n ON n.a = vec_id LEFT JOIN least_of l ON l.a = vec_id"""
