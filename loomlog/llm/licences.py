"""Licences of files: by their own text, else by the nearest directory above that has a licence file.

Passages of a text are held against templates as TF-IDF vectors: each line, the whole text, and runs of as many words as a template has,
laid so that one of the template's weightiest words falls on its place in it; so a header counts wherever its lines break, and a
licence file by its whole text or by how it begins. The inverse frequencies of the templates' words count all lines of all
texts; other words weigh as if no other line had them. A passage without any of a template's weightiest words, or with too
many words besides the template's, can't reach THRESHOLD and isn't looked at, and the products are sparse. The best cosine of at least THRESHOLD names a file's licence; a notice also needs
those words of its licence's name that it holds. It is a licence file if a text of a licence file is found in it, if matching
passages make up half of its words, or if it is called LICENSE, COPYING or the like; then its directory passes the licence on to files below
that have none, the nearest directory first, by joins on paths.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import Scratch, arrow_map, sliced
from loomlog.llm.licence_templates import NOTICES, TEXTS
from loomlog.llm.textbytes import ALNUM, column_bytes, runs, words

THRESHOLD = 0.7
#: Names of licence files, in capitals and without what follows a point or a hyphen.
NAMED = ("LICENSE", "LICENCE", "LICENSES", "COPYING", "COPYRIGHT", "UNLICENSE")
#: Passages that are compared at once.
PASSAGES = 512
#: White space and line feeds end lines for the frequencies and for passages alike.
_inside = np.ones(256, bool)
_inside[10] = False


def _hashes(texts: list[str]) -> list[np.ndarray]:
    hashes, _, _, at = words(*column_bytes(pa.array(texts, pa.string())), ALNUM)
    return [hashes[at[k] : at[k + 1]] for k in range(len(texts))]


def _damped(counts: np.ndarray) -> np.ndarray:
    """Counts of words by the logarithm, so that common words of long texts don't outweigh the others."""
    return np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0)


class _Matcher:
    """Templates as sparse vectors over the hashes of their words."""

    def __init__(self, notices: Mapping[str, tuple[str, ...]], texts: Mapping[str, tuple[str, ...]]):
        rows = [(name, text, given is texts) for given in (notices, texts) for name in sorted(given) for text in given[name]]
        rows = sorted(rows, key=lambda r: r[0])
        own = _hashes([t for _, t, _ in rows])
        self.names, self.whole = [n for n, _, _ in rows], np.array([w for _, _, w in rows], bool)
        self.words = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]))
        self.of = [np.searchsorted(self.words, h) for h in own]
        self.counts = np.zeros((len(rows), len(self.words)))
        for k, at in enumerate(self.of):
            np.add.at(self.counts[k], at, 1)
        # words of a notice's name that it holds itself
        needed = [np.zeros(0, np.uint64) if w else np.intersect1d(h, t) for (_, _, w), h, t in zip(rows, _hashes([n for n, _, _ in rows]), own, strict=True)]
        self.needed = [np.searchsorted(self.words, n) for n in needed]

    def weigh(self, df: np.ndarray, lines: float, threshold: float) -> None:
        self.idf, self.rest, self.threshold = np.log((1 + lines) / (1 + df)) + 1, float(np.log(1 + lines) + 1), threshold
        self.vectors = _damped(self.counts) * self.idf
        self.vectors /= np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-12)
        # the heaviest words of each template, until the others' share can't reach the threshold, with their places in it
        self.anchors: list[dict[int, list[int]]] = []
        for t, v in enumerate(self.vectors):
            order = np.argsort(-v, kind="stable")
            kept = set(order[: int(np.searchsorted(np.cumsum(v[order] ** 2), 1 - threshold**2, "right")) + 1].tolist())
            self.anchors.append({})
            for q, w in enumerate(self.of[t].tolist()):
                if w in kept:
                    self.anchors[t].setdefault(w, []).append(q)
        self.anchor = np.zeros(len(self.words) + 1, bool)
        self.anchor[[w for own in self.anchors for w in own]] = True

    def hits(self, batch: pa.RecordBatch):
        """Word offsets of documents, of lines, the places of templates' words, and which of them each is."""
        data, off = column_bytes(batch["text"])
        hashes, starts, _, at = words(data, off, ALNUM)
        line_starts, _ = runs(_inside[data], off)
        lines = np.searchsorted(starts, line_starts)
        if not len(hashes) or not len(self.words):
            return at, lines, np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        place = np.flatnonzero(self.words[k] == hashes)
        return at, lines, place, k[place]

    def frequencies(self, batch: pa.RecordBatch) -> np.ndarray:
        """Lines with each word, and all lines."""
        _, lines, place, word = self.hits(batch)
        seen = np.unique((np.searchsorted(lines, place, "right") - 1) * (len(self.words) + 1) + word)
        return np.append(np.bincount(seen % (len(self.words) + 1), minlength=len(self.words)), len(lines))

    def passages(self, at: np.ndarray, lines: np.ndarray, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """(document, first word, end) of all passages that can reach the threshold, in order and each once."""
        anchored = np.flatnonzero(self.anchor[word])
        if not len(anchored):
            return np.zeros((0, 3), np.int64)
        doc = np.searchsorted(at, place[anchored], "right") - 1
        line, ends = np.searchsorted(lines, place[anchored], "right") - 1, np.append(lines, at[-1])
        wide = np.unique(np.concatenate([np.stack([doc, at[doc], at[doc + 1]], axis=1), np.stack([doc, lines[line], ends[line + 1]], axis=1)]), axis=0)
        far, found = np.zeros(len(wide), bool), []
        by_word = np.argsort(word[anchored], kind="stable")
        groups = np.searchsorted(word[anchored][by_word], np.arange(len(self.words) + 1))
        for t, own in enumerate(self.anchors):
            # a passage's product with the template is the sum over its words at most, and its length that of its other words at least
            before = np.concatenate([[0.0], np.cumsum((self.idf * self.vectors[t])[word])])

            def can(start: np.ndarray, stop: np.ndarray, before=before) -> np.ndarray:
                a, b = np.searchsorted(place, start), np.searchsorted(place, stop)
                return before[b] - before[a] >= self.threshold * self.rest * np.sqrt(np.maximum(stop - start - (b - a), 0)) - 1e-9

            far |= can(wide[:, 1], wide[:, 2])
            for w, places in own.items():
                k = by_word[groups[w] : groups[w + 1]]
                d, p = doc[k], place[anchored[k]]
                for q in places:
                    start, stop = np.clip(p - q, at[d], at[d + 1]), np.minimum(p - q + len(self.of[t]), at[d + 1])
                    near = can(start, stop)
                    found.append(np.stack([d[near], start[near], stop[near]], axis=1))
        found = np.unique(np.concatenate([wide[far], *found]), axis=0)
        return found[found[:, 2] > found[:, 1]]

    def cosines(self, spans: np.ndarray, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of passages with templates, 0 where a notice lacks words of its name."""
        a, b = np.searchsorted(place, spans[:, 1]), np.searchsorted(place, spans[:, 2])
        n = b - a
        x = np.zeros((len(spans), len(self.words)))
        np.add.at(x, (np.repeat(np.arange(len(spans)), n), word[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]), 1)
        other = spans[:, 2] - spans[:, 1] - n
        y = _damped(x) * self.idf
        # words that no template has count as different ones
        out = y @ self.vectors.T / np.maximum(np.sqrt((y * y).sum(axis=1) + other * self.rest**2), 1e-12)[:, None]
        for t, needed in enumerate(self.needed):
            if len(needed):
                out[:, t] *= (x[:, needed] > 0).all(axis=1)
        return np.minimum(out, 1.0)


def detect(docs: DataFrame, notices: Mapping[str, tuple[str, ...]] = NOTICES, texts: Mapping[str, tuple[str, ...]] = TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, own_licence, score, licence_file) for each row of docs (doc_id, text, path); score is the best cosine of a passage that can reach the threshold, else 0."""
    matcher = _Matcher(notices, texts)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("path").cast("string").alias("path"))
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, path string"

    def frequencies(batches):
        total = np.zeros(len(matcher.words) + 1)
        for batch in batches:
            for part in sliced(batch):
                total += matcher.frequencies(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], ["word", "n"])

    df = np.zeros(len(matcher.words) + 1)
    for r in docs.select("text").mapInArrow(frequencies, "word long, n double").groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row for each word of the templates
        df[r["word"]] = r["n"]
    matcher.weigh(df[:-1], df[-1], threshold)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, lines, place, word = matcher.hits(batch)
        spans = matcher.passages(at, lines, place, word)
        n = batch.num_rows
        score, own, whole = np.zeros(n), np.full(n, -1), np.zeros(n, bool)
        matched = [np.zeros((0, 3), np.int64)]
        for lo in range(0, len(spans), PASSAGES):
            some = spans[lo : lo + PASSAGES]
            cos = matcher.cosines(some, place, word)
            best, which = cos.max(axis=1), cos.argmax(axis=1)
            for d, c, t in zip(some[:, 0].tolist(), best.tolist(), which.tolist(), strict=True):
                if c > score[d] or c == score[d] and c >= threshold and t < own[d]:
                    score[d] = c
                    own[d] = t if c >= threshold else -1
            far = best >= threshold
            matched.append(some[far])
            whole[some[far, 0]] |= ((cos[far] >= threshold) & matcher.whole).any(axis=1)
        # words in matching passages, each once
        matched = np.concatenate(matched)
        depth = np.zeros(int(at[-1]) + 1, np.int64)
        np.add.at(depth, matched[:, 1], 1)
        np.add.at(depth, matched[:, 2], -1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(depth)[:-1] > 0)])
        covered = inside[at[1:]] - inside[at[:-1]]
        name = pa.array([None if t < 0 else matcher.names[t] for t in own.tolist()], pa.string())
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["path"], name, pa.array(score), pa.array(whole | (covered > 0) & (2 * covered >= np.diff(at)))], ["doc_id", "path", "own_licence", "score", "licence_file"])

    found = arrow_map(docs, run, f"{kinds}, own_licence string, score double, licence_file boolean")
    called = F.regexp_extract(F.upper(F.element_at(F.split("path", "/"), -1)), r"^([A-Z]+)(?:[.\-].*)?$", 1).isin(*NAMED)
    return found.withColumn("licence_file", F.col("licence_file") | F.coalesce(called & F.col("own_licence").isNotNull(), F.lit(False)))


def scan(docs: DataFrame, notices: Mapping[str, tuple[str, ...]] = NOTICES, texts: Mapping[str, tuple[str, ...]] = TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """detect() with licence (the own one, else the inherited one) and inherited_from (the directory it comes from).

    Null and empty texts have no own licence; a null path inherits nothing and passes nothing on. Of several licence files
    in a directory the best score decides, then the first name in alphabetical order. Rows that repeat stay. Other columns are ignored.
    """
    found = Scratch(docs.sparkSession).write(detect(docs, notices, texts, threshold).withColumn("dir", F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)), "found")
    given = found.where("licence_file and path is not null").groupBy("dir", "own_licence").agg(F.max("score").alias("score"))
    given = given.groupBy("dir").agg(F.min_by("own_licence", F.struct(-F.col("score"), "own_licence")).alias("licence"))
    # each directory once, with all that are above it
    dirs = found.where("path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("up"))
    nearest = above.distinct().join(given.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by("licence", F.length("up")).alias("from_licence"), F.max_by("up", F.length("up")).alias("up"))
    needs = F.col("own_licence").isNull()
    out = found.join(nearest, "dir", "left")
    return out.select("doc_id", "path", "own_licence", "score", "licence_file", F.coalesce("own_licence", "from_licence").alias("licence"), F.when(needs, F.col("up")).alias("inherited_from"))
