"""A quality score from document statistics.

Random Fourier features approximate a Gaussian kernel over the statistics of a text. Each partition sums its part of the
normal equations of a ridge regression on them; isotonic regression on a fold that the ridge didn't see turns
raw scores into shares of good documents. All labelled rows count, not a sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import Scratch, arrow_map, summed
from loomlog.llm.textbytes import PIECE, SPACE, column_bytes, runs, words

FEATURES, SEED, RIDGE = 256, 20_011, 1e-4
BINS = 2000
#: Of four folds of the labelled rows, this one calibrates.
CALIBRATE = 3

NAMES = ("bytes", "words", "word_length", "upper", "lower", "digit", "stop", "symbol", "bang", "bar", "high", "line_words", "lines", "distinct", "top_word", "bigram_distinct", "repeated_lines", "shout", "capital", "symbol_words", "entropy", "long_words")
_class = np.full(256, 7, np.int64)  # other symbols
_class[65:91], _class[97:123], _class[48:58], _class[128:] = 0, 1, 2, 3
_class[[*b".,;:?'\"()-"]] = 4
_class[ord("!")], _class[ord("|")] = 5, 6
_class[np.flatnonzero(SPACE)] = 8
_plain = np.isin(np.arange(256), [*b".,;:?'\"()-|", *np.flatnonzero(SPACE)]) | (_class <= 3)


def _shares(values: np.ndarray) -> tuple[float, float]:
    """Distinct values and the count of the commonest, over the number of values."""
    if not len(values):
        return 1.0, 0.0
    v = np.sort(values)
    at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    return len(at) / len(v), np.diff(np.append(at, len(v))).max() / len(v)


def _inside(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Bytes of each word that have a flag."""
    out, at = np.zeros(len(starts), np.int64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        lo = starts[at]
        total = np.concatenate([[0], np.cumsum(flags[data[lo : ends[to - 1]]])])
        out[at:to] = total[ends[at:to] - lo] - total[starts[at:to] - lo]
        at = to
    return out


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of the statistics NAMES for each document; all 0 where a text is empty, but for distinct shares of 1.

    Numbers of 64 bits are made for PIECE bytes at a time, and for words and lines; whole texts are held as bytes only.
    """
    n = len(off) - 1
    size = np.diff(off)
    counts = np.zeros((n, 256), np.int64)
    for lo in range(0, len(data), PIECE):
        part = data[lo : lo + PIECE]
        doc = np.repeat(np.arange(n), np.diff(np.clip(off - lo, 0, len(part))))
        counts += np.bincount(doc * 256 + part, minlength=256 * n).reshape(n, 256)
    kinds = np.zeros((n, 9))
    np.add.at(kinds, (slice(None), _class), counts)
    letters = np.maximum(kinds[:, :2].sum(axis=1), 1)
    visible = np.maximum(kinds[:, :8].sum(axis=1), 1)
    hashes, starts, ends, at = words(data, off)
    length = ends - starts
    n_words = np.maximum(np.diff(at), 1).astype(float)
    of = np.repeat(np.arange(n), np.diff(at))
    total = lambda x: np.bincount(of, x, n)
    up, odd, low = (_inside(data, starts, ends, flags) for flags in (_class == 0, ~_plain, _class == 1))
    newline = np.ones(len(data), bool)
    newline[data == 10] = False
    ls, le = runs(newline, off)
    lines_at = np.searchsorted(ls, off)
    word_at_line = np.searchsorted(starts, np.concatenate([ls, [len(data)]]))
    lines = np.maximum(np.diff(lines_at), 1).astype(float)
    sums = np.concatenate([np.zeros(1, hashes.dtype), np.cumsum(hashes)])
    line_hash = sums[np.searchsorted(starts, le)] - sums[word_at_line[:-1]]  # the sum of its words' hashes
    out = np.zeros((n, len(NAMES)))
    each = np.zeros((n, 4))
    for i in range(n):
        h = hashes[at[i] : at[i + 1]]
        each[i, :2] = _shares(h)
        each[i, 2] = _shares(h[:-1] * h.dtype.type(0x9E3779B97F4A7C15) + h[1:])[0]
        each[i, 3] = 1 - _shares(line_hash[lines_at[i] : lines_at[i + 1]])[0]
    entropy = np.zeros(n)
    counts = counts / np.maximum(size, 1)[:, None]
    np.subtract.at(entropy, np.nonzero(counts)[0], counts[counts > 0] * np.log2(counts[counts > 0]))
    columns = [
        np.log1p(size), np.log1p(np.diff(at)), total(length) / n_words, kinds[:, 0] / letters, kinds[:, 1] / letters, kinds[:, 2] / visible, kinds[:, 4] / visible, kinds[:, 7] / visible,
        kinds[:, 5] / visible, kinds[:, 6] / visible, kinds[:, 3] / visible, np.log1p(n_words / lines), np.log1p(lines), each[:, 0], each[:, 1], each[:, 2], each[:, 3],
        total((up >= 2) & (low == 0)) / n_words, total(_class[data[starts]] == 0) / n_words if len(starts) else np.zeros(n),
        total(odd > 0) / n_words, entropy, total(length > 20) / n_words,
    ]
    for k, c in enumerate(columns):
        out[:, k] = c
    return out


def _kinds(df: DataFrame, columns: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def document_statistics(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns and stats, float32 of NAMES as bytes, for each row of docs (text, ..). Null counts as empty; rows that repeat stay."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = statistics(*column_bytes(batch["__text"])).astype(np.float32)
        return pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array([x.tobytes() for x in s], pa.binary())], [*columns, "stats"])

    return arrow_map(docs.select(*columns, F.col("text").cast("string").alias("__text")), run, f"{_kinds(docs, columns)}, stats binary")


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # empty: nothing was learned
    edges: np.ndarray  # raw scores, ascending
    values: np.ndarray  # calibrated scores there


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, len(NAMES)).astype(float)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """cos(w x + b) features of a Gaussian kernel whose width is the root of the number of statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(len(NAMES), FEATURES)) / np.sqrt(len(NAMES)) * 1.5
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ w + rng.uniform(0, 2 * np.pi, FEATURES)), z / 10, np.ones((len(x), 1))], axis=1)


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to values by weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """From stats (doc_id, stats) and labels (doc_id, quality 0 or 1), on all rows whose ids meet. Labels of an id that differ count by their mean."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    rows = Scratch(stats.sparkSession).write(stats.join(labels, "doc_id").select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("fold")), "labelled")
    d = len(NAMES)

    def moments(batch: pa.RecordBatch, total: np.ndarray) -> None:
        x = _matrix(batch["stats"])
        total += np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    m = summed(rows, moments, 1 + 2 * d)
    if m is None:
        return QualityModel(np.zeros(d), np.ones(d), np.zeros(0), np.zeros(0), np.zeros(0))
    mean = m[1 : d + 1] / m[0]
    scale = np.sqrt(np.maximum(m[d + 1 :] / m[0] - mean**2, 0))
    scale = np.where(scale > 1e-6, scale, 1.0)

    def normal(batch: pa.RecordBatch, total: np.ndarray) -> None:
        z, y = fourier(_matrix(batch["stats"]), mean, scale), batch["y"].to_numpy()
        total += np.concatenate([(z.T @ z).ravel(), z.T @ y])

    k = FEATURES + d + 1
    total = summed(rows.where(F.col("fold") != CALIBRATE), normal, k * k + k)
    held = rows.where(F.col("fold") == CALIBRATE)
    if total is None:  # a handful of rows, all of the calibrating fold
        total, held = summed(rows, normal, k * k + k), rows
    weights = np.linalg.solve(total[: k * k].reshape(k, k) + RIDGE * m[0] / k * np.eye(k), total[k * k :])

    def binned(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = fourier(_matrix(batch["stats"]), mean, scale) @ weights
        return pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(raw, -0.5, 1.5) * BINS / 2).astype(np.int64)), batch["y"]], ["bin", "y"])

    bins = sorted(arrow_map(held, binned, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y")).collect(), key=lambda r: r["bin"])
    if not bins:
        return QualityModel(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    at, n = np.array([(r["bin"] + 0.5) * 2 / BINS for r in bins]), np.array([float(r["n"]) for r in bins])
    level = pool_adjacent(np.array([r["y"] for r in bins]), n)
    # a block of equal levels stands at its mean score, so that scores between blocks still rise
    block = np.concatenate([[0], np.cumsum(level[1:] > level[:-1])])
    middle = np.bincount(block, at * n) / np.bincount(block, n)
    return QualityModel(mean, scale, weights, middle, np.array([level[block == b][0] for b in range(block[-1] + 1)]))


def score(stats: DataFrame, model: QualityModel, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns and score, 0 to 1, for each row of stats, also where a doc_id is null or repeats. A model that learned nothing gives 0.5."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if len(model.weights):
            raw = fourier(_matrix(batch["stats"]), model.mean, model.scale) @ model.weights
            s = np.clip(np.interp(raw, model.edges, model.values) * 0.999 + 0.001 * np.clip(raw, 0, 1), 0, 1)
        else:
            s = np.full(batch.num_rows, 0.5)
        return pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(s)], [*columns, "score"])

    return arrow_map(stats.select(*columns, "stats"), run, f"{_kinds(stats, columns)}, score double")
