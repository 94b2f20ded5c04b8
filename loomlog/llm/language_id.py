"""Language identification with a string kernel.

A text is the set of its byte n-grams of 1 to 4 bytes (the blended spectrum, by presence), hashed to BINS bins. The kernel of
two texts is the number of bins they share over the root of the product of their sizes. Nystroem landmarks, drawn
evenly from the languages, turn it into features; one-versus-rest kernel ridge regression on those gives a
score for each language. A batch is scored by two matrix products: presence by landmarks, then by coefficients.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.llm.common import arrow_map
from loomlog.llm.textbytes import PIECE, U, column_bytes

BITS = 13
BINS = 1 << BITS
NGRAMS = (1, 2, 3, 4)
LANDMARKS = 256
#: Bounds of the training sample: rows of a language, rows in all, and languages (the most frequent).
PER_LANGUAGE, SAMPLE, LANGUAGES = 400, 20_000, 1024
RIDGE, SHARPNESS = 1e-2, 6.0
UND = "und"

_letters = np.full(256, 0x20, np.uint8)
_letters[97:123] = np.arange(97, 123)
_letters[65:91] = np.arange(97, 123)
_letters[128:] = np.arange(128, 256)


def presence(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of BINS flags for each document. Case is folded for A-Z and the Latin-1 letters; what is no letter counts as one space.

    Numbers of 64 bits are made for PIECE bytes at a time; whole texts are held as bytes only.
    """
    x = _letters[data]
    if len(x):
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        x[latin] += 0x20
    keep = x != 0x20
    keep[1:] |= keep[:-1].copy()
    begins = off[:-1][np.diff(off) > 0]
    keep[begins] = True
    size = np.zeros(len(off) - 1, np.int64)
    size[np.diff(off) > 0] = np.add.reduceat(keep, begins, dtype=np.int64) if len(begins) else 0
    x, ends = x[keep], np.cumsum(size)
    out = np.zeros((len(off) - 1) * BINS, bool)
    for lo in range(0, len(x), PIECE):
        part = x[lo : lo + PIECE + NGRAMS[-1] - 1].astype(U)
        doc = np.repeat(np.arange(len(size)), np.diff(np.clip(np.concatenate([[0], ends]) - lo, 0, len(part))))
        code = np.zeros(len(part), U)
        for n in NGRAMS:
            if len(part) < n:
                break
            m = len(part) - n + 1
            code = (code[:m] << U(8)) | part[n - 1 :]
            whole = doc[:m] == doc[n - 1 :]
            at = (((code + U(n << 40)) * U(0x9E3779B97F4A7C15)) >> U(64 - BITS)).astype(np.int64)
            at += doc[:m] * BINS
            out[at[whole]] = True
    return out.reshape(-1, BINS)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    landmarks: bytes  # bits of each landmark's presence
    coefficients: np.ndarray  # landmarks by languages


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two arrays of flags as float32."""
    size = lambda x: np.sqrt(np.maximum(x.sum(axis=1), 1))
    return (a @ b.T) / size(a)[:, None] / size(b)[None, :]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit_arrays(flags: np.ndarray, lang: np.ndarray) -> LanguageModel:
    """flags: a row of BINS for each text, in an order that doesn't depend on the language."""
    languages = sorted(set(lang.tolist()))
    if not languages:
        return LanguageModel((), b"", np.zeros((0, 0)))
    each = max(1, LANDMARKS // len(languages))
    chosen = np.concatenate([np.flatnonzero(lang == x)[:each] for x in languages])
    marks = flags[chosen].astype(np.float32)
    w, v = np.linalg.eigh(kernel(marks, marks).astype(float))
    root = v / np.sqrt(np.maximum(w, 1e-3))
    phi = kernel(flags.astype(np.float32), marks).astype(float) @ root
    weight = np.array([1 / np.sum(lang == x) for x in lang])  # each language weighs the same
    y = np.where(lang[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    gram = phi.T @ (phi * weight[:, None]) + RIDGE / len(languages) * np.eye(phi.shape[1])
    beta = np.linalg.solve(gram, phi.T @ (y * weight[:, None]))
    return LanguageModel(tuple(languages), np.packbits(flags[chosen], axis=1).tobytes(), root @ beta)


def fit(rows: DataFrame) -> LanguageModel:
    """From rows (doc_id, text, lang). Rows without a language or a letter teach nothing; doc_id only picks the sample."""
    rows = rows.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).withColumn("order", F.xxhash64("doc_id"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return fit_arrays(np.zeros((0, BINS), bool), np.array([], str))
    each = min(PER_LANGUAGE, SAMPLE // len(counts))
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (2 * each + 20) / n))))
    near = rows.where(F.pmod("order", F.lit(1_000_003)) < F.coalesce(share[F.col("lang")], F.lit(0.0)) * 1_000_003)
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("order", F.lit(1_000_003)), "order", "text"))
    sample = near.withColumn("k", order).where(F.col("k") <= each).select("text", "lang", "k")

    def bits(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = np.packbits(presence(*column_bytes(batch["text"])), axis=1)
        return pa.RecordBatch.from_arrays([batch["lang"], batch["k"], pa.array([x.tobytes() for x in packed], pa.binary())], ["lang", "k", "bits"])

    got = sorted(arrow_map(sample, bits, "lang string, k int, bits binary").collect(), key=lambda r: (r["k"], r["lang"], bytes(r["bits"])))
    flags = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in got), np.uint8).reshape(-1, BINS // 8), axis=1).astype(bool)
    return fit_arrays(flags, np.array([r["lang"] for r in got]))


def predict(docs: DataFrame, model: LanguageModel, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns of docs with lang_pred and score, for each row.

    lang_pred is 'und' with score 0 if the text is null, empty or without a letter, or if the model has learned no language.
    Equal scores go to the first language in alphabetical order.
    """
    docs = docs.select(*columns, F.col("text").cast("string").alias("__text"), has_letter(F.col("text")).alias("__letter"))

    def make():
        names = np.array([*model.languages, UND], object)
        marks = np.unpackbits(np.frombuffer(model.landmarks, np.uint8).reshape(-1, BINS // 8), axis=1).astype(np.float32)
        scaled = np.ascontiguousarray((marks / np.sqrt(np.maximum(marks.sum(axis=1), 1))[:, None]).T)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            best, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            known = batch["__letter"].to_numpy(zero_copy_only=False)
            if model.languages and known.any():
                flags = presence(*column_bytes(batch["__text"].filter(batch["__letter"])))
                k = flags.astype(np.float32) @ scaled / np.sqrt(np.maximum(flags.sum(axis=1), 1))[:, None]
                f = SHARPNESS * (k @ model.coefficients)
                p = np.exp(f - f.max(axis=1, keepdims=True))
                best[known], score[known] = f.argmax(axis=1), (p / p.sum(axis=1, keepdims=True)).max(axis=1)
            return pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(names[best], pa.string()), pa.array(score)], [*columns, "lang_pred", "score"])

        return run

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return arrow_map(docs, make, f"{kinds}, lang_pred string, score double", per_task=True)
