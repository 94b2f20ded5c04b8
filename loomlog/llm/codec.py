"""A file format for token ids: blocks of BLOCK ids, each coded on its own by an adaptive range coder with mixed contexts.

A block is cut into lanes of STEPS ids that advance together, an id each at a step, as arrays. All lanes of a block share one
model, which starts empty and learns from each step, so that its tables stay small enough for a core's cache. It
predicts from three orders: the id that mostly followed the two ids before (order 2), the one that mostly followed the id before
(order 1), and the counts of the block's ids so far (order 0). How far each order is trusted is learned while
coding, by counts of what came true for each pair of confidences; ids new to the block are coded evenly over the vocabulary.
Each lane has a range coder of its own, with 64-bit bounds that move out 32 bits at a time.

A block: magic, ids, vocabulary, length of the body, crc32 of the ids as little-endian unsigned 32-bit integers, crc32 of the
body, and the body: the number of words of each lane (16 bits each), then the lanes' codes as 32-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, STEPS = 4096, 256
BLOCK = LANES * STEPS
MAGIC = b"LMC2"
HEADER = struct.Struct("<4sIIIII")
HIT2, HIT1, SEEN, NEW = range(4)
#: Entries of the order-2 table; contexts, as pairs of confidences and whether both orders predict the same id.
PAIRS, CONTEXTS, SURE = 1 << 17, 128, 7
#: Shares of the four outcomes are edges on a scale of 2**SCALE, of which each outcome keeps one part at least.
SCALE = 10
#: Ids below this fit the tables, which hold id << 3 | confidence.
MOST = 1 << 28
U = np.uint64
LOW32 = U((1 << 32) - 1)


class Corrupt(ValueError):
    """A block whose frame or checksum is wrong."""


class _Model:
    """The state of one block; what `lanes` lanes see and learn at a step."""

    def __init__(self, lanes: int, vocabulary: int):
        self.one, self.two = np.zeros(vocabulary, np.uint32), np.zeros(PAIRS, np.uint32)
        self.p1, self.p2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.came = np.ones((CONTEXTS, 4), np.int64)
        self.count, self.cum = np.zeros(vocabulary, np.int64), np.zeros(vocabulary + 1, np.int64)
        self.inverse = np.zeros(1, np.int64)
        self.total, self.next, self.since = 1, 0, 0

    def refresh(self, step: int, ids: np.ndarray, inverse: bool) -> None:
        """What was learned enters the shares at steps that grow by a quarter; ids: a row of all lanes for each step."""
        if step < self.next:
            return
        if step:
            self.count += np.bincount(ids[self.since : step].ravel(), minlength=len(self.count))
            np.cumsum(self.count, out=self.cum[1:])
            self.total = int(self.cum[-1])
            if inverse:
                self.inverse = np.repeat(np.arange(len(self.count)), self.count)
        self.since, self.next = step, step + max(1, step // 4)
        share = self.came * ((1 << SCALE) - 4) // self.came.sum(axis=1, keepdims=True) + 1
        self.edges = np.zeros((CONTEXTS, 5), U)
        self.edges[:, 1:4] = np.cumsum(share[:, :3], axis=1)
        self.edges[:, 4] = 1 << SCALE
        if inverse:
            self.outcome = np.repeat(np.tile(np.arange(4, dtype=np.uint8), CONTEXTS), np.diff(self.edges.astype(np.int64), axis=1).ravel())
        self.start, self.size = self.edges[:, :4].ravel(), np.diff(self.edges, axis=1).ravel()

    def predict(self) -> None:
        self.at2 = (self.p2 * 40503 ^ self.p1 * 2654435761 >> 7) & (PAIRS - 1)
        self.v1, self.v2 = self.one.take(self.p1), self.two.take(self.at2)
        self.id1, self.id2 = self.v1 >> 3, self.v2 >> 3
        self.context = ((self.v2 & 7) << 4 | (self.v1 & 7) << 1 | (self.id1 == self.id2)).astype(np.int64) << 2

    def update(self, cell: np.ndarray, ids: np.ndarray) -> None:
        """cell: the context and outcome of each lane. Lanes that write to one place do so in their order."""
        self.came += np.bincount(cell, minlength=CONTEXTS * 4).reshape(CONTEXTS, 4)
        new = ids.astype(np.uint32) << 3 | 1
        for table, at, v, same in ((self.one, self.p1, self.v1, self.id1 == ids), (self.two, self.at2, self.v2, self.id2 == ids)):
            sure = v & 7
            table[at] = np.where(same & (sure > 0), v + (sure < SURE), np.where(sure > 1, v - (sure >> 1), new))
        self.p2, self.p1 = self.p1, ids


def _settle(low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes whose width has fallen below 32 bits, and their words that move out."""
    rows = np.flatnonzero(width <= LOW32)
    lo, wide = low[rows], width[rows]
    # a range that lies across a word's end is cut there
    wide = np.where((lo ^ (lo + wide)) > LOW32, (~lo + U(1)) & LOW32, wide)
    low[rows], width[rows] = lo << U(32), wide << U(32)
    return rows, lo >> U(32)


def _shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids."""
    lanes = -(-n // STEPS)
    return lanes, min(n, STEPS)


def encode(ids: np.ndarray, vocabulary: int) -> list[bytes]:
    """Blocks of BLOCK ids each, the last maybe shorter; ids below vocabulary."""
    if not len(ids):
        return []
    if int(ids.max()) >= vocabulary or vocabulary > MOST:
        raise ValueError("an id is outside the vocabulary, or the vocabulary is too large")
    return [_encoded(ids[k : k + BLOCK], vocabulary) for k in range(0, len(ids), BLOCK)]


def _encoded(ids: np.ndarray, vocabulary: int) -> bytes:
    lanes, steps = _shape(len(ids))
    grid = np.zeros(lanes * steps, np.int64)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    m = _Model(lanes, vocabulary)
    low, width = np.zeros(lanes, U), np.full(lanes, ~U(0))
    words, where = [], []
    for t in range(steps):
        m.refresh(t, grid, False)
        m.predict()
        x = grid[t]
        start = m.cum.take(x)
        size = m.cum.take(x + 1) - start
        outcome = np.where(size > 0, SEEN, NEW)
        outcome[(m.id1 == x) & (m.v1 > 0)] = HIT1
        outcome[(m.id2 == x) & (m.v2 > 0)] = HIT2
        cell = m.context + outcome
        width >>= U(SCALE)
        low += width * m.start.take(cell)
        width *= m.size.take(cell)
        if len(r := np.flatnonzero(outcome == SEEN)):
            step = width[r] // U(m.total)
            low[r] += step * start[r].astype(U)
            width[r] = step * size[r].astype(U)
        if len(r := np.flatnonzero(outcome == NEW)):
            width[r] = step = width[r] // U(vocabulary)
            low[r] += step * x[r].astype(U)
        m.update(cell, x)
        rows, out = _settle(low, width)
        where.append(rows)
        words.append(out)
    # the least multiple of a word in a lane's range stands for it; what a decoder reads past it is zero
    where.append(np.arange(lanes))
    words.append((low + LOW32) >> U(32))
    where, words = np.concatenate(where), np.concatenate(words)
    body = np.bincount(where, minlength=lanes).astype("<u2").tobytes() + words[np.argsort(where, kind="stable")].astype("<u4").tobytes()
    return HEADER.pack(MAGIC, len(ids), vocabulary, len(body), zlib.crc32(np.ascontiguousarray(ids).astype("<u4")), zlib.crc32(body)) + body


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises Corrupt if a frame or checksum is wrong."""
    return [_decoded(b) for b in blocks]


def _decoded(block: bytes) -> np.ndarray:
    if len(block) < HEADER.size:
        raise Corrupt("a block is too short")
    magic, n, vocabulary, size, crc, body_crc = HEADER.unpack_from(block)
    lanes, steps = _shape(n)
    if magic != MAGIC or len(block) != HEADER.size + size or zlib.crc32(block[HEADER.size :]) != body_crc or not 0 < n <= BLOCK or not 0 < vocabulary <= MOST or size < 2 * lanes or (size - 2 * lanes) % 4:
        raise Corrupt("a block's frame or body is damaged")
    lengths = np.frombuffer(block, "<u2", lanes, HEADER.size).astype(np.int64)
    code = np.frombuffer(block, "<u4", offset=HEADER.size + 2 * lanes)
    if lengths.sum() != len(code):
        raise Corrupt("a block's lanes don't fill its body")
    # each lane's words, and zeros for as many as it can read past them
    most = int(lengths.max()) + 3
    data = np.zeros((lanes, most), U)
    data[np.arange(most)[None, :] < lengths[:, None]] = code
    data = data.ravel()
    m = _Model(lanes, vocabulary)
    at = np.arange(lanes) * most
    low, width = np.zeros(lanes, U), np.full(lanes, ~U(0))
    # the code's distance from low
    code = data.take(at) << U(32) | data.take(at + 1)
    at += 2
    out = np.zeros((steps, lanes), np.int64)
    for t in range(steps):
        m.refresh(t, out, True)
        m.predict()
        width >>= U(SCALE)
        target = np.minimum((code - low) // width, U((1 << SCALE) - 1)).astype(np.int64)
        outcome = m.outcome.take((m.context << (SCALE - 2)) + target)
        cell = m.context + outcome
        low += width * m.start.take(cell)
        width *= m.size.take(cell)
        x = np.where(outcome == HIT2, m.id2, m.id1).astype(np.int64)
        if len(r := np.flatnonzero(outcome == SEEN)):
            w, lo = width[r], low[r]
            step = np.maximum(w // U(m.total), U(1))
            x[r] = found = m.inverse.take(((code[r] - lo) // step).astype(np.int64), mode="clip")
            start = m.cum.take(found)
            low[r] = lo + step * start.astype(U)
            width[r] = step * (m.cum.take(found + 1) - start).astype(U)
        if len(r := np.flatnonzero(outcome == NEW)):
            step = np.maximum(width[r] // U(vocabulary), U(1))
            new = np.minimum((code[r] - low[r]) // step, U(vocabulary - 1))
            low[r] += step * new
            width[r] = step
            x[r] = new
        out[t] = x
        m.update(cell, x)
        rows, _ = _settle(low, width)
        p = at[rows]
        code[rows] = code[rows] << U(32) | data.take(p, mode="clip")
        at[rows] = p + 1
    ids = out.T.ravel()[:n].astype("<u4")
    if zlib.crc32(np.ascontiguousarray(ids)) != crc:
        raise Corrupt("a block's ids don't match their checksum")
    return ids
