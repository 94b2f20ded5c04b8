"""Array programs over the UTF-8 bytes of whole Arrow text columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one pass of the word hash holds in arrays; a cut falls only on white space or between documents.
PIECE = 1 << 20
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fmix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of a multiply-shift hash, in place."""
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


#: Letters and digits of ASCII, and all other characters' bytes.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


BYTE_HASH = fmix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i below n."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, PIECE + (1 << 16))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, b, U)]), dtype=U) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and n + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that stop at document ends."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = off[:-1][off[1:] > off[:-1]]
    first[cut] = inside[cut]
    before = cut[cut > 0] - 1
    last[before] = inside[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, off: np.ndarray, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+, or runs of the bytes flagged in part, with A-Z lower-cased: 64-bit hashes, starts, ends, and the n + 1 word offsets of documents."""
    starts, ends = runs((~SPACE if part is None else part)[data], off)
    hashes = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        lo, hi = starts[at], ends[to - 1]
        pw, inverse = powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(BYTE_HASH[LOWER[data[lo:hi]]] * pw[: hi - lo], out=total[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        hashes[at:to] = fmix((total[e] - total[s]) * inverse[s] + (e - s).astype(U) * U(0x9E3779B97F4A7C15))
        at = to
    return hashes, starts, ends, np.searchsorted(starts, off)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """One document's distinct n-word shingles as sorted 64-bit hashes; with fewer words, the whole sequence as one."""
    if not len(hashes):
        return hashes
    n_here = min(n, len(hashes))
    out = np.full(len(hashes) - n_here + 1, n_here, U)
    for i in range(n_here):
        out = fmix(out * U(0x9FB21C651E98DF25) + hashes[i : i + len(out)])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]
