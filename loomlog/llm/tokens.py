"""Token ids of whole texts, by the tokenizers library, with a bounded cache of pieces.

The byte-level pre-tokenizer always starts a new word where white space begins, at the last of several white spaces before something
else, after one that isn't a space, and where a letter or digit is followed by a sign other than an apostrophe. A text
cut there can be encoded piece by piece. Pieces are looked up all at once in a table of arrays, by their bytes and not by a hash alone; those
that it lacks go to the library. Stretches with characters that aren't ASCII or Latin-1 letters are cut only at spaces between ASCII
characters.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import public_tokenizers

from loomlog.llm.common import CACHES
from loomlog.llm.textbytes import SPACE, U, fmix

VOCABULARY = "byte_bpe_50k.json"
#: Slots of the table, and its pieces at most before those used since then replace the older ones; the longest piece in it.
SLOTS, PIECES, LONGEST = 1 << 20, 600_000, 16
#: Bytes that are cut at once; a longer text is taken in parts that end where a piece does.
PART = 1 << 20
#: Pieces that the library gets as one text.
JOINED = 1000
WORD, SIGN, BLANK, WHITE, APOSTROPHE, RARE = range(6)
_kind = np.full(256, SIGN, np.uint8)
_kind[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = WORD
_kind[np.flatnonzero(SPACE)] = WHITE
_kind[0x20], _kind[0x27] = BLANK, APOSTROPHE
_kind[[0, *range(0x1C, 0x20), 0x7F, 0xC0, 0xC1, 0xC2, *range(0xC4, 0x100)]] = RARE
_plain = np.isin(_kind, [WORD, SIGN, APOSTROPHE]) & (np.arange(256) < 0x80)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def cuts(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of pieces, those of texts (begins) among them, and which pieces are of stretches that can't be cut further."""
    kind = _kind[data]
    white = (kind == BLANK) | (kind == WHITE)
    odd = kind == RARE
    # multiplication and division signs are no letters
    odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = white[:-1], white[1:]
    before[begins] = False
    after[begins[1:] - 1] = after[-1:] = True  # at its end, a text's white space stays in one piece
    cut = white & ~(before & after)
    cut[1:] |= ((kind[1:] == SIGN) & (kind[:-1] == WORD)) | ((kind[:-1] == WHITE) & ~white[1:])
    strange = odd.any()
    if strange:
        plain = _plain[data]
        sure = kind == BLANK
        sure[1:] &= plain[:-1]
        sure[:-1] &= plain[1:]
        sure[[0, -1]] = False
        sure[begins] = True
        stretch = np.cumsum(sure)
        bad = np.zeros(int(stretch[-1]) + 1, bool)
        bad[stretch[odd]] = True
        cut &= ~bad[stretch] | sure
    cut[begins] = True
    starts = np.flatnonzero(cut)
    return starts, bad[stretch[starts]] if strange else np.zeros(len(starts), bool)


class _Table:
    """Ids of pieces of LONGEST bytes at most: open addressing over arrays; place is where a piece's ids begin in a pool, times 256, and their number."""

    def __init__(self):
        self.a, self.b, self.place = np.zeros(SLOTS, U), np.zeros(SLOTS, U), np.zeros(SLOTS, np.int64)
        self.pool, self.filled, self.pieces = np.zeros(1 << 16, np.uint32), 0, 0

    @staticmethod
    def slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (fmix(a * U(0x9FB21C651E98DF25) + b) & U(SLOTS - 1)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of keys, 0 for those that aren't there."""
        slot = self.slots(a, b)
        found = self.place.take(slot)
        left = np.flatnonzero((found != 0) & ((self.a.take(slot) != a) | (self.b.take(slot) != b)))
        while len(left):
            slot[left] = at = (slot[left] + 1) & (SLOTS - 1)
            found[left] = place = self.place.take(at)
            left = left[(place != 0) & ((self.a.take(at) != a[left]) | (self.b.take(at) != b[left]))]
        return found

    def append(self, ids: np.ndarray) -> int:
        """Puts ids into the pool; where they begin."""
        at = self.filled
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[at : at + len(ids)] = ids
        self.filled += len(ids)
        return at

    def add(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> None:
        """New keys, each once, with places that differ."""
        slot, left = self.slots(a, b), np.arange(len(a))
        while len(left):
            free = left[self.place.take(slot[left]) == 0]
            self.place[slot[free]] = place[free]
            won = free[self.place.take(slot[free]) == place[free]]
            self.a[slot[won]], self.b[slot[won]] = a[won], b[won]
            done = np.zeros(len(a), bool)
            done[won] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
        self.pieces += len(a)


class Encoder:
    def __init__(self, path: str):
        # an executor's cores have tasks of their own; the library reads this at each batch
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.forget()
        CACHES.append(self.forget)

    def forget(self) -> None:
        self.table: _Table | None = None
        self.old: _Table | None = None

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one piece after another, and the number of each piece's."""
        texts = [p.decode() for p in pieces]
        # a piece of a space and a word: where such follow each other, only their first ids begin with a space
        alike = np.array([t[0] == " " and len(t) > 1 and " " not in t[1:] and len(t.split()) == 1 and not t[-1].isspace() for t in texts], bool)
        count, parts = np.zeros(len(texts), np.int64), [None] * len(texts)
        rows = np.flatnonzero(alike)
        groups = [rows[k : k + JOINED] for k in range(0, len(rows), JOINED)]
        for group, ids in zip(groups, self._library(["".join(texts[i] for i in g) for g in groups]), strict=True):
            ids = np.array(ids, np.uint32)
            begin = np.flatnonzero(self.spaced[ids])
            if len(begin) != len(group):  # a vocabulary that marks spaces otherwise
                alike[group] = False
                continue
            count[group] = np.diff(np.append(begin, len(ids)))
            for i, own in zip(group.tolist(), np.split(ids, begin[1:]), strict=True):
                parts[i] = own
        rows = np.flatnonzero(~alike).tolist()
        for i, ids in zip(rows, self._library([texts[i] for i in rows]), strict=True):
            parts[i], count[i] = np.array(ids, np.uint32), len(ids)
        return np.concatenate([*parts, np.zeros(0, np.uint32)]), count

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places in the table of all keys."""
        if self.table is None or self.table.pieces > PIECES:
            self.old, self.table = self.table, _Table()
        table, old = self.table, self.old
        place = table.find(a, b)
        lacking = np.flatnonzero(place == 0)
        if len(lacking):
            keys, back = np.unique(np.stack([a[lacking], b[lacking]], axis=1).view("V16").ravel(), return_inverse=True)
            pairs = keys.view(U).reshape(-1, 2)
            fresh = np.zeros(len(keys), np.int64)
            if old is not None:
                fresh = old.find(pairs[:, 0], pairs[:, 1])
                rows = np.flatnonzero(fresh)
                n, at = fresh[rows] & 255, fresh[rows] >> 8
                ends = np.cumsum(n)
                first = table.append(old.pool[np.repeat(at - (ends - n), n) + np.arange(int(n.sum()))])
                fresh[rows] = (first + ends - n) << 8 | n
            rows = np.flatnonzero(fresh == 0)
            ids, n = self._ids([pairs[i].tobytes().rstrip(b"\0") for i in rows])
            first = table.append(ids)
            fresh[rows] = (first + np.cumsum(n) - n) << 8 | n
            table.add(pairs[:, 0].copy(), pairs[:, 1].copy(), fresh)
            place[lacking] = fresh[back]
        return place

    def _part(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of bytes with texts that begin at `begins`, none empty: starts of pieces, their ids, and the number of each piece's."""
        starts, odd = cuts(data, begins)
        size = np.diff(np.append(starts, len(data)))
        # all eight bytes from each place on, as one number
        padded = np.concatenate([data, np.zeros(LONGEST, np.uint8)])
        eight = np.ndarray(len(data) + 9, "<u8", padded.data, strides=(1,))
        short = np.flatnonzero((size <= LONGEST) & (data[starts] != 0) & ~odd)
        s, n = starts[short], size[short]
        place = np.zeros(len(starts), np.int64)
        place[short] = self._look_up(eight[s] & _MASK[np.minimum(n, 8)], eight[s + 8] & _MASK[np.maximum(n - 8, 0)])
        rest = np.ones(len(starts), bool)
        rest[short] = False
        rest = np.flatnonzero(rest)
        table, filled = self.table, self.table.filled
        number, at = place & 255, place >> 8
        if len(rest):
            raw = data.tobytes()
            ids, count = self._ids([raw[i : i + n] for i, n in zip(starts[rest].tolist(), size[rest].tolist(), strict=True)])
            number[rest], at[rest] = count, table.append(ids) + np.cumsum(count) - count
            table.filled = filled  # they were there for this call only
        ends = np.cumsum(number)
        return starts, table.pool.take(np.repeat(at - (ends - number), number) + np.arange(int(ends[-1]))), number

    def encode(self, data: np.ndarray, off: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of a column's bytes and offsets: all ids as uint32, and the offsets of each text's, with the id `end` after each text if given."""
        texts = np.flatnonzero(np.diff(off))
        begins, total = off[texts], np.zeros(len(off) - 1, np.int64)
        out, lo = [], 0
        while lo < len(data):
            hi = min(lo + PART, len(data))
            first = np.searchsorted(begins, lo, "right") - 1
            if hi < len(data):
                hi = self._stop(data, begins, lo, hi)
            own = begins[first : int(np.searchsorted(begins, hi))]
            starts, ids, number = self._part(data[lo:hi], np.maximum(own - lo, 0))
            of = first + np.searchsorted(own, starts + lo, "right") - 1
            total[texts] += np.bincount(of, number, len(texts)).astype(np.int64)
            out.append(ids)
            lo = hi
        ids = np.concatenate([*out, np.zeros(0, np.uint32)])
        at = np.concatenate([[0], np.cumsum(total)])
        if end is not None:
            ids = np.insert(ids, at[1:], np.uint32(end))
            at = at + np.arange(len(at))
        return ids, at

    @staticmethod
    def _stop(data: np.ndarray, begins: np.ndarray, lo: int, hi: int) -> int:
        """The last place up to hi, else the first one after it, where a text begins or a space stands between ASCII characters."""
        text = int(begins[np.searchsorted(begins, hi, "right") - 1])
        if text > lo:
            return text
        after = int(begins[k]) if (k := np.searchsorted(begins, hi, "right")) < len(begins) else len(data)
        while True:
            part = data[lo : min(hi + 1, after)]
            sure = np.flatnonzero((part[1:-1] == 0x20) & _plain[part[:-2]] & _plain[part[2:]]) + 1
            if len(sure):
                return lo + int(sure[-1])
            if hi >= after:
                return after
            hi += PART


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One for each Python process. The name of a public vocabulary, or a path."""
    return Encoder(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
