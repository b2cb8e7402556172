"""The byte-level pretokens of a flat text buffer, and a pool of distinct ones.

``cuts`` gives where the matches of the public byte-level BPE pattern
(contractions, letters, numbers, other, white space) start, by array passes over
character classes; the classes of all code points come from the ``regex``
module at start-up.  ``Pool`` numbers distinct pretokens of the rows that one
task has seen, told apart by their bytes.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import regex

from .flat import gather, hashes

S, L, N, O = 0, 1, 2, 3
#: Pretokens of more bytes are compared one by one.
LONG = 256


@cache
def classes() -> np.ndarray:
    """Class of each code point: white space, letter, number or other."""
    out = np.full(0x110000, O, np.uint8)
    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((L, r"\p{L}+"), (N, r"\p{N}+"), (S, r"\s+")):
        for m in regex.finditer(pattern, points):
            a, b = (x if x < 0xD800 else x + 0x800 for x in (m.start(), m.end() - 1))
            out[a : b + 1] = kind
    return out


def _points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte index of each code point, code point)."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = buf[at].astype(np.int32)
    far = np.flatnonzero(cp >= 0xC0)
    if len(far):
        more = np.concatenate([buf, np.zeros(3, np.uint8)])
        b = at[far]
        c0 = cp[far]
        c1, c2, c3 = ((more[b + k] & 0x3F).astype(np.int32) for k in (1, 2, 3))
        cp[far] = np.where(c0 < 0xE0, (c0 & 0x1F) << 6 | c1, np.where(c0 < 0xF0, (c0 & 0x0F) << 12 | c1 << 6 | c2, (c0 & 0x07) << 18 | c1 << 12 | c2 << 6 | c3))
    return at, cp


def cuts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pretokens of all rows, and for each row the number of its first one (and the total)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    at, cp = _points(buf)
    n = len(at)
    kind = classes()[cp]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, offs[:-1])] = True
    first[n] = True
    run = np.zeros(n, bool)
    run[0] = True
    run[1:] = (kind[1:] != kind[:-1]) | first[1:n]
    start = run.copy()
    # A run after white space takes one plain space; other white space before it stands alone.
    i = np.flatnonzero(run & (kind != S) & ~first[:n])
    i = i[kind[i - 1] == S]
    start[i - 1] = True
    start[i[cp[i - 1] == 0x20]] = False
    # Contractions: an apostrophe that starts a match, then letters of the list.
    i = np.flatnonzero((cp == 0x27) & run)
    if len(i):
        follow = np.concatenate([cp, np.zeros(4, np.int32)])
        last = np.concatenate([first, np.ones(4, bool)])
        free = first[i] | (follow[i - 1] != 0x20)
        one = free & ~last[i + 1] & np.isin(follow[i + 1], [ord(c) for c in "stmd"])
        c1, c2 = follow[i + 1], follow[i + 2]
        two = free & ~last[i + 1] & ~last[i + 2] & (((c1 == 0x72) & (c2 == 0x65)) | ((c1 == 0x76) & (c2 == 0x65)) | ((c1 == 0x6C) & (c2 == 0x6C)))
        for hit, k in ((one, 2), (two, 3)):
            j = i[hit]
            start[j + 1] = False
            j = j + k
            j = j[j < n]
            start[j[(kind[j] == L) & ~first[j]]] = True
    starts = at[start]
    return starts, np.searchsorted(starts, offs)


class Pool:
    """Numbers distinct pretokens; bytes of the new ones are handed over by ``take_new``.

    Pretokens meet by a 64-bit key, and their bytes are compared: those that share a
    key with another pretoken are numbered by their bytes instead.
    """

    def __init__(self) -> None:
        #: Keys of pretokens and their numbers, side by side; the table over them is made anew after new ones.
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.table = pd.Index(self.keys)
        self.odd: dict[bytes, int] = {}
        self.count = self.taken = 0
        self.held: list[np.ndarray] = []
        self.data, self.ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.lens: list[np.ndarray] = []

    def __len__(self) -> int:
        return self.count

    def _settle(self) -> None:
        """Join what was added to the one buffer of all pretokens."""
        if self.held:
            self.data = np.concatenate([self.data, *self.held])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(self.lens))])
            self.held, self.lens = [], []

    def _add(self, data: np.ndarray, lens: np.ndarray) -> np.ndarray:
        self.held.append(data)
        self.lens.append(lens)
        self.count += len(lens)
        return np.arange(self.count - len(lens), self.count)

    def codes(self, buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each pretoken [start, next start)."""
        ends = np.append(starts[1:], len(buf))
        lens = ends - starts
        h = hashes(buf, starts, ends)
        code, uniq = pd.factorize(h)
        first = np.empty(len(uniq), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        # Occurrences whose bytes differ from those of the first with their key.
        odd = lens != lens[first][code]
        odd |= _differ(buf, starts, buf, starts[first][code], np.where(odd, 0, lens))
        place = self.table.get_indexer(uniq)
        known = np.where(place >= 0, self.numbers[place] if len(self.numbers) else -1, -1)
        old = np.flatnonzero(known >= 0)
        if len(old):  # the same for pretokens of earlier calls
            self._settle()
            at, n = self.ends[known[old]], np.diff(self.ends)[known[old]]
            mine = first[old]
            clash = n != lens[mine]
            clash |= _differ(buf, starts[mine], self.data, at, np.where(clash, 0, n))
            if clash.any():
                odd |= np.isin(code, old[clash])
        new = np.flatnonzero(known < 0)
        a, n = starts[first[new]], lens[first[new]]
        known[new] = self._add(buf[gather(a, n)], n)
        if len(new):
            self.keys, self.numbers = np.concatenate([self.keys, uniq[new]]), np.concatenate([self.numbers, known[new]])
            self.table = pd.Index(self.keys)
        out = known[code]
        for i in np.flatnonzero(odd).tolist():
            word = buf[starts[i] : ends[i]]
            if (key := word.tobytes()) not in self.odd:
                self.odd[key] = int(self._add(word.copy(), lens[i : i + 1])[0])
            out[i] = self.odd[key]
        return out

    def take_new(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, lengths) of pretokens numbered since the last call, in order."""
        self._settle()
        at, self.taken = self.taken, self.count
        return self.data[self.ends[at] :], np.diff(self.ends[at:])


#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; beyond the end are zeros."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


def _differ(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Whether pieces of ``a`` and ``b`` of the same lengths differ; eight bytes are compared at once."""
    x = _eights(a)
    y = x if b is a else _eights(b)
    out = (x[a_at] ^ y[b_at]) & _FIRST[np.minimum(lens, 8)] != 0
    left, k = np.flatnonzero((lens > 8) & (lens <= LONG)), 8
    while len(left):
        out[left] |= (x[a_at[left] + k] ^ y[b_at[left] + k]) & _FIRST[np.minimum(lens[left] - k, 8)] != 0
        k += 8
        left = left[lens[left] > k]
    for i in np.flatnonzero(lens > LONG).tolist():
        out[i] = not np.array_equal(a[a_at[i] : a_at[i] + lens[i]], b[b_at[i] : b_at[i] + lens[i]])
    return out
