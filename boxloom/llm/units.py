"""Texts cut into units on whole Arrow buffers, and a bounded table of what is
known of each distinct unit.

White-space pieces of ASCII and Latin-1 letters, digits and punctuation fall into
units by byte class: runs of letters, single digits, runs of other signs.  Any
other piece (apostrophes, other scripts, control characters, marked strings) is
one unit.  Each distinct unit is learnt once and remembered under its bytes, never
under a hash.
"""

from __future__ import annotations

import numpy as np

#: Units a table takes before it starts anew: at most about 80 MB a worker.
MAX_UNITS = 1 << 20
#: Units of more bytes than a table's key are remembered in a dict of this size.
SHORT = 16
MAX_LONG = 50_000
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)



def byte_classes() -> bytes:
    """Class of each byte; the lead byte of Latin-1 letters is seen to later."""
    out = bytearray([ODD] * 256)
    for b in range(33, 127):
        out[b] = DIGIT if chr(b).isdigit() else LETTER if chr(b).isalpha() else OTHER
    out[ord("'")] = ODD
    for b in (*range(9, 14), 32):
        out[b] = SPACE
    return bytes(out)


CLASSES = byte_classes()
LATIN = 0xC3  # lead byte of U+00C0 to U+00FF
SIGNS = (0x97, 0xB7)  # after it: the two that aren't letters


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indexes start, start + 1, ... of runs of these sizes."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def units(raw: np.ndarray, at: np.ndarray, marks: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, stop, whole) of the texts that start and end at `at`: the
    bytes lower-cased but in whole pieces, the units, and which units are pieces
    for the library to split.  Pieces that hold one of the marks are whole."""
    data = raw.tobytes()
    low = np.frombuffer(bytearray(data.lower()), np.uint8)
    kind = np.frombuffer(bytearray(data.translate(CLASSES)), np.uint8)
    n = len(low)
    lead = np.flatnonzero(low == LATIN)
    if len(lead):
        tail = low[lead + 1]
        letter = (tail != SIGNS[0]) & (tail != SIGNS[1])
        kind[lead[letter]] = kind[lead[letter] + 1] = LETTER
        low[lead + 1] = np.where((tail <= 0x9E) & letter, tail + 0x20, tail)
    for mark in marks:
        i = data.find(mark)
        while i >= 0:
            kind[i] = ODD
            i = data.find(mark, i + 1)

    fresh = np.ones(n + 1, bool)  # where a byte and the one before it differ in class, or in text
    fresh[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    fresh[at] = True
    start = np.flatnonzero(fresh[:n] & (kind != SPACE))
    first = np.ones(len(start), bool)  # of its piece
    first[:] = (start == 0) | (kind[start - 1] == SPACE)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first |= edge[start]
    bounds = np.flatnonzero(fresh)
    stop = bounds[np.searchsorted(bounds, start, "right")] if len(start) else start

    odd = np.flatnonzero(kind == ODD)
    whole = np.zeros(len(start), bool)
    if len(odd):
        head = np.flatnonzero(first)
        piece = np.cumsum(first) - 1
        bad = np.zeros(len(head), bool)
        bad[piece[np.searchsorted(start, odd, "right") - 1]] = True
        tail_at = np.append(head[1:], len(start)) - 1
        stop[head[bad]] = stop[tail_at[bad]]
        whole[head[bad]] = True
        keep = first | ~bad[piece]
        start, stop, whole = start[keep], stop[keep], whole[keep]
        back = spread(start[whole], (stop - start)[whole])
        low[back] = raw[back]
    return low, start, stop, whole


class Known:
    """Numbers of byte strings of at most SHORT bytes, kept as two integers each
    (open addressing, many looked up at once)."""

    def __init__(self, bits: int = 21) -> None:
        self.bits, self.size = bits, 0
        self.one, self.two = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.number = np.full(1 << bits, -1, np.int32)

    def slot(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        h = (one ^ (two * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The numbers; -1 where there is none."""
        at = self.slot(one, two)
        out = self.number[at]
        todo = np.flatnonzero((out >= 0) & ((self.one[at] != one) | (self.two[at] != two)))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.number) - 1)
            got = self.number[at]
            out[todo] = got
            go = (got >= 0) & ((self.one[at] != one[todo]) | (self.two[at] != two[todo]))
            todo, at = todo[go], at[go]
        return out

    def add(self, one: np.ndarray, two: np.ndarray, number: np.ndarray) -> None:
        """New, distinct strings."""
        self.size += len(one)
        at = self.slot(one, two)
        todo = np.arange(len(one))
        while len(todo):
            free = self.number[at] < 0
            self.number[at[free]] = number[todo[free]]  # of several for one place, one wins
            won = free & (self.number[at] == number[todo])
            self.one[at[won]], self.two[at[won]] = one[todo[won]], two[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & (len(self.number) - 1)


class UnitTable:
    """What is kept of each distinct unit; a subclass says what that is."""

    marks: tuple[bytes, ...] = ()

    def __init__(self, most: int = MAX_UNITS) -> None:
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known = Known()
        self.long: dict[bytes, int] = {}
        self.n_units = 0

    def learn(self, low: np.ndarray, start: np.ndarray, size: np.ndarray, whole: np.ndarray) -> None:
        """Appends what is kept of new units, in order, under the next numbers."""
        raise NotImplementedError

    def numbers(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each unit, and the index of each text's first unit."""
        if self.n_units + len(self.long) > self.most:
            self.forget()
        low, start, stop, whole = units(raw, at, self.marks)
        size = stop - start
        padded = np.concatenate([low, np.zeros(SHORT, np.uint8)])
        eight = np.ndarray(len(low) + SHORT - 7, "<u8", padded.data, strides=(1,))
        keep = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        one = eight[start] & keep[np.minimum(size, 8)]
        two = np.zeros(len(start), np.uint64)
        more = np.flatnonzero(size > 8)
        two[more] = eight[start[more] + 8] & keep[np.minimum(size[more] - 8, 8)]

        apart = size > SHORT  # and units with a zero byte, whose integers would be those of another string
        zero = np.flatnonzero(low == 0)
        if len(zero):
            apart[np.searchsorted(start, zero, "right") - 1] = True
        out = self.known.find(one, two)
        out[apart] = -2
        missing = np.flatnonzero(out == -1)
        if len(missing):
            order = missing[np.lexsort((two[missing], one[missing]))]
            new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
            heads = order[new]
            number = np.arange(self.n_units, self.n_units + len(heads), dtype=np.int32)
            while 2 * (self.known.size + len(heads)) > len(self.known.number):
                self.known = self.grown()
            self.known.add(one[heads], two[heads], number)
            self.learn(padded, start[heads], size[heads], whole[heads])
            self.n_units += len(heads)
            out[order] = number[np.cumsum(new) - 1]
        for i in np.flatnonzero(apart).tolist():
            key = low[start[i] : stop[i]].tobytes()
            got = self.long.get(key)
            if got is None:
                got = self.n_units
                self.learn(padded, start[i : i + 1], size[i : i + 1], whole[i : i + 1])
                self.n_units += 1
                if len(self.long) < MAX_LONG:
                    self.long[key] = got
            out[i] = got
        return out, np.searchsorted(start, at)

    def grown(self) -> Known:
        """A table of twice the size: one slice of texts may hold that many units."""
        old, out = self.known, Known(self.known.bits + 1)
        full = np.flatnonzero(old.number >= 0)
        out.add(old.one[full], old.two[full], old.number[full])
        return out
