"""Byte-pair vocabularies: pre-tokens, merges by heap and linked list.

The vocabulary file names its own normalizer and pre-tokenizer; this module
knows the word-end kind (NFC, lower case, white space dropped, </w>), and
refuses others.

Texts are cut into units (see units.py), which are pre-tokens already, but for
pieces that the library's own normalizer and pre-tokenizer split, so that its
Unicode tables decide.  Each distinct unit is merged once and remembered.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from boxloom.llm.common import CACHES, slices, text_bytes
from boxloom.llm.units import MAX_UNITS, SHORT, UnitTable


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself,
    the others take code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def heap_merges(symbols: list[int], pairs: dict[tuple[int, int], int], made: list[int]) -> Iterator[tuple[int, int]]:
    """(place, symbol made) of each merge, until no adjacent pair has a rank.

    A doubly linked list joins the places, a heap holds the ranked pairs (lowest
    rank first, then leftmost).  An entry whose pair has changed since is dropped.
    """
    n = len(symbols)
    sym = list(symbols)
    after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
    get = pairs.get
    heap = [r * n + i for i in range(n - 1) if (r := get((sym[i], sym[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = divmod(heapq.heappop(heap), n)
        j = after[i]
        if sym[i] < 0 or j < 0 or get((sym[i], sym[j])) != rank:
            continue
        new = sym[i] = made[rank]
        sym[j] = -1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (r := get((new, sym[k]))) is not None:
                heapq.heappush(heap, r * n + i)
        h = before[i]
        if h >= 0 and (r := get((sym[h], new))) is not None:
            heapq.heappush(heap, r * n + h)
        yield i, new


def merge_count(symbols: list[int], pairs: dict[tuple[int, int], int], made: list[int]) -> int:
    """Tokens of a word: its symbols less the merges."""
    return len(symbols) - sum(1 for _ in heap_merges(symbols, pairs, made))


class WordEnds(UnitTable):
    """One vocabulary file.  A subclass says what is kept of each distinct unit."""

    def __init__(self, path: str, most: int = MAX_UNITS) -> None:
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} is not a word-end vocabulary")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.pairs = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(model["merges"])}
        self.made = [vocab[a + b] for a, b in model["merges"]]
        symbols = byte_symbols()
        self.byte_of = {c: b for b, c in symbols.items()}
        self.inner, self.last = ([vocab[symbols[b] + x] for b in range(256)] for x in ("", end))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(any(c.isspace() for c in t) for t in self.special):
            raise ValueError(f"{path} has added tokens with white space")
        self.marks = tuple({t[:2].encode() for t in self.special})
        library = tokenizers.Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        super().__init__(most)

    def parts(self, piece: str) -> Iterator[int | bytes]:
        """Added tokens' ids and pre-tokens' bytes, by the library."""
        while piece:
            at, token = min(((i, t) for t in self.special if (i := piece.find(t)) >= 0), default=(len(piece), ""))
            for symbols, _ in self.pre_tokenize(self.normalize(piece[:at])):
                yield bytes(self.byte_of[c] for c in symbols)
            if token:
                yield self.special[token]
            piece = piece[at + len(token) :]

    def symbols(self, pre: bytes) -> list[int]:
        return [*(self.inner[b] for b in pre[:-1]), self.last[pre[-1]]]


class Counts(WordEnds):
    """Token counts; no ids are made."""

    def forget(self) -> None:
        super().forget()
        self.count = np.zeros(0, np.int64)
        self.words: dict[bytes, int] = {}

    def of(self, pre: bytes) -> int:
        return merge_count(self.symbols(pre), self.pairs, self.made)

    def learn(self, low: np.ndarray, start: np.ndarray, size: np.ndarray, whole: np.ndarray) -> None:
        data = low.tobytes() if len(start) > 1 else b""
        new = []
        for i, n, w in zip(start.tolist(), size.tolist(), whole.tolist(), strict=True):
            piece = data[i : i + n] if data else low[i : i + n].tobytes()
            new.append(sum(1 if isinstance(p, int) else self.of(p) for p in self.parts(piece.decode())) if w else self.of(piece))
        room = self.n_units + len(new)
        if room > len(self.count):
            self.count = np.concatenate([self.count, np.zeros(max(room, 1024), np.int64)])
        self.count[self.n_units : room] = new

    def count_array(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; 0 of a null one."""
        raw, at = text_bytes(texts)
        out = np.zeros(len(texts), np.int64)
        for lo, hi in slices(at):
            number, first = self.numbers(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            sums = np.concatenate([[0], np.cumsum(self.count[number])])
            out[lo:hi] = sums[first[1:]] - sums[first[:-1]]
        return out


class PairTable:
    """pairs as arrays: open addressing, looked up for many pairs at once."""

    def __init__(self, pairs: dict[tuple[int, int], int], made: list[int]) -> None:
        self.base = 1 + max(max(max(p) for p in pairs), max(made))
        self.bits = 1 + (4 * len(pairs)).bit_length()
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.zeros(1 << self.bits, np.int32)
        for (a, b), r in pairs.items():
            k = a * self.base + b
            at = int(self.slot(np.array([k], np.int64))[0])
            while self.key[at] >= 0:
                at = (at + 1) & (len(self.key) - 1)
            self.key[at], self.rank[at] = k, r
        self.made = np.array(made, np.int64)
        self.none = np.int32(len(made))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; none where it has none or a side is -1."""
        keys = left * self.base + right
        out = np.full(keys.shape, self.none, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        flat, res = keys.ravel(), out.ravel()
        at = self.slot(flat[todo])
        while len(todo):
            found = self.key[at]
            hit = found == flat[todo]
            res[todo[hit]] = self.rank[at[hit]]
            go = ~hit & (found >= 0)
            todo, at = todo[go], (at[go] + 1) & (len(self.key) - 1)
        return res.reshape(keys.shape)

    def merge_all(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges every row of sym (one word a row, all of one length) to the
        end: in each round each word merges its best pair.  Returns the rows,
        padded with -1, and their lengths."""
        n, width = sym.shape
        done, size = np.full((n, width), -1, np.int64), np.full(n, width)
        rows, rank = np.arange(n), self.ranks(sym[:, :-1], sym[:, 1:])
        while width > 1 and len(rows):
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            live = best < self.none
            if not live.all():
                done[rows[~live], : sym.shape[1]] = sym[~live]
                rows, sym, rank, at, best = rows[live], sym[live], rank[live], at[live], best[live]
            if not len(rows):
                return done, size
            size[rows] -= 1
            i = np.arange(len(rows))
            col = np.arange(sym.shape[1])[None, :]
            pad = np.full((len(rows), 1), -1, np.int64)
            sym = np.take_along_axis(np.concatenate([sym, pad], 1), col + (col > at[:, None]), 1)
            sym[i, at] = self.made[best]
            none = np.full((len(rows), 1), self.none, np.int32)
            rank = np.take_along_axis(np.concatenate([rank, none], 1), col[:, :-1] + (col[:, :-1] > at[:, None]), 1)
            after = np.where(at + 1 < sym.shape[1], sym[i, np.minimum(at + 1, sym.shape[1] - 1)], -1)
            has = at < rank.shape[1]
            rank[i[has], at[has]] = self.ranks(sym[i, at], after)[has]
            has = at > 0
            rank[i[has], at[has] - 1] = self.ranks(sym[i[has], at[has] - 1], sym[i[has], at[has]])
        done[rows, : sym.shape[1]] = sym
        return done, size


class Ids(WordEnds):
    """Token ids.  New units of one length are merged together, as rows of arrays."""

    def __init__(self, path: str, most: int = MAX_UNITS) -> None:
        super().__init__(path, most)
        self.table = PairTable(self.pairs, self.made)
        self.np_inner, self.np_last = np.array(self.inner, np.int64), np.array(self.last, np.int64)

    def forget(self) -> None:
        super().forget()
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.first, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _ids_of(self, piece: bytes, whole: bool) -> list[int]:
        out: list[int] = []
        for p in self.parts(piece.decode()) if whole else (piece,):
            if isinstance(p, int):
                out.append(p)
                continue
            sym = self.symbols(p)
            left = dict(enumerate(sym))
            for i, new in heap_merges(sym, self.pairs, self.made):
                left[i] = new
                j = i + 1
                while j not in left:
                    j += 1
                del left[j]
            out += left.values()
        return out

    def learn(self, low: np.ndarray, start: np.ndarray, size: np.ndarray, whole: np.ndarray) -> None:
        n = len(start)
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # which units, how many ids, the ids
        plain = ~whole & (size <= SHORT)
        for width in np.unique(size[plain]).tolist():
            which = np.flatnonzero(plain & (size == width))
            for lo in range(0, len(which), 50_000):
                part = which[lo : lo + 50_000]
                text = low[start[part][:, None] + np.arange(width)[None, :]]
                sym = self.np_inner[text]
                sym[:, -1] = self.np_last[text[:, -1]]
                ids, count = self.table.merge_all(sym)
                got.append((part, count, ids[ids >= 0]))
        for i in np.flatnonzero(~plain).tolist():
            ids = self._ids_of(low[start[i] : start[i] + size[i]].tobytes(), bool(whole[i]))
            got.append((np.array([i]), np.array([len(ids)]), np.array(ids, np.int64)))
        which, count, ids = (np.concatenate(x) for x in zip(*got, strict=True))
        room = self.n_units + n
        if room > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros(room, np.int64)]) for x in (self.first, self.size))
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.n_ids + len(ids), np.uint32)])
        self.first[self.n_units + which] = self.n_ids + np.cumsum(count) - count
        self.size[self.n_units + which] = count
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(lo, hi, ids, offsets) of runs of texts: text lo + i has the ids from
        offsets[i] to offsets[i + 1], the end id last where there is one."""
        raw, at = text_bytes(texts)
        for lo, hi in slices(at):
            number, first = self.numbers(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            count = self.size[number]
            stop = np.cumsum(count)
            before = np.concatenate([[0], stop])[first]
            total = int(before[-1])
            i = np.arange(total)
            ids = self.ids[i + np.repeat(self.first[number] - (stop - count), count)]
            if end_id is not None:
                out = np.full(total + hi - lo, end_id, "<u4")
                out[i + np.repeat(np.arange(hi - lo), np.diff(before))] = ids
                ids, before = out, before + np.arange(hi - lo + 1)
            yield lo, hi, ids.astype("<u4", copy=False), before


def encode_all(ids: Ids, texts: Iterable[str | None]) -> list[list[int]]:
    return [part[a:b].tolist() for _, _, part, at in ids.encode(pa.array(list(texts), pa.string())) for a, b in zip(at[:-1], at[1:], strict=True)]


@functools.cache
def word_counts(path: str) -> Counts:
    return Counts(path)


@functools.cache
def word_ids(path: str) -> Ids:
    return Ids(path)


CACHES += [word_counts.cache_clear, word_ids.cache_clear]
