"""Words of many texts at once, straight from Arrow's buffers: places, hashes and shingles.

A word is a run of bytes without ASCII white space; its hash is a polynomial over 64 random-looking
values per byte, of a piece of text at a time, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from kestrel.llm.common import mix, shingle_hashes

#: Bytes to a piece; a word of that length or more is hashed on its own.  Bytes of text that are looked at together.
PIECE, TOGETHER = 1 << 17, 1 << 20
BASE = 0x9E3779B97F4A7C15
_POWER = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE, BASE, np.uint64)]), dtype=np.uint64)
_INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE, pow(BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)


def _values(lower: bool) -> np.ndarray:
    """A 64-bit value for each byte; 0 for white space."""
    v = mix(np.arange(1, 257, dtype=np.uint64))
    if lower:
        v[ord("A") : ord("Z") + 1] = v[ord("a") : ord("z") + 1]
    v[[32, *range(9, 14)]] = 0
    return v


_LOWER, _EXACT = _values(True), _values(False)


def together(texts: pa.Array, most: int = TOGETHER) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of parts of an array of strings with about so many bytes each; a longer text is a part of its own."""
    sizes = np.diff(_offsets(texts))
    first = held = 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield first, texts.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < len(texts):
        yield first, texts.slice(first)


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)


class Words:
    """The words of an array of strings without nulls.

    data: all bytes; texts: where each text starts, and the end; starts, ends: of the words, in
    bytes; hashes: of the words (ASCII letters alike in either case, if lower); bounds: number of
    words before each text, and of all.
    """

    def __init__(self, texts: pa.Array, lower: bool = True):
        offsets = _offsets(texts)
        held = texts.buffers()[2] if len(texts) else None
        self.data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.texts = offsets - offsets[0]
        self.lower = lower
        found = [self._piece(p, q) for p, q in self._pieces()]
        self.starts, self.ends, self.hashes = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, np.uint64)))
        self.bounds = np.searchsorted(self.starts, self.texts)

    def _pieces(self) -> Iterator[tuple[int, int]]:
        """Pieces that cut no word; one that is longer than PIECE is a single word."""
        values, n, p = _EXACT, len(self.data), 0
        while p < n:
            q = min(p + PIECE, n)
            if q < n:
                border = int(self.texts[np.searchsorted(self.texts, q, "right") - 1])
                near = max(p, q - 256)
                blank = np.flatnonzero(values[self.data[near:q]] == 0)
                if not len(blank):
                    near = p
                    blank = np.flatnonzero(values[self.data[p:q]] == 0)
                q = max(border, near + int(blank[-1]) + 1 if len(blank) else 0)
                if q <= p:  # a word without end in sight
                    q = p + PIECE
                    stop = int(self.texts[np.searchsorted(self.texts, p, "right")])
                    while q < stop:
                        blank = np.flatnonzero(values[self.data[q : min(q + PIECE, stop)]] == 0)
                        if len(blank):
                            q += int(blank[0])
                            break
                        q = min(q + PIECE, stop)
            yield p, q
            p = q

    def _piece(self, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if q - p > PIECE or (q - p == PIECE and _EXACT[self.data[p:q]].all()):
            word = self.data[p:q].tobytes()
            h = xxhash.xxh3_64_intdigest(word.lower() if self.lower else word)
            return np.array([p]), np.array([q]), np.array([h], np.uint64)
        v = (_LOWER if self.lower else _EXACT)[self.data[p:q]]
        inside = v != 0
        borders = self.texts[np.searchsorted(self.texts, p, "right") : np.searchsorted(self.texts, q)] - p
        opens, closes = inside.copy(), inside.copy()
        after_blank = ~inside[:-1]
        after_blank[borders - 1] = True
        opens[1:] &= after_blank
        before_blank = ~inside[1:]
        before_blank[borders - 1] = True
        closes[:-1] &= before_blank
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        if not len(starts):
            return starts, ends, np.zeros(0, np.uint64)
        v *= _POWER[: len(v)]
        sums = np.add.reduceat(v, starts) * _INVERSE[starts]
        return starts + p, ends + p, mix(sums + (ends - starts).astype(np.uint64) * np.uint64(BASE))

    def __len__(self) -> int:
        return len(self.hashes)


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k neighbours."""
    n = max(0, len(h) - k + 1)
    out, factor = np.zeros(n, np.uint64), 1
    for j in range(k):
        factor = factor * BASE % (1 << 64)
        out += h[j : n + j] * np.uint64(factor)
    return mix(out + np.uint64(k))


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's runs of k words in order, bounds between texts); all words are one where there are fewer, none without words."""
    sizes = np.diff(bounds)
    per_text = np.where(sizes >= k, sizes - k + 1, sizes > 0)
    stops = np.concatenate([[0], np.cumsum(per_text)])
    every = runs_of(h, k)
    inside = np.ones(len(every), bool)
    over = (bounds[1:-1, None] + np.arange(1 - k, 0)[None, :]).ravel()
    inside[over[(over >= 0) & (over < len(every))]] = False
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    out = np.empty(int(stops[-1]), np.uint64)
    whole = np.ones(len(out), bool)
    whole[stops[short]] = False
    out[whole] = every[inside]
    for i in short.tolist():
        out[stops[i]] = shingle_hashes(h[bounds[i] : bounds[i + 1]], k)[0]
    return out, stops


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct shingles of each text, bounds between texts); ASCII letters in lower case."""
    words = Words(texts)
    values, stops = shingles(words.hashes, words.bounds, k)
    for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[stops[:-1][np.diff(stops) > 0]] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[stops]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] to starts[i] + sizes[i] - 1 of all i, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
