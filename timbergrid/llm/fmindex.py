"""A weighted FM-index over sequences of integer symbols, in numpy.

The Burrows-Wheeler transform is held in a wavelet matrix: one bit vector for each bit of a symbol, packed into 64-bit
words with a running count for each word, about 1.5 log2(sigma) bits a symbol. Each sequence has a weight (how often
the corpus has it); an interval of the suffix array weighs the sum of its suffixes' sequences. All queries of a batch
step backwards together.

An index's image is one compressed byte string that stands alone: symbol names, bit vectors, and the suffixes' weights
in as few bytes as the largest needs.
"""

from __future__ import annotations

import io

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols (a power of two), by prefix doubling."""
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    n, step = len(text), 1
    order = np.argsort(rank, kind="stable")
    while step < depth:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        if rank[order[-1]] == n - 1:
            break
        step *= 2
    return order


class BitVector:
    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = (np.cumsum(counts) - counts).astype(np.int32)

    @staticmethod
    def of(bits: np.ndarray) -> BitVector:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        return BitVector(words)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, levels: list[tuple[BitVector, int]]) -> None:
        self.levels = levels

    @staticmethod
    def of(symbols: np.ndarray, n_symbols: int) -> WaveletMatrix:
        levels = []
        for level in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> level & 1).astype(bool)
            levels.append((BitVector.of(ones), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        return WaveletMatrix(levels)

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (vector, zeros) in enumerate(self.levels):
            one = (symbol >> (len(self.levels) - 1 - level) & 1).astype(bool)
            ones = vector.rank(at)
            at = np.where(one, zeros + ones, at - ones)
        return at


class FMIndex:
    """Sequences of symbols, each ended by a separator; patterns of up to ``depth`` symbols."""

    def __init__(self, names: np.ndarray, wavelet: WaveletMatrix, shift: np.ndarray, weights: np.ndarray) -> None:
        #: ``shift``: first row of each symbol, less where the wavelet matrix puts the symbol's first occurrence.
        self.names, self.wavelet, self.shift, self.weights = names, wavelet, shift, weights
        self.weight = np.concatenate(([0], np.cumsum(weights, dtype=np.int64)))
        self.size = len(weights)

    @staticmethod
    def built(symbols: np.ndarray, lengths: np.ndarray, weights: np.ndarray, depth: int = 64) -> FMIndex:
        names, coded = np.unique(symbols, return_inverse=True)
        n_symbols = len(names) + 1
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(len(symbols) + len(lengths), dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[ends] = False
        text[inside] = coded + 1
        owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        order = suffix_order(text, depth)
        wavelet = WaveletMatrix.of(text[order - 1], n_symbols)
        counts = np.bincount(text, minlength=n_symbols)
        every = np.arange(n_symbols, dtype=np.int64)
        shift = np.cumsum(counts) - counts - wavelet.descend(every, np.zeros(n_symbols, dtype=np.int64))
        return FMIndex(names, wavelet, shift, weights[owner[order]])

    def image(self) -> bytes:
        import zstandard

        raw = io.BytesIO()
        vectors = np.stack([v.words for v, _ in self.wavelet.levels])
        narrow = self.weights.astype(np.min_scalar_type(int(self.weights.max(initial=0))))
        np.savez(raw, names=self.names, vectors=vectors, zeros=np.array([z for _, z in self.wavelet.levels]), shift=self.shift, weights=narrow)
        return zstandard.ZstdCompressor(level=1).compress(raw.getvalue())

    @staticmethod
    def read(image: bytes) -> FMIndex:
        import zstandard

        part = np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(image)))
        levels = [(BitVector(w), int(z)) for w, z in zip(part["vectors"], part["zeros"], strict=True)]
        return FMIndex(part["names"], WaveletMatrix(levels), part["shift"], part["weights"])

    def code(self, symbols: np.ndarray) -> np.ndarray:
        """The index's own numbers of symbols that it has."""
        return np.searchsorted(self.names, symbols).astype(np.int64) + 1

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the intervals of symbol + pattern."""
        n = len(symbol)
        both = self.wavelet.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.shift[symbol]
        return both[:n] + shift, both[n:] + shift

    def interval_weight(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weight[high] - self.weight[low]


def repeated_windows(index: FMIndex, symbols: np.ndarray, lengths: np.ndarray, window: int, threshold: int = 2) -> np.ndarray:
    """For each streamed sequence (of less than window + 63 symbols that the index has) a 64-bit mask of its window
    starts whose symbols weigh at least ``threshold`` in the index.

    Matching statistics from the right: from an end, extend leftwards while the weight stays at the threshold. A match
    [p, e) of at least ``window`` symbols reports all window starts from p to e - window; the next end is the last one
    that could still have an unreported window: min(e - 1, p + window - 1).
    """
    coded, starts = index.code(symbols), np.cumsum(lengths) - lengths
    masks = np.zeros(len(lengths), dtype=np.uint64)
    live = np.flatnonzero(lengths >= window)
    end = lengths[live].copy()
    at = end.copy()
    low, high = np.zeros(len(live), dtype=np.int64), np.full(len(live), index.size, dtype=np.int64)
    while len(live):
        symbol = coded[starts[live] + at - 1]
        new_low, new_high = index.step(symbol, low, high)
        goes = index.interval_weight(new_low, new_high) >= threshold
        at = np.where(goes, at - 1, at)
        low, high = np.where(goes, new_low, low), np.where(goes, new_high, high)
        stop = ~goes | (at == 0)
        if stop.any():
            i = np.flatnonzero(stop)
            long = end[i] - at[i] >= window
            j = i[long]
            first, last = at[j].astype(np.uint64), (end[j] - window).astype(np.uint64)
            span = (np.uint64(2) << (last - first)) - np.uint64(1)
            masks[live[j]] |= span << first
            end[i] = np.where(at[i] == 0, 0, np.minimum(end[i] - 1, at[i] + window - 1))
            at[i], low[i], high[i] = end[i], 0, index.size
            keep = end >= window
            if not keep.all():
                live, end, at, low, high = live[keep], end[keep], at[keep], low[keep], high[keep]
    return masks
