"""An FM-index over integer symbols: wavelet-matrix ranks, backward search, sampled suffix positions.

All searches work on many patterns at once with NumPy.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of a non-empty text of symbols from 0 whose last is unique and smallest, by prefix doubling."""
    n, rank, width = len(text), text.astype(np.int32), 1
    base = max(n, int(text.max())) + 1
    while True:
        key = rank.astype(np.int64)
        key *= base
        key[: max(0, n - width)] += rank[width:]
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order[0]] = 0
        rank[order[1:]] = np.cumsum(key[1:] != key[:-1], dtype=np.int32)
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class Wavelet:
    """rank(symbol, i): how often a symbol is among the first i; access(i). A level is its bits, 64 to a word, and the ones before each word."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        now = values.astype(np.int32)
        for level in range(self.bits - 1, -1, -1):
            one = (now >> level) & 1 == 1
            words = np.zeros(len(now) // 64 + 1, "<u8")
            packed = np.packbits(one, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            self.levels.append((words, np.concatenate([[0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)])))
            self.zeros.append(len(now) - int(np.count_nonzero(one)))
            now = np.concatenate([now[~one], now[one]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        at = i >> 6
        return before[at] + np.bitwise_count(words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Minus the rank at 0, which is where the symbol's run begins on the last level."""
        low, high = np.zeros_like(i), i
        for level, bits, zeros in zip(range(self.bits - 1, -1, -1), self.levels, self.zeros):
            one = (symbol >> level) & 1 == 1
            ones = self._ones(*bits, low)
            low = np.where(one, zeros + ones, low - ones)
            ones = self._ones(*bits, high)
            high = np.where(one, zeros + ones, high - ones)
        return high - low

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and its rank at i."""
        symbol, low = np.zeros_like(i), np.zeros_like(i)
        for level, bits, zeros in zip(range(self.bits - 1, -1, -1), self.levels, self.zeros):
            one = (bits[0][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            symbol = symbol | (one.astype(np.int64) << level)
            ones = self._ones(*bits, low)
            low = np.where(one, zeros + ones, low - ones)
            ones = self._ones(*bits, i)
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i - low


class FMIndex:
    """Of symbols 1 .. symbols - 1; 0 ends the text and is added here. Every ``sample``-th text position is kept."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 8):
        text = np.append(text.astype(np.int32), np.int32(0))
        order = suffix_array(text)
        last = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.wavelet, self.n = Wavelet(last, symbols), len(text)
        self.marked = order % sample == 0
        self.place = np.cumsum(self.marked, dtype=np.int32) - 1
        self.samples = order[self.marked]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of the rows of ``patterns``: their suffix ranges, empty where a pattern is absent."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for symbol in patterns.T[::-1]:
            s = symbol[live]
            low[live] = self.before[s] + self.wavelet.rank(s, low[live])
            high[live] = self.before[s] + self.wavelet.rank(s, high[live])
            live = live[high[live] > low[live]]
            if not len(live):
                break
        found = np.zeros(len(patterns), bool)
        found[live] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, walking back to the nearest kept position."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.marked[rows[open_]]
            at = open_[done]
            out[at] = self.samples[self.place[rows[at]]] + steps
            open_ = open_[~done]
            symbol, rank = self.wavelet.access_rank(rows[open_])
            rows[open_] = self.before[symbol] + rank
            steps += 1
        return out
