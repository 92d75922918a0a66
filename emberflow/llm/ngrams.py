"""Elias-Fano n-gram trie of one shard: contexts, pointers and successors as monotone sequences in one mapped file.

Level 1 holds the context ids. Pointers say where each context's successors begin. Level 2 holds the successors;
within a context they rise, and adding the last value of the context before makes the whole level monotone. A
successor is looked up relative to its context: base(context) + id, by a search for the next value not below it.
Probabilities are 8-bit codes into a codebook of at most 255 values, rounded down.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_U = np.uint64
#: Values between two samples of a sequence, and those decoded at once.
SAMPLE = 1 << 12


class EliasFano:
    """n rising values below u: low bits packed, high bits unary, with the place of every SAMPLE-th one."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.places = n, low_bits, low, high, places

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, _U)
        n = len(values)
        u = int(values[-1]) + 1 if n else 1
        bits = max(0, (u // max(1, n)).bit_length() - 1)
        lows = []
        for i in range(0, n if bits else 0, SAMPLE):
            v = values[i : i + SAMPLE]
            lows.append(np.packbits(((v[:, None] >> np.arange(bits, dtype=_U)) & _U(1)).astype(np.uint8).ravel()))
        ones = (values >> _U(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, bool)
        high[ones] = True
        return EliasFano(n, bits, np.concatenate(lows) if lows else np.zeros(0, np.uint8), np.packbits(high), np.append(ones[::SAMPLE], len(high)))

    def decode(self, sample: int) -> np.ndarray:
        """The values from sample * SAMPLE on, SAMPLE of them at most."""
        first = sample * SAMPLE
        n = min(SAMPLE, self.n - first)
        a, b = int(self.places[sample]), int(self.places[sample + 1])
        ones = np.flatnonzero(np.unpackbits(self.high[a // 8 : -(-b // 8)])[a % 8 :])[:n] + a
        out = (ones - first - np.arange(n)).astype(_U) << _U(self.low_bits)
        if self.low_bits:
            step = SAMPLE * self.low_bits // 8
            raw = np.unpackbits(self.low[sample * step : sample * step + -(-n * self.low_bits // 8)])[: n * self.low_bits].reshape(n, -1)
            for k in range(self.low_bits):
                out |= raw[:, k].astype(_U) << _U(k)
        return out

    def values(self) -> np.ndarray:
        return np.concatenate([self.decode(i) for i in range(-(-self.n // SAMPLE))] or [np.zeros(0, _U)])

    def successors(self, q: np.ndarray) -> np.ndarray:
        """For rising q, where the value equal to each is, or -1: blocks are decoded once, in order."""
        out = np.full(len(q), -1, np.int64)
        at = 0
        for i in range(-(-self.n // SAMPLE)):
            if at >= len(q):
                break
            v = self.decode(i)
            end = int(np.searchsorted(q, v[-1], "right"))
            if end > at:
                k = np.searchsorted(v, q[at:end])
                hit = v[k] == q[at:end]
                out[at:end][hit] = k[hit] + i * SAMPLE
                at = end
        return out

    @property
    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.places]


class Trie:
    """Contexts with their successors and coded probabilities, over a file that is mapped and already unlinked."""

    def __init__(self, contexts: np.ndarray, pointers: np.ndarray, successors: np.ndarray, logs: np.ndarray):
        """contexts rise; pointers has one more entry; successors rise within a context; logs: log10 of each."""
        lens = np.diff(pointers)
        last = np.where(lens > 0, successors[np.maximum(pointers[1:] - 1, 0)], 0) if len(successors) else np.zeros(len(lens), _U)
        # base(context): the sum of the last successors before it, plus one each so that ranges don't touch.
        base = np.concatenate([[0], np.cumsum(last.astype(_U) + _U(1), dtype=_U)[:-1]]) if len(lens) else np.zeros(0)
        level = successors.astype(_U) + np.repeat(base.astype(_U), lens)
        # Half the cuts follow the bigrams, half lie evenly, so that rare large values are told apart too.
        cuts = np.unique(np.concatenate([np.quantile(logs, np.linspace(0, 1, 128), method="lower"), np.linspace(logs.min(), logs.max(), 127)])) if len(logs) else np.zeros(1)
        codes = np.searchsorted(cuts, logs, "right").astype(np.uint8)
        #: Code 0 means absent; code c stands for the largest cut not above the value.
        self.book = np.concatenate([[0.0], 10.0**cuts]).astype(np.float32)
        parts = [EliasFano.build(contexts), EliasFano.build(pointers), EliasFano.build(level), EliasFano.build(base)]
        arrays = [a for p in parts for a in p.arrays] + [codes]
        self._file = tempfile.TemporaryFile()
        spans = []
        for a in arrays:
            self._file.write(b"\0" * (-self._file.tell() % 8))
            spans.append((self._file.tell(), a.dtype, len(a)))
            self._file.write(a.tobytes())
        self._file.write(b"\0" * 8)
        self._file.flush()
        self._map = mmap.mmap(self._file.fileno(), 0, access=mmap.ACCESS_READ)
        view = [np.frombuffer(self._map, t, n, at) for at, t, n in spans]
        for i, p in enumerate(parts):
            p.low, p.high, p.places = view[3 * i : 3 * i + 3]
        self.contexts, self.pointers, self.level, self.base = parts
        self.codes = view[-1]
        self.bytes = self._file.tell()

    def lookup(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Codes of (context, word) pairs in rising order; 0 where the trie has no such pair."""
        out = np.zeros(len(words), np.uint8)
        if not len(words) or not self.contexts.n:
            return out
        ctx, at = np.unique(contexts, return_inverse=True)
        where = self.contexts.successors(ctx)
        base, bounds = self.base.values(), self.pointers.values()
        known = where[at] >= 0
        c = where[at][known]
        q = base[c] + words[known].astype(_U)
        # A word above the context's last successor would fall into the next range.
        top = np.append(base[1:], _U(2**63))[c]
        inside = (q < top) & (bounds[c + 1] > bounds[c])
        hit = np.full(len(q), -1, np.int64)
        hit[inside] = self.level.successors(q[inside])
        out[np.flatnonzero(known)[hit >= 0]] = self.codes[hit[hit >= 0]]
        return out
