"""Words of texts as 64-bit hashes, vectorised over a buffer of many texts (numpy)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: The characters [\x20\x09-\x0D] between words.
BLANKS = b" \t\n\x0b\x0c\r"
#: Also between words where punctuation does not count.
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())

BUFFER = 1 << 20  # bytes of text handled at a time (a longer text is one buffer)
_R = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser over uint64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """A random number a byte; A-Z have those of a-z."""
    t = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    t[65:91] = t[97:123]
    return t


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i for i < n, modulo 2**64 (kept for the largest n so far)."""
    if not _powers or len(_powers[0]) < n:
        most = max(n, BUFFER + 4096)
        up, down = np.full(most, _R, np.uint64), np.full(most, pow(_R, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0][:n], _powers[1][:n]


@lru_cache(maxsize=4)
def _is_word(blanks: bytes) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(blanks)] = False
    return t


class Words:
    """The words of some texts: ``start`` and ``end`` in the joined buffer, ``first[i]:first[i+1]``
    those of text i.  ``hashes()`` of whole words, ``hashes(k)`` of their first k bytes."""

    def __init__(self, texts: list[bytes], blanks: bytes = BLANKS):
        buf = b" ".join(texts) + b" "
        self.raw = np.frombuffer(buf, np.uint8)
        inside = _is_word(blanks)[self.raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]
        borders = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, borders)
        self._sums = None

    def _prefix(self) -> np.ndarray:
        if self._sums is None:
            up, _ = _power(len(self.raw) + 1)
            sums = np.empty(len(self.raw) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_letters()[self.raw] * up[:-1], out=sums[1:])
            self._sums = sums
        return self._sums

    def hashes(self, most: int | None = None) -> np.ndarray:
        sums = self._prefix()
        end = self.end if most is None else np.minimum(self.end, self.start + most)
        _, down = _power(len(self.raw) + 1)
        return mix((sums[end] - sums[self.start]) * down[self.start] + (end - self.start).astype(np.uint64))


def buffers(texts: list[bytes], size: int = BUFFER) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) in runs of about ``size`` bytes."""
    at, run, held = 0, [], 0
    for i, t in enumerate(texts):
        run.append(t)
        held += len(t)
        if held >= size:
            yield at, run
            at, run, held = i + 1, [], 0
    if run:
        yield at, run
