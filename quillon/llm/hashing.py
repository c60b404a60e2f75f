"""Vectorised hashing of words and shingles: whole batches of texts as flat numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = bytes([0x20, *range(0x09, 0x0E)])
PUNCTUATION = bytes(x for x in range(0x21, 0x7F) if not chr(x).isalnum())
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _geometric(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, U(base), dtype=U)
            x[0] = 1
            out.append(np.cumprod(x, dtype=U))
        _powers[size] = (out[0], out[1])
    return _powers[size]


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
    for x in range(ord("A"), ord("Z") + 1):  # A-Z count as a-z
        values[x] = values[x + 32]
    return values


VALUES = _byte_values()


class Words:
    """The words of a batch: byte buffer, start and end of each word, first word of each text."""

    def __init__(self, texts: list[bytes], separators: bytes = SPACE):
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        joined = b" ".join(texts) + b" "
        self.buffer = np.frombuffer(joined, dtype=np.uint8)
        inside = np.ones(256, dtype=bool)
        inside[list(separators)] = False
        inside[0x20] = False
        word = inside[self.buffer]
        step = np.diff(word.view(np.int8), prepend=np.int8(0))
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        self.text_start = np.concatenate(([0], np.cumsum(sizes)))
        self.offsets = np.searchsorted(self.start, self.text_start)
        up, down = _geometric(len(self.buffer))
        self._sums = np.zeros(len(self.buffer) + 1, dtype=U)
        np.cumsum(VALUES[self.buffer] * up[: len(self.buffer)], out=self._sums[1:])
        self._down = down

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges, alike wherever in the batch they stand."""
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(U))

    def hashes(self) -> np.ndarray:
        return self.span(self.start, self.end)


_WEIGHTS = mix(np.arange(101, 133, dtype=U)) | U(1)


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words; a text of 1 to k-1 words has its whole sequence as one, an empty text none."""
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_offsets = np.concatenate(([0], np.cumsum(count)))
    total = int(out_offsets[-1])
    m = max(0, len(words) - k + 1)
    runs = np.zeros(m, dtype=U)
    for i in range(k):
        runs += words[i : i + m] * _WEIGHTS[i]
    at = np.repeat(offsets[:-1] - out_offsets[:-1], count) + np.arange(total)
    full = np.repeat(n >= k, count)
    out = np.zeros(total, dtype=U)
    out[full] = runs[at[full]]
    for d in np.flatnonzero((n > 0) & (n < k)):
        a = offsets[d]
        out[out_offsets[d]] = np.append(words[a : a + n[d]] * _WEIGHTS[: n[d]], U(int(n[d]) * int(_WEIGHTS[31]) % (1 << 64))).sum(dtype=U)
    return mix(out), out_offsets


def chunks(texts: Iterable[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 texts) in runs of about limit bytes; a longer text makes a run of its own."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if run and size + len(b) > limit:
            yield first, run
            first, run, size = i, [], 0
        run.append(b)
        size += len(b) + 1
    if run:
        yield first, run
