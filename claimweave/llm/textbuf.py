"""Whole columns of text as byte arrays: words, windows of words and their hashes.

A batch of texts becomes one byte array with a separator between texts, so that
numpy handles all of them at once instead of Python one word at a time.  Hashes
are 64-bit prefix hashes: with ``C`` the running sum of ``table[byte] * B**i``,
any slice's hash is ``(C[end] - C[start]) * B**-start`` modulo 2**64, mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text is still handled whole.
BLOCK = 1 << 20

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  other systems' C libraries lack it
except (AttributeError, OSError):
    _LIBC = None

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_TABLE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def byte_class(inside) -> np.ndarray:
    """A 256-entry boolean table from a predicate on byte values."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Everything but ASCII white space.
NON_SPACE = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: ASCII letters and digits and every byte of a character beyond ASCII.
WORD = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def give_back() -> None:
    """Return freed memory to the system, so that a worker's peaks do not add up over batches and tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def ascii_lower(a: np.ndarray) -> np.ndarray:
    return _LOWER[a]


def texts_of(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null becomes empty."""
    return pc.fill_null(column, "").cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def blocks(texts: list[bytes], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes in all; a longer text stands alone."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes], sep: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, one separator after each; and where each begins (n + 1 entries)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(sep.join(texts) + sep, np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; the last value must be false."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    return edge[::2], edge[1::2]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the odd base and of its inverse modulo 2**64, grown when a longer text needs them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
                a = np.full(size, base & _MASK, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def prefix(a: np.ndarray) -> np.ndarray:
    """The running hash sums of a byte array (n + 1 entries)."""
    out = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_TABLE[a] * _POWERS.to(len(a))[0], out=out[1:])
    return out


def slices(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte slices; equal slices have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _POWERS.to(len(sums))[1][starts])


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each ``width`` neighbouring values (n - width + 1 of them)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out + h[k : k + n]) * np.uint64(_ODD)
    return mix(out)


class Words:
    """The words of a block of texts: where they stand, and which text they belong to."""

    def __init__(self, texts: list[bytes], inside: np.ndarray, lower: bool = True) -> None:
        a, self.base = joined(texts)
        self.bytes = ascii_lower(a) if lower else a
        self.starts, self.ends = runs(inside[a])
        #: first[i] : first[i + 1] are the words of text i.
        self.first = np.searchsorted(self.starts, self.base)
        self.counts = np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The number of its text, for each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return slices(prefix(self.bytes), self.starts, self.ends)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of each run of ``width`` words within one text.

        A text with fewer words gives one shingle, its whole sequence; one
        without words gives none.
        """
        h = self.hashes()
        w = windows(h, width)
        owner = self.text_of()
        whole = owner[: len(w)] == owner[width - 1 :] if len(w) else np.zeros(0, bool)
        out, own = w[whole], owner[: len(w)][whole]
        short = np.flatnonzero((self.counts > 0) & (self.counts < width))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for k in range(width - 1):
                more = self.counts[short] > k
                extra[more] = mix((extra[more] + h[self.first[short][more] + k]) * np.uint64(_ODD))
            out, own = np.concatenate((out, extra)), np.concatenate((own, short))
            order = np.argsort(own, kind="stable")
            out, own = out[order], own[order]
        return out, own

    def sequences(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of each run of ``width`` words, hashed as ``shingles`` hashes a text of so few words."""
        h, owner = self.hashes(), self.text_of()
        n = max(len(h) - width + 1, 0)
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out = mix((out + h[k : k + n]) * np.uint64(_ODD))
        whole = owner[:n] == owner[width - 1 : width - 1 + n]
        return out[whole], owner[:n][whole]
