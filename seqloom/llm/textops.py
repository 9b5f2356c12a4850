"""Words, hashes and shingles of many texts at once, on the bytes of an Arrow column.

Nothing here makes a Python object per word. A text column is cut into slices of
bounded size (one text is never cut), and each slice is two arrays: the UTF-8
bytes of all its texts and where each text starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
#: A slice has fewer than 2 ** TEXT_BITS texts, so a text's number fits into so many bits.
TEXT_BITS = 16

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_MASK = (1 << 64) - 1


@dataclass
class Texts:
    """Texts ``first`` to ``first + n`` of a column; null counts as empty."""

    first: int
    data: np.ndarray  # uint8
    starts: np.ndarray  # int64, n + 1 of them

    def __len__(self) -> int:
        return len(self.starts) - 1


@dataclass
class Words:
    """Words in order; those of text i are ``of[i]`` to ``of[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    of: np.ndarray

    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


def slices(column: pa.Array | pa.ChunkedArray, max_bytes: int = SLICE_BYTES) -> Iterator[Texts]:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    first = 0
    for chunk in chunks:
        chunk = chunk.cast(pa.large_string()).fill_null("")
        if not len(chunk):
            continue
        _, offsets, data = chunk.buffers()
        starts = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        i = 0
        while i < len(chunk):
            j = int(np.searchsorted(starts, starts[i] + max_bytes, "right")) - 1
            j = min(max(j, i + 1), i + (1 << TEXT_BITS) - 1, len(chunk))
            yield Texts(first + i, whole[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            i = j
        first += len(chunk)


def blocks(texts: Texts, rows: int) -> Iterator[Texts]:
    """The texts again, so many at a time."""
    for i in range(0, len(texts), rows):
        starts = texts.starts[i : i + rows + 1]
        yield Texts(texts.first + i, texts.data[starts[0] : starts[-1]], starts - starts[0])


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


#: Bytes of words between white space: all but space and \t to \r.
NOT_SPACE = ~_table(b" \t\n\x0b\x0c\r")
#: Letters, digits and everything beyond ASCII.
WORD_BYTE = _table(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123))) | (
    np.arange(256) >= 128
)
#: ASCII capitals to small letters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(texts: Texts, kind: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of the bytes marked in ``kind``, none across two texts."""
    inside = kind[texts.data]
    edge = texts.starts[:-1][np.diff(texts.starts) > 0]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[edge] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[texts.starts[1:][np.diff(texts.starts) > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, texts.starts))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    return _powers_of(size)


@lru_cache(maxsize=2)
def _powers_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _MULTIPLIER, np.uint64)
    down = np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """64-bit hashes of any byte ranges of a slice, from one running sum."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values()[data] * up[: len(data)], out=self._sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sum[end] - self._sum[start]) * self._down[start]
        return mix(raw + (end - start).astype(np.uint64))


def shingles(hashes: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words, and the text of each.

    A text with fewer words, but at least one, has one shingle of all of them.
    """
    n = np.diff(of)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), count)
    within = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = of[:-1][text] + within
    last = of[1:][text]
    out = np.zeros(len(text), np.uint64)
    for k in range(width):
        at = first + k
        there = at < last
        piece = np.zeros(len(text), np.uint64)
        piece[there] = hashes[at[there]]
        out = out * np.uint64(_MULTIPLIER) + piece
    return mix(out), text


def char_offsets(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points before each byte position of one text."""
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return heads[at]
