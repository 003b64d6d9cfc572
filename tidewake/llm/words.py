"""Words of many texts at once, as numpy arrays over the bytes of an Arrow string column.

UTF-8 keeps ASCII bytes apart from all others, so word classes that treat every non-ASCII character alike can be
decided byte by byte. A word's hash sums a mix of each of its 8-byte blocks with the block's place, a sequence's a mix of
each word with its place: no arrangement of a few letters or words cancels out, as it would in a polynomial modulo 2^64.
Two different words, or sequences, collide with odds of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled in one go; a single longer text is handled alone.
SLICE_BYTES = 4 << 20

_B = np.arange(256)
#: `[^\x20\x09-\x0D]`: everything that isn't ASCII white space.
NOT_SPACE = ~((_B == 0x20) | ((_B >= 0x09) & (_B <= 0x0D)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` of a lower-cased text: digits, a-z and everything beyond ASCII.
ALNUM = ((_B >= 0x30) & (_B <= 0x39)) | ((_B >= 0x61) & (_B <= 0x7A)) | (_B >= 0x80)
LOWER = np.where((_B >= 0x41) & (_B <= 0x5A), _B + 32, _B).astype(np.uint8)

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: By the number of bytes of a block that belong to a word: the bits to keep.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a few texts: of text i those from first[i] to first[i + 1]."""

    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # of each text in data
    starts: np.ndarray  # byte range of each word
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def sliced(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes of text, or of one longer text."""
    _, offsets = column_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = end


def find_words(column: pa.Array, kind: np.ndarray = NOT_SPACE, lower: bool = True, hashed: bool = True) -> Words:
    """Split each text of the column into maximal runs of the bytes of a kind."""
    data, offsets = column_bytes(column)
    if lower:
        data = LOWER[data]
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    words = Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))
    if hashed:
        words.hashes = span_hashes(data, starts, ends)
    return words


def spread(values: np.ndarray, firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of a mix of value and place, for ranges of values that lie one after another (lengths may be 0)."""
    out = np.zeros(len(firsts), np.uint64)
    some = lengths > 0
    if some.any():
        place = (np.arange(len(values)) - np.repeat(firsts, lengths)).astype(np.uint64)
        out[some] = np.add.reduceat(mix(mix(values) + (place + np.uint64(1)) * _GOLD), firsts[some])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range; another seed gives an independent one."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))  # the 8 bytes from each place on
    size = ends - starts
    n = (size + 7) >> 3
    if n.max() <= 1:
        total = mix(mix((blocks[starts] & _KEEP[size]) ^ np.uint64(seed)) + _GOLD) * (n > 0)
    else:
        first = np.cumsum(n) - n
        at = 8 * (np.arange(first[-1] + n[-1]) - np.repeat(first, n))
        own = blocks[np.repeat(starts, n) + at] & _KEEP[np.minimum(np.repeat(size, n) - at, 8)]
        total = spread(own ^ np.uint64(seed), first, n)
    return mix(total + size.astype(np.uint64))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k neighbouring words; those that cross texts are the caller's to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    keys = mix(np.arange(1, 2 * k + 1).astype(np.uint64) * _GOLD)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += (hashes[j : j + n] ^ keys[j]) * (keys[k + j] | np.uint64(1))
    return mix(total)


def sequence_hash(hashes: np.ndarray) -> int:
    """A hash of a whole sequence of words, its order and length."""
    return int(sequence_hashes(hashes, np.array([0, len(hashes)]))[0])


def sequence_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of the words from each bound to the next."""
    n = np.diff(first)
    return mix(spread(hashes, first[:-1], n) + n.astype(np.uint64) * _GOLD)


def text_grams(words: Words, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its word hashes and the sorted distinct hashes of its k-grams; a shorter text is one gram."""
    grams = gram_hashes(words.hashes, k)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        own = words.hashes[a:b]
        if b - a >= k:
            yield own, np.unique(grams[a : b - k + 1])
        elif b > a:
            yield own, gram_hashes(own, b - a)
        else:
            yield own, np.zeros(0, np.uint64)


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return np.ascontiguousarray(values, np.uint64).view(np.int64)
