"""Word hashes of a batch of texts, computed on the batch's bytes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed together up to so many bytes; a longer text is hashed by itself.
TOGETHER = 1 << 18
_R = np.uint64(0x9E3779B97F4A7C15)
#: The low n bytes of a 64-bit word.
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit words in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd factors, one for each place in a run of up to 32 words.
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * j + 3, 1 << 64) | 1 for j in range(32)], np.uint64)


def text_groups(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of runs of rows with up to TOGETHER bytes; null texts are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + TOGETHER, "right")) - 1)
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def word_hashes(offsets: np.ndarray, data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, text number, start and end (in data) of every word; a word is a run without white space. lower folds A-Z."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    solid = (data != 0x20) & (data - np.uint8(9) > 4)
    bounds = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    first[bounds] = solid[bounds]
    last[:-1] &= ~solid[1:]
    last[bounds - 1] = solid[bounds - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    folded = data + ((data - np.uint8(0x41) < 26).view(np.uint8) << 5) if lower else data
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([folded, np.zeros(8, np.uint8)]), strides=(1,))
    left = ends - starts
    hashes, at, some = left.astype(np.uint64) * _R, starts, slice(None)
    while len(left):
        hashes[some] = mix(hashes[some] ^ (eights[at] & _MASKS[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        some = more if isinstance(some, slice) else some[more]
        at, left = at[more] + 8, left[more] - 8
    return hashes, np.searchsorted(offsets, starts, "right") - 1, starts, ends


def runs_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of size neighbours."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += hashes[j : j + n] * _FACTORS[j]
    return mix(out)
