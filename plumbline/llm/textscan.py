"""Words and shingles of whole Arrow batches as 64-bit hashes, without a Python object per word.

A batch of texts is one byte buffer. Words are hashed eight bytes at a time, all words of a batch together:
each step scrambles what is hashed so far with the next eight bytes, so that no simple change of a word undoes another. Hashes
of arbitrary spans, which need not tell all texts apart, come from one running polynomial sum over the buffer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes scanned at once: bounds the working memory of a task (about 40 bytes for each).
SLICE_BYTES = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(salt))


_BYTE = seeds(256, 11)
_BASE = int(seeds(1, 23)[0]) | 1
_powers = np.ones(1, dtype=_U), np.ones(1, dtype=_U)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words divided by white space, and of words made of digits, letters and all beyond ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _powers = made[0], made[1]
    return _powers


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about that many bytes; a longer text is a run by itself."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


@dataclass
class Words:
    """Words of a run of texts: hashes, byte places, and by text the number of its first word."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = kind[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[:1] = False
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1:] = False
    cuts = offsets[1:]
    after[cuts[(cuts > 0) & (cuts <= len(data))] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def running(low: np.ndarray) -> np.ndarray:
    """Sums before each byte, from which span_hashes takes any span."""
    n = len(low)
    total = np.zeros(n + 1, dtype=_U)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[low] * _power(n + 1)[0][:n], out=total[1:])
    return total


def span_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        raw = (total[ends] - total[starts]) * _power(len(total))[1][starts]
        return mix(raw + (ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15))


#: Words of more bytes are hashed one by one.
LONG_WORD = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=_U)
_ROUND = int(seeds(1, 29)[0]) | 1


def _long_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of the bytes, however long the spans."""
    size = ends - starts
    with np.errstate(over="ignore"):
        total = mix(size.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(_ROUND))
        padded = np.concatenate([low, np.zeros(8, dtype=np.uint8)])
        eights = np.ndarray(shape=(len(low) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
        left = np.flatnonzero(size <= LONG_WORD)
        for at in range(0, LONG_WORD, 8):
            left = left[size[left] > at]
            if not len(left):
                break
            part = eights[starts[left] + at] & _MASKS[np.minimum(size[left] - at, 8)]
            total[left] = mix((total[left] ^ part) * _U(_ROUND) + _U(at))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        total[i] = _long_hash(low[starts[i] : ends[i]].tobytes())
    return total


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, low: np.ndarray | None = None) -> Words:
    """Words (runs of bytes of that kind) with A-Z lower-cased."""
    starts, ends = word_bounds(data, offsets, kind)
    hashes = np.empty(len(starts), dtype=_U)
    at = 0
    while at < len(starts):  # in pieces, so that a very long text needs no more working memory
        to = max(int(np.searchsorted(starts, starts[at] + SLICE_BYTES)), at + 1)
        origin = starts[at]
        piece = (data if low is None else low)[origin : ends[to - 1]]
        hashes[at:to] = word_hashes(LOWER[piece] if low is None else piece, starts[at:to] - origin, ends[at:to] - origin)
        at = to
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


_STEP = seeds(64, 37) | _U(1)


def sequence_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of that many consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    with np.errstate(over="ignore"):
        total = np.full(n, _U(width), dtype=_U)
        for k in range(width):
            total += hashes[k : k + n] * _STEP[k]
    return mix(total)


def shingle_sets(found: Words, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes in ascending order; a text of fewer words, but not none, has one."""
    every = sequence_hashes(found.hashes, width)
    first = found.first
    for i in range(len(found)):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            yield np.unique(every[a : b - width + 1])
        elif b > a:
            yield sequence_hashes(found.hashes[a:b], b - a)
        else:
            yield every[:0]
