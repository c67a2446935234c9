"""Words of many texts as 64-bit hashes, by array operations on the texts' bytes inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into arrays at once; a longer text is one such part by itself.
PART_BYTES = 1 << 19
#: Rows of a batch that are looked at together.
BATCH_DOCS = 1024

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: One random number per byte, the same for A-Z and a-z.
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
MUL = np.uint64(_BASE)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a hash depends on every bit of `x`."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """The first powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS


def _hash_words(data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, given as their bytes one after the other and the end of each text, and each text's words."""
    word = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[stops] = edge[0] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    hashes = mixed(((sums[end] - sums[begin]) * inverse[begin]) ^ (end - begin).astype(np.uint64) * MUL)
    return hashes, np.diff(np.searchsorted(begin, stops), prepend=0)


def parts(column: pa.Array, valid: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A string column in parts of texts: their bytes one after the other, and the end of each text; nulls are empty texts. If asked for,
    bytes that form no character are replaced by U+FFFD."""
    column = (pc.fill_null(column, "") if column.null_count else column).cast(pa.large_string())
    at = 0
    while at < len(column):
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        upto = min(len(column), at + BATCH_DOCS, max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_BYTES, "right")) - 1))
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[at] : offsets[upto]]
        stops = offsets[at + 1 : upto + 1] - offsets[at]
        if valid:
            try:
                data.tobytes().decode()
            except UnicodeDecodeError:
                texts = [data[a:b].tobytes().decode(errors="replace").encode() for a, b in zip(np.r_[0, stops], stops)]
                data, stops = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(x) for x in texts])
        yield data, stops
        at = upto


def hashed_texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a string column, in parts: (texts in the part, hashes of their words, number of words of each). A-Z count as a-z; nulls have no words."""
    for data, stops in parts(column):
        hashes, sizes = _hash_words(data, stops) if len(data) else (np.empty(0, np.uint64), np.zeros(len(stops), np.int64))
        yield len(stops), hashes, sizes
