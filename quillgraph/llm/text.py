"""Vectorised reading of words from Arrow text columns, shared by the operators here."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes with A-Z in lower case; other bytes, also those of UTF-8 sequences, as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text in lower case.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, ascending; by sorting, which is far quicker than numpy's own hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for n places at least."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        size = max(n, _CHUNK)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and where each text begins, with the end last."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[places[0] : places[-1]], places - places[0]


class Words:
    """The words of a column of texts in order: hashes, byte spans, and first[i]:first[i+1] for text i."""

    def __init__(self, column: pa.Array, letters: np.ndarray = SPACED):
        self.data, self.places = buffers(column)
        data, places = self.data, self.places
        inside = letters[LOWER[data]] if len(data) else np.zeros(0, bool)
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        edge = places[:-1][places[:-1] < len(data)]
        before[edge] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        edge = places[1:][places[1:] > 0] - 1
        after[edge] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, places)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """A 64-bit hash of each word in lower case, the same wherever the word stands."""
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):
            low = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, low + _CHUNK, "right")))
            x = _BYTE[LOWER[self.data[low : self.end[j - 1]]]]
            power, inverse = _power(len(x))
            x *= power[: len(x)]
            total = np.cumsum(x)
            s, e = self.start[i:j] - low, self.end[i:j] - low
            out[i:j] = mix((total[e - 1] - total[s] + x[s]) * inverse[s] + (e - s).astype(np.uint64))
            i = j
        return out


def pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ordered pair."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + ((right << np.uint64(31)) | (right >> np.uint64(33))) * np.uint64(0xA0761D6478BD642F))


def slices(batches, rows: int = 1024, size: int = 8 << 20):
    """The batches in pieces of whole rows, none above both bounds unless one text is: memory follows the piece."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))])
        i = 0
        while i < batch.num_rows:
            j = min(i + rows, max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1))
            yield batch.slice(i, j - i)
            i = j
