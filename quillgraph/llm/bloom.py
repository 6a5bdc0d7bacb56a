"""Bloom filters in segments: built by segment on the executors, of a size with a fixed bound, broadcast as one array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillgraph.llm.text import mix

SEGMENT_BITS = 1 << 19
#: 2**29 bits are 64 MB; a filter with more keys than fit answers yes more often, never no wrongly.
MAX_BITS = 1 << 29
PROBES = 6


def places(keys: np.ndarray, segments: int, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each key, and a row of bit places within it."""
    h = mix(keys.astype(np.uint64, copy=False) + np.uint64(0x51ED270B27B4F3CF))
    segment = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    g = mix(h)
    step = (g >> np.uint64(32)) | np.uint64(1)
    bit = (g[:, None] + step[:, None] * np.arange(probes, dtype=np.uint64)) % np.uint64(SEGMENT_BITS)
    return segment.astype(np.int64), bit.astype(np.int64)


class Bloom:
    def __init__(self, bits: np.ndarray, segments: int, probes: int):
        self.bits, self.segments, self.probes = bits, segments, probes

    def __contains__(self, key: int) -> bool:
        return bool(self.holds(np.array([key], np.int64))[0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be held; keys that were put in always are."""
        segment, bit = places(keys.view(np.uint64) if keys.dtype == np.int64 else keys, self.segments, self.probes)
        at = segment[:, None] * SEGMENT_BITS + bit
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def build(keys: DataFrame, column: str, count: int, bits_per_key: int = 16, max_bits: int = MAX_BITS, probes: int = PROBES) -> Bloom:
    """A filter that holds all values (long, not null) of ``column``; ``count`` sizes it."""
    segments = max(1, min(max_bits, bits_per_key * count) // SEGMENT_BITS)

    def locate(batches):
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            segment, _ = places(k.view(np.uint64), segments, probes)
            yield pa.RecordBatch.from_arrays([pa.array(segment), batch.column(0)], ["s", "k"])

    def fill(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            segment = batch.column(0).to_numpy(zero_copy_only=False)
            _, bit = places(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), segments, probes)
            for s in np.unique(segment).tolist():
                at = bit[segment == s].ravel()
                bits = held.setdefault(s, np.zeros(SEGMENT_BITS >> 3, np.uint8))
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for s, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["s", "bits"])

    rows = keys.selectExpr(f"CAST({column} AS BIGINT) AS k").mapInArrow(locate, "s long, k long")
    bits = np.zeros(segments * (SEGMENT_BITS >> 3), np.uint8)
    for row in rows.repartition("s").mapInArrow(fill, "s long, bits binary").collect():  # at most max_bits in all
        bits[row.s * (SEGMENT_BITS >> 3) : (row.s + 1) * (SEGMENT_BITS >> 3)] = np.frombuffer(row.bits, np.uint8)
    return Bloom(bits, segments, probes)
