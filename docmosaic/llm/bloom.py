"""Bloom filters of hashes seen once and seen twice, filled by tasks and merged slice by slice."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docmosaic.llm.common import returning

BITS_PER_KEY = 16
MOST_BITS = 1 << 31
SLICE_BITS = 1 << 20
HASHES = 4


def bits_for(keys: int, most_bits: int = MOST_BITS, per_key: int = BITS_PER_KEY) -> int:
    """A power of two that suits so many keys, within the limit; beyond it more is suspected, nothing is missed."""
    return min(most_bits, max(1 << 13, 1 << (max(1, int(keys)) * per_key - 1).bit_length()))


def _places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        yield (hashes + np.uint64(i) * step) & np.uint64(bits - 1)


def held(filled: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for at in _places(hashes, bits):
        out &= (filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _put(filled: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    for at in _places(hashes, bits):
        np.bitwise_or.at(filled, at >> np.uint64(3), (1 << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))


def _slice(k: int, once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "slice": pa.array([k]), "once": pa.array([zlib.compress(once.tobytes(), 1)], pa.binary()),
        "twice": pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary()),
    })


@returning
def _fill(batches: Iterator[pa.RecordBatch], hashes_of: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for batch in batches:
        hashes, counts = np.unique(hashes_of(batch), return_counts=True)
        _put(twice, hashes[(counts > 1) | held(once, hashes, bits)], bits)
        _put(once, hashes, bits)
    size = min(bits, SLICE_BITS) // 8
    for k in range(len(once) // size):
        if once[k * size : (k + 1) * size].any():
            yield _slice(k, once[k * size : (k + 1) * size], twice[k * size : (k + 1) * size])


@returning
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice, one pair of filters in memory at a time. What two tasks saw once was seen twice."""
    at, once, twice = None, None, None
    for batch in batches:
        for k, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            if k != at:
                if at is not None:
                    yield _slice(at, once, twice)
                at, once, twice = k, a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if at is not None:
        yield _slice(at, once, twice)


def _merged(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], bits: int, wanted: tuple[str, ...]) -> tuple[bytearray, ...]:
    schema = "slice bigint, once binary, twice binary"
    merged = (
        rows.mapInArrow(lambda it: _fill(it, hashes_of, bits), schema)
        .repartition("slice").sortWithinPartitions("slice").mapInArrow(_merge, schema)
    )
    size = min(bits, SLICE_BITS) // 8
    out = tuple(bytearray(bits // 8) for _ in wanted)
    for row in merged.select("slice", *wanted).toLocalIterator():
        for filled, name in zip(out, wanted):
            filled[row["slice"] * size : (row["slice"] + 1) * size] = zlib.decompress(row[name])
    return out


def twice_seen(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> bytes:
    """The filter of hashes that ``rows`` have twice or more: at most ``bits / 8`` bytes, whatever the input."""
    return bytes(_merged(rows, hashes_of, bits, ("twice",))[0])


def seen(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> tuple[bytearray, bytearray]:
    """The filters of hashes that ``rows`` have at all, and twice or more: at most ``bits / 4`` bytes together."""
    return _merged(rows, hashes_of, bits, ("once", "twice"))
