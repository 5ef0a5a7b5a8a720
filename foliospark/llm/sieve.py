"""A Bloom filter of fixed size over the keys of a table: what workers may ask before anything is exchanged.

The bits are set on the executors and merged there block by block; the driver
gets 2**BITS bits whatever the table holds.  With more keys than it was made for
it lets more through and never loses any, so it may only stand before an exact
join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: log2 of the bits (16 MB) and of the bits of a block; positions a key sets.
BITS, BLOCK, HASHES = 27, 16, 4


def _places(key: str) -> list[int]:
    h = xxhash.xxh64_intdigest(key.encode("utf-8", "replace"))
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) & (1 << BITS) - 1 for i in range(HASHES)]


def _places_of_hashes(h: np.ndarray) -> np.ndarray:
    """(keys, HASHES) positions of 64-bit hashes."""
    h = h.astype(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * b[:, None]) & np.uint64((1 << BITS) - 1)).astype(np.int64)


class Sieve:
    def __init__(self, blocks: dict[int, bytes]):
        bits = bytearray(1 << BITS - 3)
        for i, b in blocks.items():
            bits[i << BLOCK - 3 : (i + 1) << BLOCK - 3] = b
        self.bits = bytes(bits)

    def __contains__(self, key: str) -> bool:
        bits = self.bits
        return all(bits[p >> 3] >> (p & 7) & 1 for p in _places(key))


    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes may be there."""
        bits = np.frombuffer(self.bits, np.uint8)
        at = _places_of_hashes(hashes)
        return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)


def sieve(keys: DataFrame) -> Sieve:
    """Over the first column of ``keys``, strings or 64-bit hashes; nulls are left out."""
    hashed = keys.schema[0].dataType.typeName() == "long"

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if hashed:
                at = _places_of_hashes(b.column(0).drop_null().to_numpy()).ravel()
            else:
                at = np.array([p for k in b.column(0).to_pylist() if k is not None for p in _places(k)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> BLOCK).astype(np.int32)), pa.array((at & (1 << BLOCK) - 1).astype(np.int32))], names=["block", "at"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(1).to_numpy()
            which = b.column(0).to_numpy()
            for i in np.unique(which):
                if i not in blocks:
                    blocks[i] = np.zeros(1 << BLOCK, np.uint8)
                blocks[i][at[which == i]] = 1
        bits = [np.packbits(x, bitorder="little").tobytes() for x in blocks.values()]
        yield pa.RecordBatch.from_arrays([pa.array([int(i) for i in blocks], pa.int32()), pa.array(bits, pa.binary())], names=["block", "bits"])

    rows = keys.mapInArrow(places, "block int, at int").repartition("block").mapInArrow(merged, "block int, bits binary").collect()  # at most 2**(BITS - BLOCK) blocks
    return Sieve({r.block: bytes(r.bits) for r in rows})
