"""A compact set filter: tells for most keys that they are not in a table too large to be sent to every task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits; a filter takes 16 MB at most, however many keys it holds.
MAX_WORDS = 1 << 21
KEYS_PER_WORD = 6

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def text_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hashes of texts; equal texts are hashed once."""
    encoded = values.dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(x.encode()) for x in encoded.dictionary.to_pylist()], np.uint64)
    return known[encoded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.empty(0, np.uint64)


def _places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key, and the three bits it sets there."""
    spread = mixed(hashes)
    bits = np.zeros(len(hashes), np.uint64)
    for shift in (40, 46, 52):
        bits |= np.uint64(1) << ((spread >> np.uint64(shift)) & np.uint64(63))
    return (spread & np.uint64(words - 1)).astype(np.int64), bits


class KeyFilter:
    """Built by tasks and put together by Spark; only the filter itself, whose size is bounded, comes to the driver."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, table: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], keys: int) -> KeyFilter:
        """A filter of the keys that `hashes` makes of the rows of `table`; `keys` is about their number."""
        size = 1 << max(4, min(MAX_WORDS.bit_length() - 1, (keys // KEYS_PER_WORD).bit_length()))

        def run(batches):
            for batch in batches:
                at, bits = _places(hashes(batch), size)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.view(np.int64))], names=["at", "bits"])

        found = table.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(size, np.uint64)
        words[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return cls(words)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """False where a key is certainly not in the table."""
        at, bits = _places(hashes, len(self.words))
        return (self.words[at] & bits) == bits
