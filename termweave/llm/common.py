"""Helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Rows of an Arrow batch are taken in slices of about so many bytes of text.
SLICE_BYTES = 2_000_000


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, as UTF-8: `bytes` methods look at ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words. A memory of bounded size: when full it is emptied, which costs time only."""

    def __init__(self, size: int = 200_000):
        super().__init__()
        self.size = size

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.size:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for every run of `size` words; for fewer words one hash of the whole sequence, for none nothing."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = mixed(out + MIX1) ^ hashes[i : n - size + 1 + i]
    return mixed(out)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """`batch` in runs of rows whose `column` holds about `limit` bytes (one row at least)."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    group = (np.cumsum(lengths) - lengths) // limit
    edges = [*np.flatnonzero(np.diff(group, prepend=-1)), len(group)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def give_back() -> None:
    """Returns memory that Arrow keeps after a batch; workers live on after a task, and their memory counts with the executor's."""
    pa.default_memory_pool().release_unused()


def map_texts(df: DataFrame, text: str, function: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """`df` with the columns that `function` makes from each run of rows; `schema` names them. `text` must be a string or binary column.

    A column of `df` that has one of the new names is replaced.
    """
    new = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = [f for f in df.schema.fields if f.name not in new.names]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                made = function(part)
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [made[n] for n in new.names], names=[*names, *new.names])
            give_back()

    return df.mapInArrow(run, T.StructType([*kept, *new.fields]))


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a column; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def as_long(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark's signed long."""
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


def list_of(values: np.ndarray, lengths) -> pa.Array:
    """A list column from its values one after another and the lengths of the lists."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def same_text(column: str):
    """What tells rows with one key apart by their text."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))
