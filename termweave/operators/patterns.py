"""Leftmost-longest scan of texts for many substrings at once.

Hashes of all windows of a text follow from two running sums, so a whole block of
texts is searched per pattern length with array arithmetic. A window that has the hash
of a pattern is compared with it byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators import scan
from termweave.operators.membership import KeyFilter, mixed

# A regular expression tries its alternatives one after the other, the index all at once.
MAX_ALTERNATIVES = 64
# What the index may take, sent to every task: the patterns and a hash of 4 bytes for each.
MAX_INDEX_BYTES = 160 * 1024 * 1024
HASH_BYTES = 4
# Texts are searched in blocks of about this size; a longer text is a block of its own.
BLOCK_BYTES = 1024 * 1024
COMPARED_BYTES = 16 * 1024 * 1024

POWERS = 21  # one table of powers, 16 MB, serves all blocks but those of longer texts
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
FILTER_BITS = 20


def _quoted(pattern: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in pattern)


def _alternation(words: Sequence[str]) -> str:
    """A regular expression that finds what the alternatives, longest first, find: equal beginnings are tried once, longer ends before shorter ones."""
    ends: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        if word:
            ends.setdefault(word[0], []).append(word[1:])
    parts = []
    for first, rest in ends.items():
        if len(rest) == 1:
            parts.append(_quoted(first + rest[0]))
        else:
            parts.append(_quoted(first) + f"(?:{_alternation(rest)})" + ("?" if "" in rest else ""))
    return "|".join(parts)


@lru_cache(maxsize=2)
def _powers(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Windows:
    """Hashes of any windows of a byte array."""

    def __init__(self, data: np.ndarray, letters: np.ndarray):
        size = 1 << max(POWERS, len(data).bit_length())
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[data] * _powers(BASE, size)[: len(data)], dtype=np.uint64)])
        self.back = _powers(pow(BASE, -1, 1 << 64), size)

    def hashes(self, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.back[at]


LETTERS = np.random.default_rng(0).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


class PatternIndex:
    """Per pattern length the sorted window hashes and, in their order, the patterns' bytes. Built only from patterns whose size was checked."""

    def __init__(self, patterns: pa.Array):
        n = len(patterns)
        ends = np.frombuffer(patterns.buffers()[1], np.int32)[patterns.offset : patterns.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        starts, sizes = ends[:-1], np.diff(ends)
        self.by_length: list[tuple[int, np.ndarray, np.ndarray]] = []
        if not n:
            return
        data = np.frombuffer(patterns.buffers()[2], np.uint8)
        lengths = np.unique(sizes)
        self.shortest = min(8, int(lengths[0]))
        # For each beginning, a bit for each length of the patterns that have it; the last bit stands for all further lengths.
        self.filter, hashes = np.zeros(1 << FILTER_BITS, np.uint64), np.empty(n, np.uint32)
        edges = np.append(np.flatnonzero(np.diff(starts // BLOCK_BYTES, prepend=-1)), n).tolist()
        for a, b in zip(edges, edges[1:]):
            windows, at = Windows(data[starts[a] : ends[b]], LETTERS), starts[a:b] - starts[a]
            hashes[a:b] = _short(windows.hashes(at, sizes[a:b]))
            bit = np.minimum(np.searchsorted(lengths, sizes[a:b]), 63).astype(np.uint64)
            np.bitwise_or.at(self.filter, windows.hashes(at, self.shortest) >> np.uint64(64 - FILTER_BITS), np.uint64(1) << bit)
        order = np.lexsort((hashes, sizes))
        for length, own in zip(lengths.tolist(), np.split(order, np.searchsorted(sizes[order], lengths[1:]))):
            told = np.empty((len(own), length), np.uint8)
            step = max(1, BLOCK_BYTES // length)
            for i in range(0, len(own), step):
                told[i : i + step] = data[starts[own[i : i + step], None] + np.arange(length)]
            self.by_length.append((length, hashes[own], told))

    def _equal(self, data: np.ndarray, at: np.ndarray, told: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Whether the windows at `at` are the patterns, compared in pieces of bounded size."""
        length = told.shape[1]
        step = max(1, COMPARED_BYTES // length)
        offsets = np.arange(length)
        pieces = [(data[at[i : i + step, None] + offsets] == told[slot[i : i + step]]).all(axis=1) for i in range(0, len(at), step)]
        return np.concatenate(pieces) if pieces else np.zeros(0, bool)

    def longest(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ascending positions at which a pattern starts and the length of the longest one there; texts end at `bounds`."""
        empty = np.zeros(0, np.int64)
        if not self.by_length or len(data) < self.shortest:
            return empty, empty
        windows = Windows(data, LETTERS)
        every = np.arange(len(data) - self.shortest + 1)
        held = self.filter[windows.hashes(every, self.shortest) >> np.uint64(64 - FILTER_BITS)]
        at = np.flatnonzero(held)
        held = held[at]
        room = bounds[np.searchsorted(bounds, at, side="right")] - at
        best = np.zeros(len(at), np.int64)
        for i, (length, hashes, told) in enumerate(self.by_length):
            fits = np.flatnonzero((room >= length) & (held & np.uint64(1 << min(i, 63)) != 0))
            wanted = _short(windows.hashes(at[fits], length))
            slot = np.searchsorted(hashes, wanted)
            while len(fits):  # patterns that share a hash follow each other
                likely = hashes[np.minimum(slot, len(hashes) - 1)] == wanted
                likely &= slot < len(hashes)
                fits, slot, wanted = fits[likely], slot[likely], wanted[likely]
                equal = self._equal(data, at[fits], told, slot)
                best[fits[equal]] = length
                fits, slot, wanted = fits[~equal], slot[~equal] + 1, wanted[~equal]
        found = best > 0
        return at[found], best[found]

    def search(self, texts: pa.Array) -> pa.Array:
        """Per text the longest pattern at every start outside an earlier hit; the texts are one block."""
        data, sizes = _block(texts)
        bounds = np.cumsum(sizes)
        at, length = self.longest(data, bounds)
        free = scan.visited(at, length)
        at, length = at[free], length[free]
        row = np.searchsorted(bounds, at, side="right")
        columns = [
            pa.array((at - (bounds - sizes)[row]).astype(np.int32)),
            pa.array(length.astype(np.int32)),
            _cut(data, at, length),
            pa.nulls(len(at), pa.int64()),
            pa.nulls(len(at), pa.float64()),
        ]
        offsets = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names=scan.HIT_COLUMNS))


def _block(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, one behind the other, and their sizes; a null text has none."""
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join(t.as_buffer() for t in texts), np.uint8), sizes


def _cut(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> pa.Array:
    """The windows of a byte array as texts."""
    ends = np.cumsum(length)
    inside = np.repeat(at - (ends - length), length) + np.arange(length.sum())
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data[inside]))


def substring_hits(
    docs: DataFrame,
    key: str,
    text: str,
    patterns: DataFrame,
    pattern: str = "keyword",
    max_alternatives: int = MAX_ALTERNATIVES,
    max_bytes: int = MAX_INDEX_BYTES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """`(key, *keep, hits array<string>)`: at every free position the longest pattern wins.

    Few patterns become one alternation, longest first, evaluated natively. More are
    searched by their window hashes, sent to every task. Patterns that exceed the checked
    size stay distributed: a compact filter of them is sent, and windows that pass it are
    joined with the patterns. All ways give the same result. Null texts have no hit; every
    row of `docs` gives one row, whatever its key.
    """
    distinct = patterns.select(F.col(pattern).alias("pattern")).where(F.length(pattern) > 0).distinct()
    size = distinct.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0)).alias("bytes")
    ).first()
    empty = F.array().cast("array<string>")
    if size["n"] == 0:
        return docs.select(key, *keep, empty.alias("hits"))
    if size["n"] <= max_alternatives:
        words = [r["pattern"] for r in distinct.orderBy(F.desc(F.length("pattern")), "pattern").collect()]
        found = F.regexp_extract_all(F.col(text), F.lit(f"({_alternation(words)})"), F.lit(1))
        return docs.select(key, *keep, F.coalesce(found, empty).alias("hits"))

    # Under names of their own, as a kept column may be the text or be called like it.
    kept = {name: f"_kept_{i}" for i, name in enumerate([key, *keep])}
    rows = docs.select(*[F.col(c).alias(own) for c, own in kept.items()], F.col(text).alias("text"))
    if size["bytes"] + size["n"] * HASH_BYTES <= max_bytes:
        found = _searched(rows, distinct)
    else:
        found = _filtered(rows, distinct, size["n"])
    return found.select(*[F.col(own).alias(c) for c, own in kept.items()], F.col("hits.phrase").alias("hits"))


def _window_keys(hashes: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    return mixed(hashes + np.asarray(length, np.uint64) * np.uint64(BASE))


def _pattern_keys(batch: pa.RecordBatch) -> np.ndarray:
    encoded = [p.encode() for p in batch.column("pattern").to_pylist()]
    sizes = np.array([len(p) for p in encoded], np.int64)
    data = np.frombuffer(b"".join(encoded), np.uint8)
    return _window_keys(Windows(data, LETTERS).hashes(np.cumsum(sizes) - sizes, sizes), sizes) if len(sizes) else np.empty(0, np.uint64)


def _filtered(rows: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    """`rows` with the list `hits` in place of `text`, for patterns that stay distributed.

    One pass over the texts tests the windows of every pattern length against a compact
    filter of the patterns. Equal windows of a part of a batch that pass are one row, with
    their places, and are joined with the patterns, which decides; the hits of a part's
    texts are chosen where its rows meet again.
    """
    shared = rows.sparkSession.sparkContext.broadcast(KeyFilter.of(patterns, _pattern_keys, n))
    # One row per pattern length.
    lengths = sorted(r["n"] for r in patterns.select(F.octet_length("pattern").alias("n")).distinct().collect())
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in scan.parts(batch, sizes, BLOCK_BYTES):
                data, own = _block(part.column("text"))
                bounds = np.cumsum(own)
                opens = np.append((data & 0xC0) != 0x80, True)  # where characters start and texts end
                found: dict[int, list[np.ndarray]] = {length: [] for length in lengths}
                for first in range(0, len(data), BLOCK_BYTES):  # blocks of a long text overlap by the longest pattern
                    block = data[first : first + BLOCK_BYTES + lengths[-1]]
                    windows = Windows(block, LETTERS)
                    for length in lengths:
                        every = np.arange(max(0, min(BLOCK_BYTES, len(block) - length + 1)))
                        at = every[shared.value.may_hold(_window_keys(windows.hashes(every, length), length))] + first
                        at = at[opens[at] & opens[at + length]]
                        found[length].append(at[bounds[np.searchsorted(bounds, at, side="right")] - at >= length])
                runs = []
                for length, at in ((length, np.concatenate(at)) for length, at in found.items() if at):
                    if len(at):
                        cut = _cut(data, at, np.full(len(at), length, np.int64)).dictionary_encode()
                        runs.append((length, cut.dictionary, at, cut.indices.to_numpy(zero_copy_only=False)))
                yield scan.part_rows(part, kept, bounds - own, runs)

    columns = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    candidates = numbered.mapInArrow(run, scan.PART_ROWS.format(columns))
    none = F.lit(None)
    table = patterns.select(F.col("pattern").alias("prefix"), F.octet_length("pattern").alias("depth"), F.lit(True).alias("is_terminal"), none.cast("long").alias("value"), none.cast("double").alias("weight"))
    return scan.joined(candidates, rows.drop("text"), table, "greedy", False)


def _searched(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """`rows` with the list `hits` in place of `text`."""
    index = PatternIndex(patterns.select("pattern").toArrow()["pattern"].combine_chunks().cast(pa.string()))
    shared = rows.sparkSession.sparkContext.broadcast(index)
    kept = rows.drop("text")
    names = kept.columns

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            # A block's hits leave before the next one is searched.
            for part in scan.parts(batch, sizes, BLOCK_BYTES):
                columns = [part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, shared.value.search(part.column("text"))], names=[*names, "hits"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return rows.mapInArrow(search, ", ".join([*fields, f"hits array<{scan.HIT}>"]))
