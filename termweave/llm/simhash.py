"""Near-duplicate grouping by SimHash fingerprints with a generalised pigeonhole search.

The 64 bits are grouped into partitions, correlated bits together, so that the partitions
tell different things. If thresholds t_1..t_m, each at least -1, add up to
distance - m + 1, two fingerprints within the distance differ in at most t_i bits of some
partition i. Every fingerprint gets thresholds of its own: a dynamic program over the
partitions finds those with the least estimated work, from histograms of pieces of the
partitions. It probes the values within t_i of its own in partition i (none for -1), meets
the fingerprints filed there, and the whole fingerprints are compared.

A partition value that very many different fingerprints hold is not compared pair by pair:
its fingerprints are filed again under all points within half the distance. Two
fingerprints within an even distance share such a point, and those that share one are
within the distance, so every such point makes one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import as_long, give_back, list_of, slices, strings, words_of
from termweave.llm.components import connected
from termweave.session import durable, release

BITS = 64
SEED = 42
#: Bits of a histogram; a partition's estimate is made of those of its pieces.
PIECE_BITS = 8
#: What one probe costs, in candidates.
PROBE = 4.0
#: A bucket with more rows is filed again instead of compared pair by pair.
BUCKET_ROWS = 512
#: Shingle hashes that are turned into bits at once.
HASHES = 50_000


def fingerprint(text: str | None, shingle: int) -> int:
    """Majority of the bits of all shingle hashes (XXH64, seed 42), repeats included; zero without words."""
    words = words_of(text)
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total, n = np.zeros(BITS, np.int64), len(words) - size + 1
    for low in range(0, n, HASHES):
        high = min(n, low + HASHES)
        digests = b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[low:high].tolist(), ends[low + size - 1 : high + size - 1].tolist(), strict=True)])
        total += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """`(doc, fp)` for every row; the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.array([fingerprint(t, shingle) for t in strings(part, "text")], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc"), as_long(found)], names=["doc", "fp"])
            give_back()

    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(run, "doc long, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, the lowest first."""
    return np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def co_occurrence(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j set: 64 x 64 counts, added up per task and then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy().view(np.uint64)).astype(np.float64)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], names=["cell", "n"])

    out = np.zeros(BITS * BITS, np.int64)
    for row in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row["cell"]] = row["n"]
    return out.reshape(BITS, BITS)


def grouped_bits(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The 64 bits in `parts` groups of near equal width; each group is grown by the bit that is most correlated with it."""
    mean = counts.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tied = np.abs(counts / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(tied, 0.0)
    free, groups = set(range(BITS)), []
    for left in range(parts, 0, -1):
        width = -(-len(free) // left)
        rest = sorted(free)
        group = [max(rest, key=lambda i: tied[i, rest].sum())]
        free.discard(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda i: tied[i, group].mean())
            group.append(best)
            free.discard(best)
        groups.append(group)
    return groups


def _values(bits: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a group as one number, its first bit lowest."""
    return bits[:, group].astype(np.uint64) @ (np.uint64(1) << np.arange(len(group), dtype=np.uint64))


def _pieces(group: list[int]) -> list[list[int]]:
    return [group[i : i + PIECE_BITS] for i in range(0, len(group), PIECE_BITS)]


def histograms(fps: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """For every piece of every group, how many fingerprints hold each of its values (256 counts at most a piece)."""
    pieces = [p for g in groups for p in _pieces(g)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(pieces), 1 << PIECE_BITS), np.int64)
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy().view(np.uint64))
            for i, piece in enumerate(pieces):
                total[i] += np.bincount(_values(bits, piece).astype(np.int64), minlength=1 << PIECE_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "n"])

    out = np.zeros(len(pieces) << PIECE_BITS, np.int64)
    for row in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row["cell"]] = row["n"]
    return list(out.reshape(len(pieces), -1))


def ball(width: int, radius: int) -> int:
    """Values within `radius` bits of one of `width` bits."""
    return sum(comb(width, k) for k in range(radius + 1))


def masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(width), k)], np.uint64)


def near_shares(counts: np.ndarray, distance: int) -> np.ndarray:
    """For every value of a piece, the share of fingerprints at 0..distance differing bits."""
    values = np.arange(1 << PIECE_BITS, dtype=np.uint64)
    away = np.bitwise_count(values[:, None] ^ values[None, :])
    share = counts / max(1, counts.sum())
    return np.stack([(away == d) @ share for d in range(distance + 1)], axis=1)


def thresholds(bits: np.ndarray, groups: list[list[int]], shares: list[np.ndarray], n: int, distance: int) -> np.ndarray:
    """For each fingerprint and group a threshold from -1 to `distance`, adding up to distance - groups + 1, with the least estimated work."""
    rows, at, costs = len(bits), 0, []
    for group in groups:
        near = np.zeros((rows, distance + 1))
        near[:, 0] = 1.0
        for piece in _pieces(group):
            own = shares[at][_values(bits, piece).astype(np.int64)]
            near = np.stack([sum(near[:, k] * own[:, d - k] for k in range(d + 1)) for d in range(distance + 1)], axis=1)
            at += 1
        probes = np.array([ball(len(group), d) for d in range(distance + 1)])
        costs.append(np.concatenate([np.zeros((rows, 1)), n * np.cumsum(near, axis=1) + PROBE * probes], axis=1))
    # Thresholds plus one: the groups take distance + 1 steps in all.
    steps = distance + 1
    best, taken = np.full((rows, steps + 1), np.inf), []
    best[:, 0] = 0.0
    for cost in costs:
        options = np.stack([np.pad(best[:, : steps + 1 - k], ((0, 0), (k, 0)), constant_values=np.inf) + cost[:, k : k + 1] for k in range(steps + 1)], axis=2)
        taken.append(options.argmin(axis=2))
        best = options.min(axis=2)
    out, left = np.empty((rows, len(groups)), np.int64), np.full(rows, steps)
    for g in range(len(groups) - 1, -1, -1):
        step = taken[g][np.arange(rows), left]
        out[:, g] = step - 1
        left = left - step
    return out


def parts_for(n: int, distance: int) -> int:
    """The number of groups with the least work if the values were spread evenly."""

    def work(parts: int) -> float:
        width = BITS // parts
        cost = [0.0, *(n * ball(width, d) / 2.0**width + PROBE * ball(width, d) for d in range(distance + 1))]
        best = [0.0] + [float("inf")] * (distance + 1)
        for _ in range(parts):
            best = [min(best[s - k] + cost[k] for k in range(s + 1)) for s in range(distance + 2)]
        return best[-1]

    return min(range(2, 2 * distance + 3), key=work)


def _filed(groups: list[list[int]], shares: list[np.ndarray], n: int, distance: int):
    """Rows `(bucket, fp, role)`: 1 filed, 2 probing, 3 both."""
    flips = [[masks(len(g), d)[1:] for d in range(distance + 1)] for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            bits = _bits(fps)
            allowed = thresholds(bits, groups, shares, n, distance)
            for g, group in enumerate(groups):
                value, tag = _values(bits, group), np.uint64(g) << np.uint64(BITS - 8)
                yield _rows(value | tag, fps, np.where(allowed[:, g] >= 0, 3, 1))
                for d in range(1, distance + 1):
                    own = np.flatnonzero(allowed[:, g] == d)
                    if len(own):
                        probed = (value[own, None] ^ flips[g][d][None, :]) | tag
                        yield _rows(probed.ravel(), np.repeat(fps[own], probed.shape[1]), np.full(probed.size, 2))
            give_back()

    return run


def _rows(bucket: np.ndarray, fps: np.ndarray, role: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([as_long(bucket), as_long(fps), pa.array(role, pa.int32())], names=["bucket", "fp", "role"])


def _verified(distance: int):
    """Links within the buckets of a sorted partition, as each one's spanning forest."""

    def forest(fps: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
        probe, filed = (role & 2) > 0, (role & 1) > 0
        near &= (probe[:, None] & filed[None, :]) | (filed[:, None] & probe[None, :])
        label, todo = np.full(len(fps), -1), np.arange(len(fps))
        while len(todo):
            start = front = todo[:1]
            label[start] = start
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & (label < 0))
                label[front] = start[0]
            todo = todo[label[todo] < 0]
        joined = np.flatnonzero(label != np.arange(len(fps)))
        return fps[label[joined]], fps[joined]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            columns = [batch.column(i).to_numpy() for i in range(3)] if batch is not None else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            bucket, fps, role = columns
            edges = np.flatnonzero(np.diff(bucket)) + 1
            last = len(bucket) if batch is None else (edges[-1] if len(edges) else 0)
            left, right = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            cut = [0, *edges[edges < last].tolist(), last]
            for a, b in zip(cut, cut[1:], strict=False):
                if b - a > 1:
                    x, y = forest(fps[a:b].view(np.uint64), role[a:b])
                    left.append(x)
                    right.append(y)
            rest = [c[last:] for c in columns]
            yield pa.RecordBatch.from_arrays([as_long(np.concatenate(left)), as_long(np.concatenate(right))], names=["a", "b"])

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _points(radius: int):
    """`(fp, points)`: all values within `radius` bits."""
    flips = masks(BITS, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                around = part.column(0).to_numpy().view(np.uint64)[:, None] ^ flips[None, :]
                yield pa.RecordBatch.from_arrays([part.column(0), list_of(around.view(np.int64).ravel(), np.full(len(around), len(flips)))], names=["fp", "points"])

    return run


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """`(a, b)` links whose components are those of all pairs of `fps(fp long)`, distinct values, within `distance` bits (an even number)."""
    if distance % 2 or not 0 < distance <= 6:
        raise ValueError("distance must be 2, 4 or 6")
    n = fps.count()
    groups = grouped_bits(co_occurrence(fps), n, parts_for(n, distance))
    shares = [near_shares(counts, distance) for counts in histograms(fps, groups)]
    rows = durable(fps.select("fp").mapInArrow(_filed(groups, shares, n, distance), "bucket long, fp long, role int"))
    sizes = durable(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("role") >= 2).alias("probed")).where("rows > 1 AND probed").select("bucket", "rows"))
    met = rows.join(sizes, "bucket")
    calm = met.where(F.col("rows") <= BUCKET_ROWS).select("bucket", "fp", "role").repartition("bucket").sortWithinPartitions("bucket")
    found = durable(calm.mapInArrow(_verified(distance), "a long, b long"))
    crowded = met.where(F.col("rows") > BUCKET_ROWS).select("fp").distinct()
    around = crowded.mapInArrow(_points(distance // 2), "fp long, points array<long>").select("fp", F.explode("points").alias("point"))
    # A point has at most as many fingerprints as its ball has values.
    near = around.groupBy("point").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    far = durable(near.select("a", F.explode("all").alias("b")).where("a <> b").distinct())
    release(rows, sizes)
    return found.unionByName(far)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = 2) -> DataFrame:
    """`(doc_id, fingerprint, component_id)` for each row of `docs`.

    Words are runs without ASCII white space, A-Z lower-cased; shingles are runs of words,
    repeats included, joined by one space (a shorter text is one shingle). Fingerprints
    link at `distance` or fewer differing bits; `component_id` is the smallest id reachable
    over links, itself included. Null and empty texts have fingerprint zero and are linked
    like any other. Rows that repeat an id count each with their own text. A row with a
    null id links others as any row does; its component is the smallest id reachable, null
    if there is none. An empty table gives no rows; other columns are not read. `key` is a
    whole number.
    """
    base = durable(fingerprints(docs, key, text, shingle))
    own = durable(base.groupBy("fp").agg(F.min("doc").alias("doc")))
    labels = connected(links(own.select("fp"), distance)).toDF("fp", "component")
    placed = durable(own.join(labels, "fp", "left").select("fp", "doc", F.coalesce("component", "fp").alias("component")))
    least = placed.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = durable(placed.join(least, "component").select("fp", "component_id"))
    release(own, placed)
    # The largest side may hold one fingerprint in a third of its rows: a plain join of stored tables, which adaptive execution splits.
    return base.join(named, "fp").select(F.col("doc").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
