"""Exact top-k inner-product search with ball trees, shard by shard.

Rows lie in the ball of their nearest pivot; a large ball is dealt into shards. A query first
searches one shard of the ball that promises most, and the k-th score found there is shared:
the query goes on only to balls whose upper bound reaches it. A task holds one shard's ball
tree and lets its queries stream past in blocks. Each block walks the tree at once: children
are taken in the order of their upper bounds, and a query leaves a branch whose bound is below
the k-th score it already has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import mixed
from termweave.session import durable

LEAF = 64
#: Rows of a shard, of a block of queries and queries that pass one copy of a shard, at most; smaller tables are cut into about `SHARDS` all the same.
SHARD_ROWS, BLOCK_ROWS, PASSING, SHARDS = 32_768, 2_048, 65_536, 24
#: Pivots, a sample by a hash of the id; their number of components is bounded too.
PIVOTS, PIVOT_COMPONENTS = 1_024, 4_000_000
#: Below this, sums of products of whole numbers are exact in doubles.
EXACT = 2.0**53


class BallTree:
    """Balls over the rows of `points`, halved along the line between two far rows until `LEAF` rows are left."""

    def __init__(self, points: np.ndarray):
        self.points, self.nodes = points, []
        self.order = np.arange(len(points))
        if len(points):
            self._build(0, len(points))

    def _build(self, low: int, high: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        own = self.points[self.order[low:high]]
        center = own.mean(axis=0)
        gaps = ((own - center) ** 2).sum(axis=1)
        radius = float(np.sqrt(gaps.max()))
        children = ()
        if high - low > LEAF and radius > 0:
            far = own[gaps.argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            side = own @ (other - far)
            half = (high - low) // 2
            self.order[low:high] = self.order[low:high][np.argpartition(side, half)]
            children = ((low, low + half), (low + half, high))
        self.nodes[at] = [low, high, center, radius, ()]
        if children:
            self.nodes[at][4] = tuple(self._build(a, b) for a, b in children)
        return at


def _whole(vectors: pa.Array, size: int) -> np.ndarray:
    """Vectors of one length as rows of an array."""
    return np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), size)


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole numbers; where doubles could round, by Python's integers."""
    if exact:
        return a @ b.T
    a, b = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b))
    return a @ b.T


class Best:
    """The k best (score, smaller id) of each query so far."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.found: list[list[tuple]] = [[] for _ in range(queries)]
        self.kth = floor.astype(np.float64).copy()

    def add(self, q: int, scores, ids) -> None:
        """Merges candidates that reach the k-th score."""
        self.found[q] = sorted([*self.found[q], *zip((-s for s in scores), ids, strict=True)])[: self.k]
        if len(self.found[q]) == self.k:
            self.kth[q] = max(self.kth[q], float(-self.found[q][-1][0]))


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[int, int, int]]:
    """`(query_id, id, score)` of the best `k` points of each query that reach its `floor`, best first; the query's own id is left out."""
    points = tree.points
    if not len(queries) or not len(points):
        return []
    best = Best(len(queries), k, floor)
    norms = np.sqrt((queries**2).sum(axis=1))
    size = float(norms.max()) * float(np.sqrt((points**2).sum(axis=1)).max())
    exact, slack = size < EXACT, 1e-9 * size + 1e-6

    def bounds(node: int, who: np.ndarray) -> np.ndarray:
        _, _, center, radius, _ = tree.nodes[node]
        return queries[who] @ center + norms[who] * radius + slack

    stack = [(0, np.arange(len(queries)), bounds(0, np.arange(len(queries))))]
    while stack:
        node, who, upper = stack.pop()
        reach = upper >= best.kth[who]
        who = who[reach]
        if not len(who):
            continue
        low, high, _, _, children = tree.nodes[node]
        if children:
            pair = [(c, who, bounds(c, who)) for c in children]
            stack += sorted(pair, key=lambda x: x[2].mean())  # the one with the higher bound is taken first
            continue
        rows = tree.order[low:high]
        scores = _products(queries[who], points[rows], exact)
        good = (scores >= best.kth[who][:, None]) if exact else np.ones(scores.shape, bool)
        good &= ids[rows][None, :] != query_ids[who][:, None]
        for i in np.flatnonzero(good.any(axis=1)):
            hit = np.flatnonzero(good[i])
            if len(hit) > k:  # ties at the border stay
                edge = np.partition(scores[i][hit], -k)[-k]
                hit = hit[scores[i][hit] >= edge]
            best.add(who[i], [int(s) for s in scores[i][hit]], ids[rows[hit]].tolist())
    return [(int(query_ids[q]), i, -s) for q, found in enumerate(best.found) for s, i in found]


FOUND = "query_id long, id long, score long"
CELL = "cell long, size int, asks int, id long, vector array<double>, floor double"


def _searched(k: int):
    """Scores from rows sorted by cell and size, a shard's own rows before the queries that pass it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree, ids = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "size", "asks")], axis=1)
            edges = [0, *(np.flatnonzero(np.diff(keys, axis=0).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                cell, size, asks = keys[a].tolist()
                if (cell, size) != now:
                    now, held, tree = (cell, size), [], None
                if not asks:
                    held.append((batch.column("id").slice(a, b - a).to_numpy(), batch.column("vector").slice(a, b - a)))
                    continue
                if tree is None and held:
                    tree, ids = BallTree(np.concatenate([_whole(v, size) for _, v in held])), np.concatenate([i for i, _ in held])
                    held = []
                for start in range(a, b if tree else a, BLOCK_ROWS):
                    part = batch.slice(start, min(BLOCK_ROWS, b - start))
                    floor = part.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    found = search(tree, ids, _whole(part.column("vector"), size), part.column("id").to_numpy(), k, floor)
                    columns = list(zip(*found, strict=True)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "id", "score"])

    return run


@dataclass
class Balls:
    """Pivots, and for each the size of its vectors, its rows, the largest distance to one of them and the shards it is dealt into.

    The last one has no pivot: rows of sizes that no pivot has.
    """

    pivots: list[np.ndarray]
    rows: np.ndarray
    radius: np.ndarray
    parts: np.ndarray
    slices: np.ndarray

    def of_size(self, size: int) -> np.ndarray:
        return np.array([i for i, p in enumerate(self.pivots) if len(p) == size], np.int64)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ball of each vector, and its distance to the pivot."""
        own = self.of_size(vectors.shape[1])
        if not len(own):
            return np.full(len(vectors), len(self.pivots)), np.full(len(vectors), np.inf)
        pivots = np.stack([self.pivots[i] for i in own])
        at = ((pivots**2).sum(axis=1)[None, :] - 2 * (vectors @ pivots.T)).argmin(axis=1)
        return own[at], np.sqrt(((vectors - pivots[at]) ** 2).sum(axis=1))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Balls that can hold candidates of queries of one size, and the queries' upper bounds there."""
        own = self.of_size(queries.shape[1])
        if not len(own):
            return np.array([len(self.pivots)]), np.full((len(queries), 1), np.inf)
        pivots, norms = np.stack([self.pivots[i] for i in own]), np.sqrt((queries**2).sum(axis=1))[:, None]
        radius = self.radius[own][None, :]
        slack = 1e-9 * norms * (np.sqrt((pivots**2).sum(axis=1))[None, :] + radius) + 1e-6
        return own, queries @ pivots.T + norms * radius + slack

    def cell(self, ball, part, piece) -> np.ndarray:
        """A number for one copy of a shard."""
        first = np.concatenate([[0], np.cumsum(self.parts * self.slices)])
        return first[ball] + part * self.slices[ball] + piece


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A batch's rows by the length of their vectors."""
    sizes = np.asarray(batch.column("vector").value_lengths())
    for size in np.unique(sizes):
        part = batch.take(pa.array(np.flatnonzero(sizes == size)))
        yield part, _whole(part.column("vector"), int(size))


def _dealt(ids: np.ndarray, seed: int) -> np.ndarray:
    return (mixed(ids.view(np.uint64) + np.uint64(seed)) >> np.uint64(8)).astype(np.int64)


def _copies(balls: Balls, part: pa.RecordBatch, row: np.ndarray, ball: np.ndarray, resident: bool, floor: np.ndarray | None = None, skip: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as they go to cells: a shard's row to each copy of the shard, a query to one copy of each shard of the ball but the cell `skip`."""
    ids = part.column("id").to_numpy()
    own, other = (balls.parts, balls.slices) if resident else (balls.slices, balls.parts)
    slot = _dealt(ids, 0 if resident else 1)[row] % own[ball]
    times = other[ball]
    again = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    row, ball, slot = (np.repeat(x, times) for x in (row, ball, slot))
    cell = balls.cell(ball, slot, again) if resident else balls.cell(ball, again, slot)
    if skip is not None:
        stay = cell != skip[row]
        row, cell = row[stay], cell[stay]
    for start in range(0, len(row), BLOCK_ROWS):
        at, to = row[start : start + BLOCK_ROWS], cell[start : start + BLOCK_ROWS]
        floors = pa.nulls(len(at), pa.float64()) if floor is None else pa.array(floor[at])
        vectors = part.column("vector").take(pa.array(at))
        columns = [pa.array(to), vectors.value_lengths(), pa.array(np.full(len(at), 0 if resident else 1, np.int32)), pa.array(ids[at]), vectors, floors]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "size", "asks", "id", "vector", "floor"])


def _placed(balls: Balls):
    """`ball` and `gap`, the distance to its pivot, beside each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, vectors in _by_size(batch):
                ball, gap = balls.nearest(vectors)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vector"), pa.array(ball.astype(np.int64)), pa.array(gap)], names=["id", "vector", "ball", "gap"])

    return run


def _residents(balls: Balls):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _copies(balls, batch, np.arange(batch.num_rows), batch.column("ball").to_numpy(), True)

    return run


def _homes(balls: Balls, k: int):
    """Each query with `home`, the cell of the most promising ball whose shards hold more than `k` rows on average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, queries in _by_size(batch):
                own, upper = balls.bounds(queries)
                good = balls.rows[own] > 2 * k * balls.parts[own]
                upper = np.where(good[None, :] | ~good.any(), upper - np.where(np.isfinite(balls.radius[own]), balls.radius[own], 0)[None, :] * np.sqrt((queries**2).sum(axis=1))[:, None], -np.inf)
                ball, ids = own[upper.argmax(axis=1)], part.column("id").to_numpy()
                cell = balls.cell(ball, _dealt(ids, 2) % balls.parts[ball], _dealt(ids, 1) % balls.slices[ball])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vector"), pa.array(cell)], names=["id", "vector", "home"])

    return run


def _visits(balls: Balls):
    """Queries as they go to the cells, but their homes, that can hold a score at their `floor`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, queries in _by_size(batch):
                floor = part.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                own, upper = balls.bounds(queries)
                row, at = np.nonzero(~(upper < floor[:, None]) & (balls.rows[own] > 0)[None, :])
                yield from _copies(balls, part, row, own[at], False, floor, part.column("home").to_numpy())

    return run


def _counted_visits(balls: Balls, k: int):
    """`(ball, n)`: how many queries of a batch look for a home in a ball, a measure of how they crowd."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(balls.rows), np.int64)
        for batch in batches:
            for _, queries in _by_size(batch):
                own, upper = balls.bounds(queries)
                best = np.partition(upper, -min(k, len(own)), axis=1)[:, -min(k, len(own))]
                total[own] += (upper >= best[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["ball", "n"])

    return run


def deal(held: DataFrame) -> tuple[Balls, DataFrame]:
    """Balls over `held(id, vector)`, and its rows with their `ball` as a durable table."""
    total = held.count()
    sample = [np.array(r.vector, np.float64) for r in held.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(min(PIVOTS, 1 + total // 256)).collect()]
    distinct = list({v.tobytes(): v for v in sample}.values())
    fits = np.cumsum([max(1, len(v)) for v in distinct]) <= PIVOT_COMPONENTS
    pivots = [v for v, fit in zip(distinct, fits, strict=True) if fit]
    zero = np.zeros(len(pivots) + 1)
    balls = Balls(pivots, zero.astype(np.int64), zero, zero.astype(np.int64) + 1, zero.astype(np.int64) + 1)
    placed = durable(held.select("id", "vector").mapInArrow(_placed(balls), "id long, vector array<double>, ball long, gap double"))
    for r in placed.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("gap")).collect():
        balls.rows[r.ball], balls.radius[r.ball] = r.n, r.gap
    shard = max(1, min(SHARD_ROWS, -(-total // SHARDS)))
    balls.parts = np.maximum(1, -(-balls.rows // shard))
    return balls, placed


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "vector", visited: list | None = None) -> DataFrame:
    """`(query_id, rank, id, score)`: for each row of `queries` the `k` rows of `vectors` with the highest inner product.

    Both hold `(key, vector)` of whole numbers as doubles; a row is not its own
    candidate, ties go to the smaller id. Rows with a null key, vector or component, or
    one that is not finite, take no part; a repeated id counts once, with its smallest
    vector; vectors are compared with those of their own length. Other columns are not
    read. A query without candidates, and an empty table, give no rows. Scores beyond
    64 bits raise an error. To `visited` are added the numbers of shards, of queries and
    of visits of queries to shards, if given.
    """
    sound = F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))

    def clean(df: DataFrame) -> DataFrame:
        rows = df.where(sound).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("id IS NOT NULL")
        return durable(rows.groupBy("id").agg(F.min("vector").alias("vector")))

    held, asked = clean(vectors), clean(queries)
    balls, placed = deal(held)
    crowds = asked.mapInArrow(_counted_visits(balls, k), "ball long, n long").groupBy("ball").agg(F.sum("n").alias("n"))
    passes = 0
    for r in crowds.collect():
        balls.slices[r.ball] = max(1, -(-r.n // PASSING))
        passes += r.n * int(balls.parts[r.ball])
    cells = int((balls.parts * balls.slices)[balls.rows > 0].sum())
    # Small cells share a task.
    tasks = max(SHARDS, -(-int((balls.rows * balls.slices).sum()) // SHARD_ROWS), -(-passes // PASSING))
    residents = placed.select("id", "vector", "ball").mapInArrow(_residents(balls), CELL)

    def run(passing: DataFrame) -> DataFrame:
        met = residents.unionByName(passing).repartition(max(1, min(cells, tasks, 20_000)), "cell")
        return met.sortWithinPartitions("cell", "size", "asks").mapInArrow(_searched(k), FOUND)

    asked = asked.select("id", "vector").mapInArrow(_homes(balls, k), "id long, vector array<double>, home long")
    at_home = asked.select(F.col("home").alias("cell"), F.size("vector").alias("size"), F.lit(1).alias("asks"), "id", "vector", F.lit(None).cast("double").alias("floor"))
    home = durable(run(at_home))
    floors = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") >= k)
    asked = asked.join(floors.select(F.col("query_id").alias("id"), "floor"), "id", "left")
    passing = asked.select("id", "vector", "home", "floor").mapInArrow(_visits(balls), CELL)
    if visited is not None:
        visited += [cells, asked.count(), passing.count() + asked.count()]
    # At most k rows of a query from each shard: one small group per query.
    best = home.unionByName(run(passing)).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "row")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("row.id").alias("id"), (-F.col("row.s")).alias("score"))
