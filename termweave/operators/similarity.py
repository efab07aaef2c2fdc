"""Similarity join of two phrase-vector tables: every pair with cosine above a threshold."""

from __future__ import annotations

import functools
import math
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from termweave.functions.vectors import as_doubles, cosine

MAX_BROADCAST_BYTES = 256 * 1024 * 1024
ROWS_PER_BLOCK = 4096
CORE_PER_BLOCK, EXT_PER_BLOCK = 2048, 1024
PAIRS_AT_ONCE = 16_384
#: Cells that most vectors visit are met together, up to so many residents.
SHARD_ROWS = 20_000
#: Visitors that meet a shard in one run.
SHARD_VISITS = 20_000
#: Looked up at once when visits are counted or dealt.
VISITS_AT_ONCE = 2_000_000
#: Bounds what the pivot tree takes on the driver and in each task.
MAX_PIVOTS = 4096
#: A cell that more vectors visit is met in several runs.
VISITS_PER_RUN = 500_000

PAIR = "core_id string, ext_id string, cos double"
NAMED_PAIR = "core_id string, source string, ext_id string, cos double"


def _unit_rows(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _matrix(lists: pa.Array, rows: int) -> np.ndarray:
    if rows == 0:
        return np.empty((0, 0))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return _unit_rows(_matrix(batch.column("vector"), batch.num_rows))


def _paired(core: pa.Table | pa.RecordBatch, i: np.ndarray, ext: pa.RecordBatch, j: np.ndarray, cos: np.ndarray) -> pa.RecordBatch:
    """Pairs with the columns of core but its vector."""
    own = [c for c in ("id", "source") if c in core.schema.names]
    columns = [core.column(c).take(pa.array(i)) for c in own]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays([*columns, ext.column("id").take(pa.array(j)), pa.array(cos)], names=[*["core_id" if c == "id" else c for c in own], "ext_id", "cos"])


class Screen:
    """One side of a comparison, prepared once for all blocks of the other side.

    Blocks are looked through in single precision, with a margin for its rounding; what may
    be above the threshold is multiplied again in double precision, which decides. The
    dimensions are taken by falling weight: after the leading quarter the rest of a product
    is at most the product of the rests' lengths (Cauchy-Schwarz), and where few pairs of a
    block can still pass, only those are finished. Where that spares nothing it is not tried
    again for some blocks.
    """

    def __init__(self, core: np.ndarray, threshold: float):
        self.core, self.threshold = core, threshold
        self.dim = core.shape[1]
        self.order = np.argsort(-np.einsum("ij,ij->j", core, core), kind="stable")
        self.head = max(1, self.dim // 4)
        self.margin = (self.dim + 8) * 1.2e-7
        self.small = core.astype(np.float32)[:, self.order]
        self.rest = self._rest(self.small)
        self.skip = 0

    def _rest(self, small: np.ndarray) -> np.ndarray:
        return np.sqrt(np.einsum("ij,ij->i", small[:, self.head :], small[:, self.head :]))

    def _likely(self, x: slice, y: np.ndarray, y_rest: np.ndarray) -> np.ndarray:
        """Flat places of a block that may be above the threshold."""
        least = np.float32(self.threshold - 2 * self.margin)
        core = self.small[x]
        if self.skip:
            self.skip -= 1
            return np.flatnonzero(core @ y.T > least)
        part = core[:, : self.head] @ y[:, : self.head].T
        may = np.flatnonzero(part + np.outer(self.rest[x], y_rest) > least)
        if len(may) < part.size // 16:
            return may
        self.skip = 15
        part += core[:, self.head :] @ y[:, self.head :].T
        return np.flatnonzero(part > least)

    def above(self, ext: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places on both sides and cosines of the pairs above the threshold, one bounded block after the other."""
        if not len(self.core) or not len(ext):
            return
        small = ext.astype(np.float32)[:, self.order]
        rest = self._rest(small)
        for start in range(0, len(ext), EXT_PER_BLOCK):
            y = ext[start : start + EXT_PER_BLOCK]
            for left in range(0, len(self.core), CORE_PER_BLOCK):
                x = self.core[left : left + CORE_PER_BLOCK]
                likely = self._likely(slice(left, left + CORE_PER_BLOCK), small[start : start + EXT_PER_BLOCK], rest[start : start + EXT_PER_BLOCK])
                if len(likely) > len(x) * len(y) // 8:
                    cos = (x @ y.T).ravel()[likely]
                else:
                    pieces = [divmod(likely[k : k + PAIRS_AT_ONCE], len(y)) for k in range(0, len(likely), PAIRS_AT_ONCE)]
                    cos = np.concatenate([np.empty(0), *[np.einsum("ij,ij->i", x[i], y[j]) for i, j in pieces]])
                keep = cos > self.threshold
                if keep.any():
                    i, j = divmod(likely[keep], len(y))
                    yield left + i, start + j, cos[keep]


def _pairs_above(core_ids, core: np.ndarray, ext_ids, ext: np.ndarray, threshold: float) -> Iterator[tuple]:
    """Ids and cosines of the pairs above the threshold."""
    for i, j, cos in Screen(core, threshold).above(ext):
        yield core_ids[i], ext_ids[j], cos


def _comparable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has a direction."""
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return vectors.where(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def similar_pairs(
    core: DataFrame,
    ext: DataFrame,
    threshold: float,
    max_bytes: int = MAX_BROADCAST_BYTES,
    rows_per_cell: int = 50_000,
) -> DataFrame:
    """`(core_id, ext_id, cos)` for all pairs with cosine strictly above `threshold`.

    Both inputs are `(id string, vector array<double>)`. When the core matrix is
    small (measured) it is broadcast and the other side streams past it without a
    shuffle. Otherwise both sides are cut into cells that meet by an equi-join.
    Null vectors, vectors with a null or non-finite value, zero vectors and, in `ext`,
    those of another length than core's have no cosine and are in no pair, whichever
    form runs. Core vectors of different lengths raise an error.
    """
    core, ext, size = _measured(core, ext)
    return _pairs(core.select("id", "vector"), ext, threshold, size, max_bytes, rows_per_cell)


def _pairs(core: DataFrame, ext: DataFrame, threshold: float, size: Row, max_bytes: int = MAX_BROADCAST_BYTES, rows_per_cell: int = 50_000) -> DataFrame:
    """The pairs of measured sides; a column `source` of core stays with its rows."""
    if size["n"] * size["dim"] * 8 + size["ids"] <= max_bytes:
        return _broadcast_pairs(core, ext, threshold)
    return _cell_pairs(core, ext, threshold, size["n"], rows_per_cell)


def _measured(core: DataFrame, ext: DataFrame) -> tuple[DataFrame, DataFrame, Row]:
    """The comparable rows of both sides, and what core takes."""
    core, ext = _comparable(core), _comparable(ext)
    own = F.size("vector")
    text = F.coalesce(F.sum(F.octet_length("id")), F.lit(0))
    size = core.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(own), F.lit(0)).alias("dim"), F.coalesce(F.min(own), F.lit(0)).alias("least"), text.alias("ids")).first()
    if size["least"] != size["dim"]:
        raise ValueError(f"core vectors have {size['least']} to {size['dim']} values")
    return core, ext.where(own == size["dim"]), size


def _broadcast_pairs(core: DataFrame, ext: DataFrame, threshold: float) -> DataFrame:
    table = core.toArrow().combine_chunks()
    matrix = _unit_rows(_matrix(table["vector"].combine_chunks(), table.num_rows))
    shared = core.sparkSession.sparkContext.broadcast((table.drop_columns("vector"), matrix))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        screen = Screen(matrix, threshold) if len(matrix) else None
        for batch in batches:
            if screen and batch.num_rows:
                for i, j, cos in screen.above(_vectors(batch)):
                    yield _paired(names, i, batch, j, cos)

    return ext.select("id", "vector").mapInArrow(compare, NAMED_PAIR if "source" in core.columns else PAIR)


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if not len(vectors):
        return np.empty((0, len(pivots)))
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.clip(vectors @ pivots.T, -1.0, 1.0)))


class PivotTree:
    """Two levels of pivots: each leaf pivot hangs on its nearest root, and vectors on the nearest leaf of their nearest root.

    A vector within `reach` of some member of a cell is within the cell's radius plus
    `reach` of its leaf pivot, and the same holds for the root's radius, so whole roots
    are passed over before their leaves are looked at.
    """

    def __init__(self, vectors: np.ndarray):
        roots = max(1, math.isqrt(len(vectors)))
        self.roots, self.leaves = vectors[:roots], vectors
        parent = _distances(vectors, self.roots).argmin(axis=1)
        self.children = [np.flatnonzero(parent == r) for r in range(roots)]
        self.root_of = parent

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each vector, its distance to the cell's pivot and to the root."""
        to_root = _distances(vectors, self.roots)
        nearest = to_root.argmin(axis=1)
        cell, away = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
        for r in np.unique(nearest):
            rows = np.flatnonzero(nearest == r)
            to_leaf = _distances(vectors[rows], self.leaves[self.children[r]])
            best = to_leaf.argmin(axis=1)
            cell[rows], away[rows] = self.children[r][best], to_leaf[np.arange(len(rows)), best]
        return cell, away, to_root[np.arange(len(vectors)), nearest]

    def visits(self, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, root_high: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """`(row, cell)` of every cell that may hold a vector within `reach`; empty cells have a radius below any distance."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        to_root = _distances(vectors, self.roots)
        for r, leaves in enumerate(self.children):
            rows = np.flatnonzero(to_root[:, r] <= root_high[r] + reach)
            if len(rows) and len(leaves):
                to_leaf = _distances(vectors[rows], self.leaves[leaves])
                row, leaf = np.nonzero((to_leaf <= high[leaves] + reach) & (to_leaf >= low[leaves] - reach))
                found.append((rows[row], leaves[leaf]))
        row, cell = (np.concatenate(x) for x in zip(*found, strict=True))
        return row, cell


def _cell_pairs(core: DataFrame, ext: DataFrame, threshold: float, n_core: int, rows_per_cell: int) -> DataFrame:
    """Exact join without a broadcast side.

    Core vectors go to the cell of their nearest pivot; there are as many pivots as
    cells of `rows_per_cell` vectors, up to a bound. Unit vectors with cosine above t are
    closer than sqrt(2 - 2t), so another vector needs to visit only the cells it can
    reach. Cells that over a quarter of the vectors visit spare little: neighbours among
    them are met together as one shard, so that a visitor is sent once per shard, not once
    per cell. Cells and shards are cut by hash into pieces of bounded size, and only where
    very many vectors visit one are its residents repeated, once per run of visitors.
    Residents come first in their sorted partition and are held; visitors stream past
    them batch by batch. Each pair meets exactly once.
    """
    wanted = min(MAX_PIVOTS, max(1, math.ceil(n_core / rows_per_cell)))
    chosen = core.orderBy(F.md5("id")).limit(wanted).select("vector").toArrow()
    if not chosen.num_rows:
        return core.sparkSession.createDataFrame([], NAMED_PAIR if "source" in core.columns else PAIR)
    tree = PivotTree(_unit_rows(_matrix(chosen["vector"].combine_chunks(), chosen.num_rows)))
    cells, roots = len(tree.leaves), len(tree.roots)

    def few(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = max(1, VISITS_AT_ONCE // cells)
        return (batch.slice(i, step) for i in range(0, batch.num_rows, step))

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, root_high, n = np.full(cells, np.inf), np.full(cells, -np.inf), np.full(roots, -np.inf), np.zeros(cells, np.int64)
        for batch in batches:
            if batch.num_rows:
                cell, away, to_root = tree.place(_vectors(batch))
                np.minimum.at(low, cell, away)
                np.maximum.at(high, cell, away)
                np.maximum.at(root_high, tree.root_of[cell], to_root)
                n += np.bincount(cell, minlength=cells)
        own = np.flatnonzero(n)
        columns = [own, low[own], high[own], n[own], root_high[tree.root_of[own]]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "low", "high", "n", "root_high"])

    found = core.select("vector").mapInArrow(radii, "cell long, low double, high double, n long, root_high double")
    low, high, root_high, residents = np.full(cells, np.inf), np.full(cells, -np.inf), np.full(roots, -np.inf), np.zeros(cells, np.int64)
    # At most MAX_PIVOTS rows reach the driver, here and below.
    for r in found.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.max("root_high").alias("root_high")).collect():
        low[r["cell"]], high[r["cell"]], residents[r["cell"]] = r["low"], r["high"], r["n"]
        root_high[tree.root_of[r["cell"]]] = max(root_high[tree.root_of[r["cell"]]], r["root_high"])
    # A margin for rounding keeps the pruning on the safe side.
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-6

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(cells + 1, np.int64)  # at the end, of all vectors
        for batch in batches:
            n[cells] += batch.num_rows
            for part in few(batch):
                n[:cells] += np.bincount(tree.visits(_vectors(part), low, high, root_high, reach)[1], minlength=cells)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own])], names=["cell", "n"])

    visitors = np.zeros(cells + 1, np.int64)
    for r in ext.select("vector").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        visitors[r["cell"]] = r["n"]
    n_ext, visitors = int(visitors[cells]), visitors[:cells]
    shard = _shards(np.lexsort((np.arange(cells), tree.root_of)), residents, visitors * 4 > n_ext)
    shards = int(shard.max()) + 1
    together = np.bincount(shard, minlength=shards) > 1
    residents = np.bincount(shard, residents, shards).astype(np.int64)
    visitors = np.minimum(np.bincount(shard, visitors, shards).astype(np.int64), n_ext)
    pieces = np.maximum(1, -(-residents // np.where(together, max(SHARD_ROWS, rows_per_cell), rows_per_cell)))
    runs = np.maximum(1, -(-visitors // np.where(together, min(SHARD_VISITS, VISITS_PER_RUN), VISITS_PER_RUN)))
    first = np.concatenate([[0], np.cumsum(pieces * runs)])

    def dealt(batch: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, resident: bool) -> Iterator[pa.RecordBatch]:
        """Each row once per run of its shard's visitors (residents), or once per piece of residents (visitors)."""
        row, at = np.divmod(np.unique(row * shards + shard[cell]), shards)
        own, other = (pieces, runs) if resident else (runs, pieces)
        hashed = np.array([zlib.crc32((x or "").encode()) for x in batch.column("id").to_pylist()], np.int64)
        slot = hashed[row] % own[at]
        copies = other[at]
        again = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        row, at, slot = (np.repeat(x, copies) for x in (row, at, slot))
        place = first[at] + (slot * runs[at] + again if resident else again * runs[at] + slot)
        for start in range(0, len(row), ROWS_PER_BLOCK):
            taken = pa.array(row[start : start + ROWS_PER_BLOCK])
            told = [batch.column(c).take(taken) if c in batch.schema.names else pa.nulls(len(taken), pa.string()) for c in carried]
            columns = [pa.array(place[start : start + ROWS_PER_BLOCK]), pa.array(np.full(len(taken), 0 if resident else 1, np.int32)), *told]
            yield pa.RecordBatch.from_arrays(columns, names=["unit", "role", *carried])

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, _, _ = tree.place(_vectors(batch)) if batch.num_rows else (np.empty(0, np.int64),) * 3
            yield from dealt(batch, np.arange(batch.num_rows), cell, True)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in few(batch):
                yield from dealt(part, *tree.visits(_vectors(part), low, high, root_high, reach), False)

    carried = core.columns
    rows = ", ".join(["unit long", "role int", *[f"{c} array<double>" if c == "vector" else f"{c} string" for c in carried]])
    met = core.mapInArrow(stay, rows).unionByName(ext.select("id", "vector").mapInArrow(visit, rows))
    n = max(1, min(int((pieces * runs)[residents > 0].sum()), 20_000))
    ordered = met.repartition(n, "unit") if n < cells else met.repartition("unit")
    return ordered.sortWithinPartitions("unit", "role").mapInArrow(_streamed(threshold), NAMED_PAIR if "source" in carried else PAIR)


def _shards(order: np.ndarray, residents: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    """Shard of each cell: crowded cells follow each other in a shard up to its size, others are one by themselves."""
    shard, n, held = np.zeros(len(order), np.int64), 0, 0
    total = int(residents[crowded].sum())
    size = total / max(1, -(-total // max(1, SHARD_ROWS)))  # all about equal
    for cell in order[crowded[order]].tolist():
        if held and held + residents[cell] / 2 > size:
            n, held = n + 1, 0
        shard[cell] = n
        held += int(residents[cell])
    alone = order[~crowded[order]]
    shard[alone] = np.arange(len(alone)) + (n + 1 if crowded.any() else 0)
    return shard


def _streamed(threshold: float):
    """Pairs above the threshold from rows sorted by unit, residents before visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, names, screen = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("unit").to_numpy() * 2 + batch.column("role").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                unit, role = divmod(int(keys[a]), 2)
                if unit != now:
                    now, held, names, screen = unit, [], None, None
                if role == 0:
                    held.append((part.select([c for c in part.schema.names if c in ("id", "source")]), _vectors(part)))
                elif held:
                    if screen is None:
                        names = pa.Table.from_batches([x for x, _ in held]).combine_chunks()
                        screen = Screen(np.concatenate([x for _, x in held]), threshold)
                    for i, j, cos in screen.above(_vectors(part)):
                        yield _paired(names, i, part, j, cos)

    return run


def pair_cosines(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds `cos` for two vector columns of the same row (plain expressions)."""
    return pairs.withColumn("cos", cosine(as_doubles(a), as_doubles(b)))


def similar_keywords(core: DataFrame, ext: DataFrame, threshold: float, **limits: int) -> DataFrame:
    """`(keyword, source, core_keyword, cos)`: other keywords close to a core keyword.

    `core(keyword, source, embedding)`, `ext(keyword, embedding)`. The found keyword
    is lower-cased before it is compared with its own core keyword. The cosine stays
    in the result, so one join at the lowest threshold serves a whole sweep.
    """
    left = core.select("source", F.col("keyword").alias("id"), as_doubles("embedding").alias("vector"))
    right = ext.select(F.lower("keyword").alias("id"), as_doubles("embedding").alias("vector"))
    left, right, size = _measured(left, right)
    left, right = left.where("id IS NOT NULL"), right.where("id IS NOT NULL")

    def found(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = _pairs(a, b, threshold, size, **limits).select(F.col("ext_id").alias("keyword"), "source", F.col("core_id").alias("core_keyword"), "cos")
        return pairs.where(F.col("keyword") != F.col("core_keyword"))

    # Two rows with names of their own give one pair, which no other meets: it need not be moved.
    twice_left, twice_right = _repeated(left, ["source", "id"]), _repeated(right, ["id"])
    parts, whole = [], right
    if twice_left is not None:
        parts.append(found(_matching(left, twice_left, "left_semi"), right))
        left = _matching(left, twice_left, "left_anti")
    if twice_right is not None:
        parts.append(found(left, _matching(right, twice_right, "left_semi")))
        whole = _matching(right, twice_right, "left_anti")
    once = found(left, whole)
    if not parts:
        return once
    several = functools.reduce(DataFrame.unionByName, parts)
    return once.unionByName(several.groupBy("keyword", "source", "core_keyword").agg(F.max("cos").alias("cos")))


def _repeated(rows: DataFrame, name: list[str]) -> DataFrame | None:
    """The names that stand on several rows; none, if all differ."""
    twice = rows.groupBy(*name).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"_{c}") for c in name])
    return None if twice.isEmpty() else twice


def _matching(rows: DataFrame, names: DataFrame, how: str) -> DataFrame:
    same = functools.reduce(operator.and_, [rows[c[1:]].eqNullSafe(names[c]) for c in names.columns])
    return rows.join(names, same, how)


def best_similar(core: DataFrame, ext: DataFrame, threshold: float, max_bytes: int = MAX_BROADCAST_BYTES, **limits: int) -> DataFrame:
    """`(keyword, source, cos)`: the best cosine of each row of `ext` with the core keywords of a source, as `similar_keywords` pairs them.

    All pairs are compared, but where core is broadcast at most one row per keyword and
    source leaves a task, not one per pair. A keyword on several rows has several.
    """
    left = core.select(F.to_json(F.struct(F.col("source").alias("s"), F.col("keyword").alias("k"))).alias("id"), as_doubles("embedding").alias("vector"))
    right = ext.select(F.lower("keyword").alias("id"), as_doubles("embedding").alias("vector"))
    left, right, size = _measured(left, right)
    if size["n"] * size["dim"] * 8 + size["ids"] > max_bytes:
        return similar_keywords(core, ext, threshold, max_bytes=max_bytes, **limits).drop("core_keyword")
    parsed = F.from_json("id", "s string, k string")
    named = left.select(parsed["s"].alias("source"), parsed["k"].alias("id"), "vector").where("id IS NOT NULL").toArrow()
    sources: dict[str | None, int] = {}
    source = np.array([sources.setdefault(s, len(sources)) for s in named["source"].to_pylist()], np.int64)
    names: dict[str, int] = {}
    name = np.array([names.setdefault(k, len(names)) for k in named["id"].to_pylist()], np.int64)
    matrix = _unit_rows(_matrix(named["vector"].combine_chunks(), named.num_rows))
    shared = core.sparkSession.sparkContext.broadcast((list(sources), source, names, name, matrix))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources, source, names, name, matrix = shared.value
        screen = Screen(matrix, threshold) if len(name) else None
        for batch in batches:
            if not len(name) or not batch.num_rows:
                continue
            ids = np.array(batch.column("id").to_pylist(), dtype=object)
            own = np.array([names.get(k, -1) for k in ids], np.int64)
            best = np.full((len(sources), len(ids)), -np.inf)
            for i, j, cos in screen.above(_vectors(batch)):
                differs = name[i] != own[j]
                np.maximum.at(best, (source[i[differs]], j[differs]), cos[differs])
            s, j = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[j], pa.string()), pa.array([sources[x] for x in s.tolist()], pa.string()), pa.array(best[s, j])], names=["keyword", "source", "cos"])

    return right.where(F.col("id").isNotNull()).select("id", "vector").mapInArrow(compare, "keyword string, source string, cos double")


def threshold_sweep(similar: DataFrame, thresholds: list[float], order: tuple[str, ...]) -> DataFrame:
    """Distinct keywords in total and per source for every threshold, in one pass.

    A keyword counts for its strongest source at each threshold. Per keyword and
    source only the best cosine matters, so that is what is shuffled.
    """
    rank = F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(order)])
    best = similar.groupBy("keyword", rank.alias("rank")).agg(F.max("cos").alias("cos"))
    steps = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    reached = best.withColumn("threshold", steps).where(F.col("cos") > F.col("threshold"))
    owner = reached.groupBy("threshold", "keyword").agg(F.min("rank").alias("rank"))
    per_source = [
        F.count(F.when(F.col("rank") == i, 1)).alias(f"n_{source}") for i, source in enumerate(order)
    ]
    return owner.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_keywords"), *per_source)
