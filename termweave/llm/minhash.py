"""Near-duplicate grouping with SuperMinHash signatures.

Signatures: each element of a set draws, from its own random stream, a permutation of the
signature's places together with ascending ranks; a place keeps its smallest rank. The
ranks of one element are correlated over the places, which lowers the variance against
independent hashes, and a set is finished as soon as no later rank can be smaller.

Grouping: rows with equal shingle sets are one node. Signatures are cut into bands; equal
bands make a bucket. Only signatures are looked at first: every node against the best
connected member of its buckets, then, in buckets that still hold several groups, block by
block. Near signatures join nodes to candidate groups, found by union-find, which hold
every link. Each text is then sent once to the task of its candidate group, where pairs
still apart are verified on full sets. A candidate group too large for a task is first
verified against its best connected member; what that leaves apart meets all of the group
in blocks. Only links that join something leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import SLICE_BYTES, WordHashes, as_long, give_back, list_of, mixed, same_text, slices, strings, windows, words_of
from termweave.llm.components import Forest, connected
from termweave.session import durable, release

#: Bands and places in a band: a pair of similarity 0.85 is missed with probability 7e-8, one of 0.8 with 1.5e-5.
BANDS, ROWS = 28, 5
#: Pairs whose signatures agree in this much less than the limit are not looked up. At 140 places a pair
#: at the limit falls below with probability under 1e-8, less than the odds that all bands miss it.
MARGIN = 0.2
#: A task holds so many nodes, or so many shingles, of a group at once.
BLOCK_ROWS, BLOCK_SHINGLES = 2_048, 600_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
WRAP = (1 << 64) - 1


def super_minhash(elements: np.ndarray, owner: np.ndarray, sets: int, places: int) -> np.ndarray:
    """SuperMinHash signatures (`sets` x `places`, 16 bits each) of sets of distinct 64-bit elements.

    `owner` says to which set an element belongs. Step j lets each element offer
    rank j + u to the j-th place of its permutation, which is built as it goes by swaps.
    A set stops when all its places hold ranks below j + 1. Equal places of two sets
    come from one element; an empty set has a signature of its own kind.
    """
    best = np.full(sets * places, np.inf)
    perm = None
    for j in range(places):
        draw = mixed(elements + np.uint64(int(GOLDEN) * (2 * j + 1) & WRAP))
        rank = j + (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        pick = j + (mixed(draw + GOLDEN) % np.uint64(places - j)).astype(np.int64)
        at = np.arange(len(elements))
        if perm is None:
            place = pick
        else:
            place = perm[at, pick]
            perm[at, pick] = perm[:, j]
        np.minimum.at(best, owner * places + place, rank)
        open_sets = best.reshape(sets, places).max(axis=1) >= j + 1
        live = open_sets[owner]
        if not live.any():
            break
        if perm is None:
            perm = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int32), (int(live.sum()), 1))
            perm[np.arange(len(perm)), pick[live]] = 0
        else:
            perm = perm[live]
        elements, owner = elements[live], owner[live]
    bits = mixed(best.view(np.uint64))
    return (bits >> np.uint64(48)).astype(np.uint16).reshape(sets, places)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for every band of every signature."""
    parts = signatures.reshape(len(signatures), bands, -1).astype(np.uint64)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        key = mixed(key + GOLDEN) ^ parts[:, :, i]
    return mixed(key)


def shingle_sets(texts: list[str], size: int, known: WordHashes) -> list[np.ndarray]:
    """Sorted distinct hashes of the `size`-word shingles of each text."""
    return [np.unique(windows(known.of(words_of(t)), size)) for t in texts]


def signatures(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """`(doc, text_hash, n, node, sig)` of `docs(doc, text_hash, text)`: size, 64-bit fingerprint and signature of each row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 2):  # a signature's permutations take some 25 bytes for each byte of text
                sets = shingle_sets(strings(part, "text"), shingle, known)
                n = np.array([len(s) for s in sets], np.int64)
                elements = np.concatenate([*sets, np.empty(0, np.uint64)])
                sig = super_minhash(elements, np.repeat(np.arange(len(sets)), n), len(sets), bands * rows)
                prints = np.array([int(mixed(mixed(s + GOLDEN).sum(dtype=np.uint64) + np.uint64(len(s)))) if len(s) else 0 for s in sets], np.uint64)
                columns = [part.column("doc"), part.column("text_hash"), pa.array(n), as_long(prints), pa.array([s.tobytes() for s in sig], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "text_hash", "n", "node", "sig"])
            give_back()

    return docs.mapInArrow(run, "doc long, text_hash long, n long, node long, sig binary")


def _signature_rows(column: pa.Array) -> np.ndarray:
    """Binary signatures as a matrix of their places."""
    return np.stack([np.frombuffer(x, np.uint16) for x in column.to_pylist()]) if len(column) else np.empty((0, 0), np.uint16)


def buckets(nodes: DataFrame, bands: int = BANDS) -> DataFrame:
    """`(bucket, node)`: one row per node and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(_signature_rows(batch.column("sig")), bands) if batch.num_rows else np.empty((0, bands), np.uint64)
            yield pa.RecordBatch.from_arrays([as_long(keys.ravel()), batch.column("node").take(pa.array(np.repeat(np.arange(batch.num_rows), bands)))], names=["bucket", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "bucket long, node long")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sets of distinct values."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def _near_pairs(need: float):
    """Rows `(a, b)` of `(a, b, left, right)` whose signatures agree in `need` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = (_signature_rows(batch.column("left")) == _signature_rows(batch.column("right"))).sum(axis=-1) >= need
            yield batch.select(["a", "b"]).filter(pa.array(keep.reshape(-1), pa.bool_()))

    return run


class _Group:
    """The nodes of a group that later ones are compared with."""

    def __init__(self):
        self.unit, self.forest, self.nodes, self.parts, self.sets, self.sig = None, Forest(), [], [], [], np.empty((0, 0), np.uint16)

    def add(self, node: int, sig: np.ndarray, part: int = 0, elements: np.ndarray | None = None) -> None:
        at = len(self.nodes)
        if at >= len(self.sig):
            grown = np.empty((max(16, 2 * at), len(sig)), np.uint16)
            if at:
                grown[:at] = self.sig
            self.sig = grown
        self.sig[at] = sig
        self.nodes.append(node)
        self.parts.append(part)
        self.sets.append(elements)

    def near(self, sig: np.ndarray, need: float) -> list[int]:
        """Numbers of the nodes with near signatures, the nearest first."""
        if not self.nodes:
            return []
        agree = (self.sig[: len(self.nodes)] == sig).sum(axis=1)
        found = np.flatnonzero(agree >= need)
        return found[np.argsort(-agree[found], kind="stable")].tolist()


def _near_in_blocks(need: float):
    """Near signatures that join something, from rows `(unit, node, label, part, across, sig)` sorted by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = _Group()
        for batch in batches:
            out = []
            for unit, node, label, part, across, raw in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if unit != group.unit:
                    group = _Group()
                    group.unit = unit
                group.forest.unite(node, label)
                sig = np.frombuffer(raw, np.uint16)
                for i in group.near(sig, need):
                    if not (across and group.parts[i] == part) and group.forest.unite(group.nodes[i], node):
                        out.append((group.nodes[i], node))
                group.add(node, sig, part)
            yield _links(out)

    return run


def _links(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


#: Roles of a row in its group: compared and kept, kept only, compared only.
BOTH, HELD, PASSING = 0, 1, 2


def _verified(shingle: int, percent: int, need: float):
    """Links on full sets that join something, from rows `(unit, role, node, label, sig, text)` sorted by unit and role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, group = WordHashes(), _Group()
        for batch in batches:
            for rows in slices(batch, "text"):
                out, sets = [], shingle_sets(strings(rows, "text"), shingle, known)
                for unit, role, node, label, raw, elements in zip(*(rows.column(i).to_pylist() for i in range(5)), sets, strict=True):
                    if unit != group.unit:
                        group = _Group()
                        group.unit = unit
                    forest, sig = group.forest, np.frombuffer(raw, np.uint16)
                    forest.unite(node, label)
                    if role != HELD:
                        for i in group.near(sig, need):
                            if forest.root(group.nodes[i]) != forest.root(node) and linked(group.sets[i], elements, percent):
                                forest.unite(group.nodes[i], node)
                                out.append((group.nodes[i], node))
                    if role != PASSING:
                        group.add(node, sig, 0, elements)
                yield _links(out)
            give_back()

    return run


def _verified_stars(shingle: int, percent: int):
    """Rows `(a, b)` of `(a, b, left, right)` whose texts are linked; few texts stand on the left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, hub = WordHashes(), None, None
        for batch in batches:
            for rows in slices(batch, "right"):
                keep = []
                for a, left, elements in zip(rows.column("a").to_pylist(), rows.column("left"), shingle_sets(strings(rows, "right"), shingle, known), strict=True):
                    if a != last:
                        last, (hub,) = a, shingle_sets([left.as_py() or ""], shingle, known)
                    keep.append(linked(hub, elements, percent))
                yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            give_back()

    return run


def candidates(nodes: DataFrame, need: float, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """`(node, component)` of the groups that near signatures in shared buckets make, and `(node, degree)`: how many meet it in its buckets."""
    member = buckets(nodes, bands)
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    both = durable(member.join(shared, "bucket"))
    degree = both.groupBy("node").agg(F.sum(F.col("members") - 1).alias("degree"))
    # The best connected member stands in for its bucket; a node looks at the best of its buckets'.
    known = durable(both.select("bucket", "node").join(degree, "node"))
    top = known.groupBy("bucket").agg(F.max(F.struct("degree", F.col("node").alias("hub"))).alias("top"))
    best = known.join(top, "bucket").groupBy("node").agg(F.max("top").alias("top")).select("node", F.col("top.hub").alias("hub")).where("node <> hub")
    left, right = nodes.select(F.col("node").alias("a"), F.col("sig").alias("left")), nodes.select(F.col("node").alias("b"), F.col("sig").alias("right"))
    stars = best.toDF("b", "a").join(right, "b").join(left, "a").select("a", "b", "left", "right")
    near = durable(stars.mapInArrow(_near_pairs(need), "a long, b long"))
    first = connected(near).toDF("node", "label")
    labelled = known.join(first, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int")
    split = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), blocks.alias("blocks")).where("lo < hi").select("bucket", "blocks")
    apart = labelled.join(split, "bucket").withColumn("part", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    low, high = (lambda x: F.least(x, F.col("part"))), (lambda x: F.greatest(x, F.col("part")))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.xxhash64("bucket", low(x), high(x)).alias("unit"), (x != F.col("part")).alias("across")))
    units = apart.select("node", "label", "part", F.inline(pair)).join(nodes.select("node", "sig"), "node")
    rows = units.select("unit", "node", "label", "part", "across", "sig").repartition("unit").sortWithinPartitions("unit")
    more = durable(rows.mapInArrow(_near_in_blocks(need), "a long, b long"))
    found = connected(near.unionByName(more)).toDF("node", "component")
    release(both, near, more)
    return found, known.select("node", "degree").distinct()


def verified_links(docs: DataFrame, nodes: DataFrame, found: DataFrame, degree: DataFrame, shingle: int, percent: int, need: float) -> DataFrame:
    """`(a, b)`: links on full sets, whose components are those of all links within the candidate groups."""
    inside = found.join(nodes, "node").select("component", "node", "n", "sig", "doc", "text_hash")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    known = durable(inside.join(inside.groupBy("component").agg(parts.alias("parts")), "component"))
    small, large = known.where("parts = 1"), known.where("parts > 1")

    def with_text(rows: DataFrame) -> DataFrame:
        return rows.join(docs, ["doc", "text_hash"])

    units = with_text(small).select(F.col("component").alias("unit"), F.lit(BOTH).alias("role"), "node", F.col("node").alias("label"), "sig", "text")
    rows = units.repartition("unit").sortWithinPartitions("unit", "node")
    check = _verified(shingle, percent, need)
    links = durable(rows.mapInArrow(check, "a long, b long"))
    if large.isEmpty():
        return links
    big = durable(with_text(large).select("component", "node", "n", "sig", "text"))
    tops = large.join(degree, "node").groupBy("component").agg(F.max(F.struct("degree", "node")).alias("top")).select(F.col("component").alias("of"), F.col("top.node").alias("a"))
    hubs = big.join(tops, (F.col("component") == F.col("of")) & (F.col("node") == F.col("a"))).select("component", "a", F.col("text").alias("left"))
    pairs = hubs.join(big.select("component", F.col("node").alias("b"), F.col("text").alias("right")), "component").select("a", "b", "left", "right")
    stars = durable(pairs.mapInArrow(_verified_stars(shingle, percent), "a long, b long"))  # a hub is linked with itself
    # What is not linked with its group's hub meets every node of the group.
    told = big.join(stars.toDF("label", "node"), "node", "left").select("component", "node", "n", "sig", "text", "label")
    plan = told.groupBy("component").agg(
        F.ceil(F.greatest(F.count(F.when(F.col("label").isNull(), 1)) / BLOCK_ROWS, F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("n"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("runs"),
    )
    met = told.join(plan.where("blocks > 0"), "component")
    block, run = (F.pmod(F.xxhash64(F.col("node"), F.lit(salt)), F.col(name)).cast("int") for salt, name in ((1, "blocks"), (2, "runs")))

    def placed(df: DataFrame, role: int, block, run) -> DataFrame:
        where = df.withColumn("block", block).withColumn("run", run)
        return where.select(F.xxhash64("component", "block", "run").alias("unit"), F.lit(role).alias("role"), "node", F.coalesce("label", "node").alias("label"), "sig", "text")

    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    held = placed(met.where("label IS NULL"), HELD, block, every("runs"))
    passing = placed(met, PASSING, every("blocks"), run)
    rows = held.unionByName(passing).repartition("unit").sortWithinPartitions("unit", "role", "node")
    rest = durable(rows.mapInArrow(check, "a long, b long"))
    release(big)
    return links.unionByName(stars).unionByName(rest)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """`(doc_id, n_shingles, component_id, kept, text_hash, first)` for each row of `docs`.

    Two documents are linked if 100 * intersection >= percent * union of their word-
    shingle sets; `component_id` is the smallest id reachable over links, itself
    included, and `kept` marks the document that has it. Words are runs without ASCII
    white space, A-Z lower-cased; a text with fewer words than a shingle is one shingle.
    Null and empty texts have no shingles and are linked with nothing. Rows that repeat an
    id with different texts are linked by their own texts only; `text_hash` tells them
    apart and `first` marks the rows of one id and text in each component. A null id has no
    links, is its own (null) component and is kept. Other columns are not read. `key` is a
    whole number. Set sizes and links are exact up to collisions of 64-bit hashes and the
    stated odds of missing a pair with the bands.
    """
    keyed = docs.select(F.col(key).cast("long").alias("doc"), same_text(text).alias("text_hash"), F.col(text).alias("text"))
    base = durable(signatures(keyed, shingle, bands, rows))
    filled = base.where("n > 0 AND doc IS NOT NULL")
    # Equal sets are one node, which its smallest row stands for.
    own = filled.groupBy("node").agg(F.min(F.struct("doc", "text_hash")).alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = durable(own.select("node", "n", "sig", "least.doc", "least.text_hash"))
    need = (percent / 100 - MARGIN) * bands * rows
    found, degree = candidates(nodes, need, bands)
    repeated = base.groupBy("doc", "text_hash").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    texts = keyed if repeated.isEmpty() else keyed.dropDuplicates(["doc", "text_hash"])
    links = verified_links(texts, nodes, found, degree, shingle, percent, need)
    labels = connected(links).toDF("node", "component")
    placed = nodes.join(labels, "node", "left").select("node", "doc", "text_hash", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min(F.struct("doc", "text_hash")).alias("least"))
    named = placed.join(least, "component").select("node", "least")
    doc, other = F.col("doc"), base.where("n = 0 OR doc IS NULL")
    some = filled.join(named, "node").select("doc", "n", F.col("least.doc").alias("component"), "text_hash", F.struct("doc", "text_hash").eqNullSafe(F.col("least")).alias("first"))
    out = some.unionByName(other.select("doc", "n", doc.alias("component"), "text_hash", F.lit(True).alias("first")))
    return out.select(doc.alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), doc.eqNullSafe(F.col("component")).alias("kept"), "text_hash", "first")
