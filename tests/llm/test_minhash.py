import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES, make_docs
from termweave.llm import components, minhash
from termweave.llm.components import connected


def sets_of(texts, size):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def brute(ids, texts, size, percent):
    sets, parent = sets_of(texts, size), list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    parent[root(i)] = root(j)
    groups = {}
    for i, key in enumerate(ids):
        groups.setdefault(root(i), []).append(key)
    return {key: min(g) for g in groups.values() for key in g}, {key: len(s) for key, s in zip(ids, sets)}


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(1, 1 << 63, 900, dtype=np.uint64)
    for shared in (100, 500, 850):
        a, b = base[:900], np.concatenate([base[:shared], rng.integers(1, 1 << 63, 900 - shared, dtype=np.uint64)])
        sig = minhash.super_minhash(np.concatenate([a, b]), np.repeat([0, 1], 900), 2, 256)
        assert abs((sig[0] == sig[1]).mean() - shared / (1800 - shared)) < 0.12
    tiny = minhash.super_minhash(base[:3], np.array([0, 0, 1]), 3, 64)
    assert (tiny[0] != tiny[2]).any() and len(set(tiny[2])) == 1


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_groups_equal_brute_force(docs, size, percent):
    rows = docs.select("doc_id", "text").collect()
    component, sizes = brute([r.doc_id for r in rows], [r.text for r in rows], size, percent)
    found = minhash.near_duplicates(docs, shingle=size, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in found} == component
    assert {r.doc_id: r.n_shingles for r in found} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_chain_of_copies_through_a_late_base(spark, monkeypatch):
    """Copies that are linked through their base only, which has the largest id; blocks are forced to be small."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(60):
        own = list(base)
        for at in rng.choice(190, 4, replace=False):
            own[at] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(own))
    texts.append(" ".join(base))
    component, _ = brute(range(len(texts)), texts, 3, 85)
    for rows in (8, minhash.BLOCK_ROWS):
        monkeypatch.setattr(minhash, "BLOCK_ROWS", rows)
        found = {r.doc_id: r.component_id for r in minhash.near_duplicates(make_docs(spark, texts), shingle=3, percent=85).collect()}
        assert found == component


def test_ring_ends(spark):
    """Each text is linked with the next one only, and the last with the first."""
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join((words + words)[i * 10 : i * 10 + 200]) for i in range(30)]
    component, _ = brute(range(30), texts, 3, 85)
    assert set(component.values()) == {0}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(make_docs(spark, texts), shingle=3, percent=85).collect()} == component


def test_repeated_id_with_two_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    rows = [(3, a), (3, b), (4, b + " end"), (5, a + " end"), (3, a), (9, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(3, 3), (3, 3), (3, 3), (4, 3), (5, 3), (9, 3)]
    assert sum(r.first for r in found) == 3


def test_edge_cases(spark):
    df = make_docs(spark, EDGES, doc=F.lit(1), n=F.lit("x"), bands=F.lit(None))
    found = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert len(found) == len(EDGES)
    assert [found[i].n_shingles for i in range(4)] == [0, 0, 0, 1]
    assert [found[i].component_id for i in range(7)] == [0, 1, 2, 3, 4, 5, 5]
    assert not found[6].kept
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    repeated = df.unionByName(df.withColumn("doc_id", F.lit(None).cast("long")))
    assert minhash.near_duplicates(repeated).where("doc_id IS NULL AND kept").count() == len(EDGES)


@pytest.mark.parametrize("bound", [0, 250_000])
def test_components(spark, monkeypatch, bound):
    monkeypatch.setattr(components, "FOREST_NODES", bound)
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (200, 201)]
    found = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_chain_ends(spark, monkeypatch):
    monkeypatch.setattr(components, "FOREST_NODES", 1_000)
    edges = spark.range(5_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(16, F.hash("a"))
    found = connected(edges).groupBy("component").count().collect()
    assert [tuple(r) for r in found] == [(0, 5_001)]
