import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES, make_docs
from tests.llm.test_minhash import sets_of  # noqa: F401
from termweave.llm import simhash


def plain_fingerprint(text, size):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, distance):
    """Smallest member of each value's component."""
    values = sorted(set(values))
    label = {}
    for start in values:
        if start in label:
            continue
        todo = [start]
        label[start] = start
        while todo:
            x = todo.pop()
            for y in values:
                if y not in label and (x ^ y).bit_count() <= distance:
                    label[y] = start
                    todo.append(y)
    return label


def test_documents_equal_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    fp = {r.doc_id: plain_fingerprint(r.text, 3) for r in rows}
    label = plain_components(fp.values(), 2)
    least = {}
    for doc, f in fp.items():
        least[label[f]] = min(doc, least.get(label[f], doc))
    found = simhash.near_duplicates(docs, shingle=3).collect()
    assert {r.doc_id: r.fingerprint for r in found} == {d: f"{f:016x}" for d, f in fp.items()}
    assert {r.doc_id: r.component_id for r in found} == {d: least[label[f]] for d, f in fp.items()}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def check_links(spark, values, distance):
    frame = spark.createDataFrame([(signed(v),) for v in set(values)], "fp long")
    label = plain_components(values, distance)
    parent = {v: v for v in label}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in simhash.links(frame, distance).collect():
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        assert label[a] == label[b]
        parent[root(a)] = root(b)
    assert len({root(v) for v in parent}) == len(set(label.values()))


@pytest.mark.parametrize("distance", [2, 4])
@pytest.mark.parametrize("bucket_rows", [8, 512])
def test_links_equal_brute_force(spark, monkeypatch, distance, bucket_rows):
    """Random, chained and crowded fingerprints, with tied and constant bits."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket_rows)
    rng = np.random.default_rng(3)
    values = [int(x) for x in rng.integers(0, 1 << 63, 300, dtype=np.uint64)]
    for _ in range(400):
        x = values[int(rng.integers(len(values)))]
        for b in rng.choice(64, int(rng.integers(1, distance + 3)), replace=False):
            x ^= 1 << int(b)
        values.append(x)
    crowd = values[0]
    values += [crowd ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(40, 64, (200, 3))]
    check_links(spark, values, distance)
    tied = [v & 0xFFFF | (v & 0xFFFF) << 16 | 5 << 40 for v in values[:200]]
    check_links(spark, tied, distance)


def test_thresholds_add_up_and_are_best():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    bits = simhash._bits(fps)
    groups = [list(range(0, 20)), list(range(20, 40)), list(range(40, 64))]
    shares = []
    for piece in [p for g in groups for p in simhash._pieces(g)]:
        shares.append(simhash.near_shares(rng.integers(0, 100, 256) ** 9 * (np.arange(256) < 1 << len(piece)), 2))
    got = simhash.thresholds(bits, groups, shares, 3_000_000, 2)
    assert (got.sum(axis=1) == 2 - 3 + 1).all() and got.min() >= -1 and len({tuple(g) for g in got}) > 1

    def work(row, chosen):
        total, at = 0.0, 0
        for group, t in zip(groups, chosen):
            near = [1.0, 0.0, 0.0]
            for piece in simhash._pieces(group):
                own = shares[at][int(simhash._values(bits[row : row + 1], piece)[0])]
                near = [sum(near[k] * own[d - k] for k in range(d + 1)) for d in range(3)]
                at += 1
            if t >= 0:
                total += 3_000_000 * sum(near[: t + 1]) + simhash.PROBE * simhash.ball(len(group), t)
        return total

    options = [(a, b, 0 - a - b) for a in range(-1, 3) for b in range(-1, 3) if -1 <= -a - b <= 2]
    for row in range(len(fps)):
        assert work(row, got[row]) == pytest.approx(min(work(row, o) for o in options))


def test_correlated_bits_stand_together():
    rng = np.random.default_rng(5)
    free = rng.integers(0, 2, (2000, 32))
    bits = np.empty((2000, 64), int)
    bits[:, 0::2], bits[:, 1::2] = free, free
    groups = simhash.grouped_bits(bits.T @ bits, 2000, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert all(b ^ 1 in g for g in groups for b in g)


def test_edge_cases(spark):
    df = make_docs(spark, EDGES, doc=F.lit(1), fp=F.lit("x"), component=F.lit(2))
    found = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert len(found) == len(EDGES) and [found[i].fingerprint for i in range(3)] == ["0" * 16] * 3
    assert [found[i].component_id for i in range(3)] == [0, 0, 0] and found[6].component_id == 5
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    repeated = df.unionByName(df.withColumn("doc_id", F.lit(None).cast("long")))
    both = simhash.near_duplicates(repeated)
    assert both.count() == 2 * len(EDGES) and both.where("component_id IS NULL").count() == 0
    alone = simhash.near_duplicates(df.withColumn("doc_id", F.lit(None).cast("long")))
    assert alone.where("component_id IS NULL").count() == len(EDGES)
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)
