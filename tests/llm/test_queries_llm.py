"""Registered queries against their SQL, and the pipeline against a plain version of its stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import EDGES, make_docs
from termweave.llm import lines, ordinal, pii
from termweave.llm.queries import ORACLES, QUERIES, graded_labels
from tools.check_queries import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) is None


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_pipeline_equals_its_stages(spark, sf, docs):
    model = ordinal.fit(docs, graded_labels(spark.read.parquet(f"{sf}/labels.parquet")), 3)
    features = ordinal.Features()
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    kept = {k: t for k, t in rows.items() if t.strip() and model.tails(ordinal.np.array([model.score(features, t)]))[0, -1] >= 0.5}
    first = corpus_pipeline.quality_classifier(spark, docs, sf)
    assert {r.doc_id: r.text for r in first.collect()} == kept and first.columns == docs.columns
    second = corpus_pipeline.quality_rules(spark, first, sf)
    verdict = {r.doc_id: r for r in lines.judge(first).collect()}
    after = {r.doc_id: r.text for r in second.collect()}
    assert after.keys() == {k for k in kept if verdict[k].kept}
    from tests.llm.test_minhash import brute

    component, _ = brute(list(after), list(after.values()), 5, 80)
    third = corpus_pipeline.near_dedup(spark, second, sf)
    single = {r.doc_id: r.text for r in third.collect()}
    assert single == {k: t for k, t in after.items() if component[k] == k}
    fourth = corpus_pipeline.personal_data(spark, third, sf)
    assert {r.doc_id: (r.text, r.n_chars) for r in fourth.collect()} == {k: (pii.redacted(t), len(pii.redacted(t))) for k, t in single.items()}
    last = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in last.collect()} == single.keys()
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_stages_on_edge_cases(spark, sf):
    own = make_docs(spark, EDGES)
    for df in (own, own.limit(0), own.unionByName(own), own.withColumn("doc_id", F.lit(None).cast("long"))):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf)
            assert out.columns == df.columns and out.count() <= df.count()
        pieces = corpus_pipeline.packing(spark, df, sf).count()
        assert pieces >= df.count()
    assert corpus_pipeline.near_dedup(spark, own.unionByName(own), sf).count() == len(EDGES) - 1


def test_stages_hand_on_clashing_columns(spark, sf, docs):
    names = ["removed_lines", "_id", "_hash", "_rows", "kept", "tail", "selected", "spans", "expected_grade", "id", "hash", "row", "text_hash", "first", "gone"]
    clashing = docs.withColumns({n: F.concat(F.lit(f"{n} "), F.col("doc_id")) for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, out = stage(spark, docs, sf), stage(spark, clashing, sf)
        assert out.columns == clashing.columns
        rows = {r.doc_id: r for r in out.collect()}
        assert {r.doc_id: r.text for r in plain.collect()} == {k: r.text for k, r in rows.items()}
        assert all(r[n] == f"{n} {k}" for k, r in rows.items() for n in names)
    assert corpus_pipeline.packing(spark, clashing, sf).count() == corpus_pipeline.packing(spark, docs, sf).count()


def test_dedup_keeps_other_texts_of_an_id(spark, sf):
    a, b = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    df = make_docs(spark, [a, b, a, b + " end"]).withColumn("doc_id", F.array(*[F.lit(x) for x in (3, 3, 3, 9)])[F.col("doc_id").cast("int")].cast("long"))
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, sf).collect()) == [(3, a), (3, b)]
