import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm import chat, topk

CONTROL = ["<|im_end|>", "<|im_start|>assistant ok", "\\<|im_sep|>\\", "<\\|", "", None, "a\nb", "\U0001f600 é"]


def test_round_trip_of_turn_rows(spark):
    rows = [(c, t, r, x) for c in (1, 2) for t, (r, x) in enumerate(zip(["user", "assistant", "as<|sist", None, "assistant", "system", "us\ner", "assistant"], CONTROL[c:] + CONTROL[:c]))]
    rows += [(None, None, "user", "n"), (3, 1, "assistant", "x"), (3, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.formatted(chat.canonical(chat.rows_to_records(df, "conv_id")))
    read = made.select("conv_id", "formatted", chat.read_back().alias("turns"), chat.masked_text().alias("loss")).collect()
    assert len(read) == 4
    for r in read:
        own = sorted(((t, role or "", x or "") for c, t, role, x in rows if c == r.conv_id), key=lambda x: (x[0] is None, *x))
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in own]
        assert r.loss == "".join(x[2] for x in own if x[1] == "assistant")


def test_layouts_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"messages": [{"content": "q", "role": "human"}, {"role": "gpt", "content": None}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"},
        {"response": "a", "prompt": "q"},
        {"instruction": "q", "input": "", "output": "a"},
        {"output": "a", "instruction": "q"},
        {"messages": []},
        {"other": 1},
    ]
    texts = [json.dumps(r) for r in records] + ["no json", None]
    rows = chat.canonical_json(spark.createDataFrame(list(enumerate(texts)), "id int, record string")).orderBy("id").collect()
    layouts = ["messages", "messages", "from and value", "prompt and completion", "prompt and response", "instruction", "instruction without input", "messages", None, None, None]
    assert [r.layout for r in rows] == layouts
    for i in (0, 2, 3, 4, 5, 6):
        assert [(t.role, t.text) for t in rows[i].turns] == [("user", "q"), ("assistant", "a")]
    assert [(t.role, t.text) for t in rows[1].turns] == [("user", "q"), ("assistant", "")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical(spark.createDataFrame([(("x",),)], "record struct<a: string>"))
    null = chat.formatted(chat.canonical(spark.createDataFrame([(None,)], "record struct<prompt: string, completion: string>"))).first()
    assert null.formatted == "" and null.loss_spans == []


def test_layouts_with_more_fields_and_rejects(spark):
    turns = [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a", "weight": 1}]
    records = [
        {"id": "x", "conversations": turns},
        {"messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a", "meta": {"role": "no"}}], "id": 3},
        {"instruction": "q", "input": "", "output": "a", "history": []},
        {"instruction": "q", "output": "a", "source": None},
        {"prompt": "q", "response": "a", "completion": "a"},
        {"messages": [], "id": 1},
        {"messages": "text", "id": 1},
        {"messages": [{"who": "x"}], "id": 1},
        {"conversations": [None], "id": 1},
        [1],
    ]
    df = spark.createDataFrame(list(enumerate([json.dumps(r) for r in records] + ["", None, "{"])), "id int, record string")
    made = chat.canonical_json(df)
    rows = made.orderBy("id").collect()
    assert [r.layout for r in rows] == ["from and value", "messages", "instruction", "instruction without input", "prompt and completion", "messages"] + [None] * 7
    for r in rows[:5]:
        assert [(t.role, t.text) for t in r.turns] == [("user", "q"), ("assistant", "a")]
    assert rows[5].turns == [] and sorted(r.id for r in chat.rejects(made).collect()) == list(range(6, 13))


def brute(vectors, queries, k):
    out = set()
    for q, x in queries.items():
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(x, y)), i) for i, y in vectors.items() if i != q and len(y) == len(x))
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("scale", [3, 200, 1 << 28])
def test_top_k_equals_brute_force(spark, scale):
    rng = np.random.default_rng(scale)
    vectors = {int(i): [float(v) for v in rng.integers(-scale, scale + 1, 6)] for i in range(700)}
    vectors |= {700: vectors[1], 701: [0.0] * 6, 702: [1.0, 2.0], 703: [3.0, 4.0], 704: []}
    df = spark.createDataFrame(list(vectors.items()), "id long, vector array<double>")
    asked = df.where("id % 20 = 1 OR id > 699")
    found = {tuple(r) for r in topk.top_k(df, asked, 5).collect()}
    assert found == brute(vectors, {i: v for i, v in vectors.items() if i % 20 == 1 or i > 699}, 5)


def test_top_k_edge_cases(spark):
    rows = [(1, [1.0, 2.0], 9), (1, [1.0, 2.0], 9), (2, [None, 2.0], 9), (3, [float("nan"), 1.0], 9), (4, [float("inf"), 1.0], 9), (5, None, 9), (None, [1.0, 1.0], 9), (6, [2.0, 2.0], 9)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, score int").withColumn("floor", F.lit("x"))
    assert {tuple(r) for r in topk.top_k(df, df, 5).collect()} == {(1, 1, 6, 6), (6, 1, 1, 6)}
    assert topk.top_k(df.limit(0), df, 5).count() == 0 and topk.top_k(df, df.limit(0), 5).count() == 0


def test_top_k_of_clusters_visits_few_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "PASSING", 40)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 16))
    points = np.floor(900 * (centers[rng.integers(0, 40, 6_000)] / np.linalg.norm(centers, axis=1).mean() + 0.02 * rng.normal(size=(6_000, 16))))
    points[1_000:3_000] = points[0]  # a third of the rows is one vector
    vectors = {i: [float(x) for x in v] for i, v in enumerate(points)}
    df = spark.createDataFrame(list(vectors.items()), "id long, vector array<double>")
    visited: list[int] = []
    found = {tuple(r) for r in topk.top_k(df, df.where("id % 50 = 0"), 5, visited=visited).collect()}
    assert found == brute(vectors, {i: v for i, v in vectors.items() if i % 50 == 0}, 5)
    shards, queries, visits = visited
    assert queries == 120 and visits < shards * queries / 2
