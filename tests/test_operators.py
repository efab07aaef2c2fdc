import math
import random
import re
from collections import Counter, defaultdict
from statistics import median, pstdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.functions.fixed import ENGLISH_STOP_WORDS
from termweave.operators import graph, keyphrase, models, skew, tfidf
from termweave.operators.frequency import keyword_documents
from termweave.operators.lemma import clean_sample
from termweave.operators.patterns import substring_hits
from termweave.operators.similarity import similar_pairs
from termweave.plans import dictionaries as dic


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one key."""
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 40}") for i in range(900)]
    return spark.createDataFrame(rows, "id long, key string").cache(), rows


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_salted_join_equals_plain_join(spark, skewed, how):
    df, _ = skewed
    other = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), ("zz", 4)], "key string, v int")
    salted = skew.salted_join(df, other, "key", how, rows_per_split=20)
    plain = df.join(other, "key", how)
    assert sorted(map(repr, salted.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_group_count_and_lists(spark, skewed):
    df, rows = skewed
    counts = Counter(k for _, k in rows)
    assert all(r.frequency == counts[r.key] for r in skew.with_group_count(df, "key", rows_per_split=20).collect())
    assert sorted((r.member, r.key) for r in skew.keyed_values(df, "key", member=F.col("id")).collect()) == sorted(rows)
    wanted = keyword_documents(df.withColumnRenamed("key", "keyword"), "id", 20, 25, rows_per_split=5).collect()
    assert sorted((r.id, r.keyword, r.frequency) for r in wanted) == sorted((i, k, counts[k]) for i, k in rows if 20 <= counts[k] <= 25)


def test_keep_first_dense_id_smallest_n(spark, skewed):
    df, rows = skewed
    first = {r.key: r.id for r in skew.keep_first(df, "key", ["id"]).collect()}
    assert first == {k: min(i for i, x in rows if x == k) for _, k in rows}
    ids = skew.dense_id(df, ["key", F.desc("id")], "n").collect()
    ordered = sorted(rows, key=lambda r: (r[1], -r[0]))
    assert [(r.id, r.key) for r in sorted(ids, key=lambda r: r.n)] == ordered
    assert sorted(r.n for r in ids) == list(range(len(rows)))
    order = F.md5(F.col("id").cast("string"))
    kept = skew.smallest_n(df, order, "id", 100).select("id")
    expected = df.orderBy(order).limit(100).select("id")
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in expected.collect())
    per_key = skew.smallest_n(df, order, "id", 5, by=["key"]).groupBy("key").count().collect()
    assert all(r["count"] == 5 for r in per_key)


def test_topic_levels_keep_level_multiplicity_and_end_cycles(spark):
    triples = spark.createDataFrame(
        [("a", "superTopicOf", "b"), ("a", "superTopicOf", "c"), ("b", "superTopicOf", "d"), ("c", "superTopicOf", "d"), ("d", "superTopicOf", "e"), ("a", "other", "x")],
        "start_id string, relationship string, end_id string",
    )
    rows = Counter((r.level, r.end_id) for r in graph.topic_levels(triples, "a").collect())
    assert rows == {(1, "b"): 1, (1, "c"): 1, (2, "d"): 2, (3, "e"): 1}
    cycle = triples.union(spark.createDataFrame([("e", "superTopicOf", "a")], triples.schema))
    assert sorted(r.end_id for r in graph.topic_closure(cycle, "a").collect()) == list("abcde")
    assert graph.topic_levels(cycle, "a", max_levels=7).select("level").distinct().count() == 7
    assert graph.topic_levels(triples, "nowhere").count() == 0


def test_id_spaces_rename_both_ends(spark):
    edges = graph.to_edges(spark.createDataFrame([(1, 2)], "a int, b int"), "a", "b", "CITES")
    assert graph.with_id_spaces(edges, START_ID="x", END_ID="y").columns == [":START_ID(x)", ":END_ID(y)", ":TYPE"]


@pytest.mark.parametrize("limits", [{}, {"max_bytes": 0, "rows_per_cell": 7}])
@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_similar_pairs_equal_all_pairs(spark, limits, threshold):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(12, 8))
    core = np.vstack([base + 0.2 * rnd.normal(size=base.shape), np.zeros((1, 8))])
    ext = np.vstack([base + 0.3 * rnd.normal(size=base.shape) for _ in range(4)])
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), where=np.linalg.norm(m, axis=1, keepdims=True) > 0, out=np.zeros_like(m))
    cos = unit(core) @ unit(ext).T
    expected = {(f"c{i}", f"e{j}") for i, j in zip(*np.nonzero(cos > threshold))}
    schema = "id string, vector array<double>"
    a = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(core)], schema)
    b = spark.createDataFrame([(f"e{j}", v.tolist()) for j, v in enumerate(ext)], schema)
    rows = similar_pairs(a, b, threshold, **limits).collect()
    assert len(rows) == len(expected) and {(r.core_id, r.ext_id) for r in rows} == expected
    assert similar_pairs(a, b, 1.5, **limits).count() == 0


@pytest.mark.parametrize("limits", [{}, {"max_alternatives": 0}, {"max_alternatives": 0, "max_bytes": 12}])
def test_substring_forms_are_leftmost_longest(spark, limits):
    patterns = ["a", "ab", "abc", "bcd", "cd", "net work", "c++", "d"]
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 40))) for _ in range(40)] + ["a net work in c++ abcd", "", None]
    finder = re.compile("|".join(re.escape(p) for p in sorted(patterns, key=len, reverse=True)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    rows = substring_hits(docs, "doc", "text", spark.createDataFrame([(p,) for p in patterns], "keyword string"), **limits).collect()
    assert {r.doc: r.hits for r in rows} == {i: finder.findall(t or "") for i, t in enumerate(texts)}


def test_lemmas_and_stop_words(spark):
    docs = spark.createDataFrame([(1, "The models models, of Things"), (2, "")], "id long, text string")
    lemmas = spark.createDataFrame([("models", "model"), ("Things", "thing")], "word string, lemma string")
    rows = {r.id: r.text for r in clean_sample(docs, "id", "text", lemmas).collect()}
    assert rows == {1: "the model models, thing", 2: ""}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def brute_keywords(value):
    sents = [[w for w in s.replace(",", " ").split() if re.search("[a-zA-Z]", w)] for s in re.split("[.!?]+", value)]
    sents = [s for s in sents if s]
    low = [[w.lower() for w in s] for s in sents]
    tf = Counter(w for s in low for w in s)
    where, up, cap = defaultdict(set), Counter(), Counter()
    left, right = defaultdict(Counter), defaultdict(Counter)
    for n, (s, words) in enumerate(zip(low, sents)):
        for i, t in enumerate(s):
            where[t].add(n)
            up[t] += len(words[i]) > 1 and words[i].upper() == words[i]
            cap[t] += i > 0 and "A" <= words[i][0] <= "Z"
            for o in s[max(0, i - 5) : i]:
                left[t][o] += 1
                right[o][t] += 1
    content = [n for t, n in tf.items() if t not in ENGLISH_STOP_WORDS]
    spread = sum(content) / len(content) + pstdev(content)
    score = {}
    for t, n in tf.items():
        around = sum(len(c) / sum(c.values()) for c in (left[t], right[t]) if c)
        rel = 1 + around * n / max(tf.values())
        case = max(up[t], cap[t]) / (1 + math.log(n))
        pos = math.log(math.log(3 + median(where[t])))
        score[t] = rel * pos / (case + n / spread / rel + len(where[t]) / len(sents) / rel)
    runs = Counter(
        tuple(s[i : i + n]) for s in low for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i] not in ENGLISH_STOP_WORDS and s[i + n - 1] not in ENGLISH_STOP_WORDS
    )
    ranked = sorted((round(math.prod(score[t] for t in r) / (n * (1 + sum(score[t] for t in r))), 9), " ".join(r)) for r, n in runs.items())
    taken = []
    for s, phrase in ranked:
        if len(taken) < 10 and all(1 - levenshtein(phrase, p) / max(len(phrase), len(p)) <= 0.2 for _, p in taken):
            taken.append((s, phrase))
    return taken


def test_keyphrases_equal_brute_force(spark):
    texts = [
        "Deep neural networks learn features. Neural networks need data, and deep networks need GPU time! Does the Markov model need data?",
        "Graph search. Graph search of the web graph is slow; fast search of Graphs wins.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    terms = keyphrase.term_scores(keyphrase.term_statistics(docs, "doc", "text"), "doc")
    best = keyphrase.distinct_best(keyphrase.phrase_scores(keyphrase.candidate_phrases(docs, "doc", "text"), terms, "doc"), "doc")
    for r in best.collect():
        expected = brute_keywords(re.sub(r"[^a-zA-Z0-9- .,!?]", "", texts[r.doc]))
        assert [k.keyword for k in r.keywords] == [p for _, p in expected]
        assert [k.score for k in r.keywords] == pytest.approx([s for s, _ in expected], abs=1e-8)
    whole = keyphrase.analysed(docs, "doc", "text", "phrases").withColumn("keywords", keyphrase.best_of("phrases"))
    assert {r.doc: r.keywords for r in whole.collect()} == {r.doc: r.keywords for r in best.collect()}
    plan = keyphrase.extract_keywords(docs, "doc", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_extraction_handles_empty_and_options(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "Neural models. Neural models work.")], "doc long, text string")
    rows = {r.doc: r.keywords for r in keyphrase.extract_keywords(docs, "doc", "text").collect()}
    assert rows[1] == [] and rows[2] == [] and rows[3]
    chunked = docs.withColumn("chunks", F.array(F.lit("the neural models")))
    lemmas = spark.createDataFrame([("models", "model")], "word string, lemma string")
    kept = keyphrase.extract_keywords(chunked, "doc", "text", chunks="chunks", lemmas=lemmas).where("doc = 3").first().keywords
    assert kept and all("work" not in k.keyword and "models" not in k.keyword for k in kept)


def test_merged_dictionary_prefers_core_and_ids_are_gap_free(spark):
    core = spark.createDataFrame([("deep net", "task", 0), ("graph", "cso", 1)], "keyword string, source string, trie_id long")
    ext = spark.createDataFrame([("graph", "task", "deep net"), ("nets", "task", "x"), ("nets", "cso", "x")], "keyword string, source string, core_keyword string")
    rows = sorted(dic.merged_dictionary(core, ext).collect(), key=lambda r: r.trie_id)
    assert [(r.keyword, r.source, r.dict, r.trie_id) for r in rows] == [("deep net", "task", "core", 0), ("graph", "cso", "core", 1), ("nets", "cso", "extended", 2)]
    assert dic.extended_dictionary(spark.createDataFrame([], "keyword string, source string, core_keyword string, cos double"), 0.9).count() == 0


def test_long_topic_chain_is_not_cut_and_a_cycle_raises(spark):
    chain = [(f"t{i}", "superTopicOf", f"t{i + 1}") for i in range(60)]
    df = spark.createDataFrame(chain, "start_id string, relationship string, end_id string")
    assert graph.topic_closure(df, "t0").count() == 60
    cycle = spark.createDataFrame([("a", "superTopicOf", "b"), ("b", "superTopicOf", "a")], df.schema)
    with pytest.raises(ValueError, match="cycle"):
        graph.topic_levels(cycle, "a")


def test_similarity_forms_agree_on_odd_vectors(spark):
    from termweave.operators.similarity import similar_pairs

    core = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("m", [None, 1.0])], "id string, vector array<double>")
    ext = spark.createDataFrame([("b", [1.0, 1.0]), ("z", [0.0, 0.0]), ("n", None), ("l", [1.0, 1.0, 1.0]), ("o", [-1.0, 0.0])], "id string, vector array<double>")
    for limit in (1 << 20, 0):
        found = {(r.core_id, r.ext_id) for r in similar_pairs(core, ext, -0.5, max_bytes=limit).collect()}
        assert found == {("a", "b")}


def test_lemma_table_with_repeated_words(spark):
    from termweave.operators.lemma import lemmatise

    df = spark.createDataFrame([(1, ["models", "run"])], "id int, words array<string>")
    lemmas = spark.createDataFrame([("models", "model"), ("models", "model"), ("models", "modelo")], "word string, lemma string")
    assert lemmatise(df, "words", lemmas).first().words == ["model", "run"]


def test_text_classifier_learns_and_scores_by_its_coefficients(spark):
    rows = [(i, ("good fine text " if i % 2 else "bad poor text ") + f"word{i % 5}", i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows + [(100, None, 0), (101, "unknown", 0)], "id long, text string, label int")
    phrases = spark.createDataFrame([(p, i) for i, p in enumerate(["good", "bad", "fine text", "poor text", "never met"])], "keyword string, trie_id long")
    vocab = tfidf.vocabulary(phrases)
    model = models.fit_text_classifier(docs, "id", "text", "label", vocab)
    scored = {r.id: r for r in models.score_texts(model, docs, "id", "text", vocab).collect()}
    assert all(scored[i].prediction == label for i, _, label in rows)
    intercept = 1 / (1 + math.exp(-model.intercept))
    assert scored[100].probability == pytest.approx(intercept) and scored[101].probability == pytest.approx(intercept)


def test_cells_are_visited_where_they_can_hold_a_pair(spark):
    """Clustered vectors: a visitor's copies are few, every pair is found, and a much visited cell is cut into runs."""
    import numpy as np

    from termweave.operators import similarity

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    vectors = [(centres[i % 40] + 0.05 * rng.normal(size=16)).tolist() for i in range(800)]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(vectors)], "id string, vector array<double>")
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = {(str(i), str(j)) for i, j in zip(*np.nonzero(unit @ unit.T > 0.95))}
    before = similarity.VISITS_PER_RUN
    try:
        for similarity.VISITS_PER_RUN in (before, 15):
            found = similarity.similar_pairs(df, df, 0.95, max_bytes=0, rows_per_cell=20).collect()
            assert len(found) == len(want) and {(r.core_id, r.ext_id) for r in found} == want
    finally:
        similarity.VISITS_PER_RUN = before
    tree = similarity.PivotTree(unit[:40])
    cell, away, to_root = tree.place(unit)
    low, high, root_high = np.full(40, np.inf), np.full(40, -np.inf), np.full(len(tree.roots), -np.inf)
    np.minimum.at(low, cell, away)
    np.maximum.at(high, cell, away)
    np.maximum.at(root_high, tree.root_of[cell], to_root)
    row, seen = tree.visits(unit, low, high, root_high, (2 - 2 * 0.95) ** 0.5)
    assert len(row) < 6 * len(unit) and len(set(zip(row.tolist(), seen.tolist()))) == len(row)


def test_rest_of_a_product_is_bounded():
    import numpy as np

    from termweave.operators.similarity import _pairs_above, _unit_rows

    rng = np.random.default_rng(7)
    a, b = (_unit_rows(rng.normal(size=(n, 32)) * np.linspace(3, 0.05, 32)) for n in (300, 500))
    ids_a, ids_b = np.array([str(i) for i in range(300)], object), np.array([str(i) for i in range(500)], object)
    for threshold in (-1.1, 0.2, 0.9, 0.99):
        found = {(x, y) for xs, ys, _ in _pairs_above(ids_a, a, ids_b, b, threshold) for x, y in zip(xs, ys)}
        assert found == {(str(i), str(j)) for i, j in zip(*np.nonzero(a @ b.T > threshold))}


def test_five_numbers_by_selection(spark, monkeypatch):
    import numpy as np

    from termweave.operators import compare

    rng = np.random.default_rng(8)
    groups = {"even": rng.normal(size=500), "wide": 10.0 ** rng.uniform(-200, 200, 400) * rng.choice([-1, 1], 400), "same": np.full(300, 2.5), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "ties": rng.integers(0, 4, 350).astype(float)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("even", None), ("none", None), ("even", float("nan"))]
    df = spark.createDataFrame(rows, "s string, v double").repartition(5)
    for ranked in (10_000, 60):
        monkeypatch.setattr(compare, "RANKED_ROWS", ranked)
        monkeypatch.setattr(compare, "RANGES", 1024)
        found = {r.s: list(r)[1:] for r in compare.five_numbers(df, "s", "v").collect()}
        assert found.keys() == groups.keys()
        for g, values in groups.items():
            assert found[g] == pytest.approx(np.quantile(values, [0, 0.25, 0.5, 0.75, 1]).tolist(), rel=1e-12)


def test_closure_takes_few_rounds_and_ends_in_cycles(spark, monkeypatch):
    rounds = []
    plain = graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: rounds.append(1) or plain(df))
    schema = "start_id string, relationship string, end_id string"
    chain = spark.createDataFrame([(f"t{i}", "superTopicOf", f"t{i + 1}") for i in range(5_000)], schema)
    assert graph.topic_closure(chain, "t0").count() == 5_000 and len(rounds) < 25
    edges = [("r", "a"), ("a", "b"), ("b", "c"), ("c", "b"), ("b", "d"), ("r", "d"), ("d", "e"), ("e", "r"), ("x", "y"), ("y", "x"), ("y", "e"), ("z", "q"), ("p", "p"), ("c", "q"), ("q", "s")]
    df = spark.createDataFrame([(a, "superTopicOf", b) for a, b in edges], schema)
    assert {r.end_id for r in graph.topic_closure(df, "r").collect()} == set("abcdeqsr")
    assert {r.end_id for r in graph.topic_closure(df, "p").collect()} == {"p"}
    assert graph.topic_closure(df, "nowhere").count() == 0


def test_fold_in_insertion_order(spark):
    from termweave.operators.dictionary import PhraseDictionary

    df = spark.createDataFrame([("Deep Net", 5, 2), ("deep net", 3, 1), ("deep-net", 10, 3), ("graph", 1, 4)], "keyword string, trie_id long, o long")
    built = PhraseDictionary.build(df, order="o", fold=lambda old, new: old * 2 - new)
    assert {r.phrase: r.value for r in built.entries.collect()} == {"deep net": (3 * 2 - 5) * 2 - 10, "graph": 1}
    with pytest.raises(ValueError):
        PhraseDictionary.build(df, fold=lambda a, b: a, combine=F.max)


def test_text_classifier_takes_the_same_steps_as_arrays(spark, monkeypatch):
    monkeypatch.setattr(models, "ROWS_PER_PIECE", 2)
    rows = [(i, "alpha beta" if i % 2 else "gamma beta", float(i % 2)) for i in range(9)] + [(9, None, 1.0), (10, "", 0.0), (11, "alpha", None)]
    docs = spark.createDataFrame(rows, "id long, text string, label double")
    vocab = tfidf.vocabulary(spark.createDataFrame([("alpha", 0), ("beta", 1), ("gamma", 2)], "keyword string, trie_id long"))
    model = models.fit_text_classifier(docs, "id", "text", "label", vocab, reg_param=0.1, steps=4)
    used = [r for r in rows if r[2] is not None]
    counts = np.array([[(r[1] or "").split().count(w) for w in ("alpha", "beta", "gamma")] for r in used], float)
    x = counts * (np.log((1 + len(used)) / (1 + (counts > 0).sum(axis=0))) + 1)
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = np.hstack([np.divide(x, length, out=np.zeros_like(x), where=length > 0), np.ones((len(used), 1))])
    y, w, v = np.array([r[2] for r in used]), np.zeros(4), np.zeros(4)
    flat = np.sqrt(0.1 / 0.6)
    for _ in range(4):
        slope = x.T @ (1 / (1 + np.exp(-x @ v)) - y) / len(used) + 0.1 * v * [1, 1, 1, 0]
        stepped = v - slope / 0.6
        w, v = stepped, stepped + (1 - flat) / (1 + flat) * (stepped - w)
    got = {r["phrase_id"]: r["weight"] for r in model.coefficients.collect()}
    assert np.allclose([got[0], got[1], got[2], model.intercept], w)


def test_text_classifier_without_rows(spark):
    docs = spark.createDataFrame([], "id long, text string, label double")
    vocab = tfidf.vocabulary(spark.createDataFrame([("alpha", 0)], "keyword string, trie_id long"))
    model = models.fit_text_classifier(docs, "id", "text", "label", vocab, steps=2)
    assert model.coefficients.count() == 0 and model.intercept == 0


def test_components_equal_those_of_the_array(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(60, 4)) * [5, 2, 1, 0.1] + 1000
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [1.0]), (103, [float("nan")] * 4), (104, [float("inf")] * 4)]
    df = spark.createDataFrame(rows, "id long, e array<double>").repartition(3)
    found = {(r["i"], r["j"]): r["covariance"] for r in models.covariance(df, "e").collect()}
    want = np.cov(points.T)
    assert len(found) == 16 and all(np.isclose(found[i + 1, j + 1], want[i, j]) for i in range(4) for j in range(4))
    placed, shares = models.principal_components(df, "id", "e")
    got = {r["id"]: (r["pc1"], r["pc2"]) for r in placed.collect()}
    values, vectors = np.linalg.eigh(want)
    ours = np.array([got[i] for i in range(60)])
    plain = (points - points.mean(axis=0)) @ vectors[:, ::-1][:, :2]
    assert np.allclose(np.abs(ours), np.abs(plain)) and np.allclose(shares, values[::-1][:2] / values.sum())
    assert all(got[i] == (None, None) for i in range(100, 105))
    assert models.covariance(df.limit(0), "e").count() == 0
    assert models.principal_components(df.limit(0), "id", "e")[1] == [0.0, 0.0]


@pytest.mark.parametrize("limits", [{}, {"max_alternatives": 0}, {"max_alternatives": 0, "max_bytes": 0}])
def test_scan_hands_columns_on(spark, limits):
    docs = spark.createDataFrame([(1, "a graph of graphs", "x"), (1, "none", None), (None, None, "y"), (2, "", "z")], "id long, text string, hits string")
    words = spark.createDataFrame([("graph",), ("graphs",)], "keyword string")
    found = substring_hits(docs, "id", "text", words, keep=["text"], **limits)
    assert sorted(((r.id, r.text, r.hits) for r in found.collect()), key=str) == sorted([(1, "a graph of graphs", ["graph", "graphs"]), (1, "none", []), (None, None, []), (2, "", [])], key=str)


def test_negative_documents_are_judged_row_by_row(spark):
    long = " ".join(["plain words of a text that goes on"] * 3)
    docs = spark.createDataFrame([(1, long, 7), (1, f"{long} graph theory", 8), (None, long, 9), (2, "short", 1)], "id long, text string, other int").withColumn("hits", F.lit(1))
    core = spark.createDataFrame([("graph theory",)], "keyword string")
    rows = dic.negative_documents(docs, "id", "text", core, max_hits=1).collect()
    assert sorted((r.other for r in rows)) == [7, 9] and rows[0].asDict().keys() == {"id", "text", "other", "hits"}
