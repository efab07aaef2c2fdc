import random

import pytest
from pyspark.sql import functions as F

from termweave.operators.dictionary import PhraseDictionary
from termweave.sources import store

CASES = [
    ("machine works", [1], [1, 1 / 2, 0.5, 0.5]),
    ("machine learning model", [2], [1, 1 / 3, 0.5, 0.5]),
    ("machine machine learning model", [1, 2], [2, 1 / 2, 0.5, 1.0]),
    ("machine learning rocks", [], [1, 1 / 3, 0.5, 0.5]),
    ("machine learning rate", [], [1, 1 / 3, 0.5, 0.5]),
    ("a learning-rate 2", [3], [0, 0, 0, 0]),
    ("", [], [0, 0, 0, 0]),
    (None, [], [0, 0, 0, 0]),
]


def walk(words, phrases):
    """Brute-force greedy walk: longest prefix from each visited start."""
    prefixes = {tuple(p[:i]) for p in phrases for i in range(1, len(p) + 1)}
    terminal = {tuple(p) for p in phrases}
    hits, start = [], 0
    while start < len(words):
        longest = 0
        while start + longest < len(words) and tuple(words[start : start + longest + 1]) in prefixes:
            longest += 1
        if tuple(words[start : start + longest]) in terminal:
            hits.append((start, " ".join(words[start : start + longest])))
        start += max(1, longest)
    return hits


@pytest.fixture(scope="module")
def small(spark):
    df = spark.createDataFrame(
        [("machine", 1, 0.5), ("Machine  learning-model", 2, 0.9), ("learning rate", 3, 0.7), ("12", 4, 1.0)],
        "keyword string, trie_id long, weight double",
    )
    return PhraseDictionary.build(df, weight="weight")


@pytest.mark.parametrize("max_prefixes", [1000, 3])
def test_hand_made_cases(spark, small, max_prefixes):
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "doc long, text string")
    found = {r.doc: [h.value for h in r.hits] for r in small.search(docs, "doc", "text", max_prefixes=max_prefixes).collect()}
    single = {r.doc: list(r)[1:] for r in small.word_metrics(docs, "doc", "text", max_prefixes=max_prefixes).collect()}
    for i, (_, values, metrics) in enumerate(CASES):
        assert found[i] == values
        assert single[i] == pytest.approx(metrics)


@pytest.mark.parametrize("seed", [1, 2])
def test_both_forms_equal_a_walk(spark, seed):
    rnd = random.Random(seed)
    letters = "abcd"
    phrases = list({tuple(rnd.choice(letters) for _ in range(rnd.randint(1, 4))) for _ in range(30)})
    texts = [[rnd.choice(letters + "xyz") for _ in range(rnd.randint(0, 60))] for _ in range(80)]
    d = spark.createDataFrame([(" ".join(p), i, i / 10) for i, p in enumerate(phrases)], "keyword string, trie_id long, weight double")
    dictionary = PhraseDictionary.build(d, weight="weight")
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc long, text string")
    arrow = dictionary.search(docs, "doc", "text")
    joined = dictionary.search(docs, "doc", "text", max_prefixes=15)
    expected = {i: walk(t, phrases) for i, t in enumerate(texts)}
    for form in (arrow, joined):
        rows = {r.doc: r for r in form.collect()}
        assert {k: [(h.pos, h.phrase) for h in r.hits] for k, r in rows.items()} == expected
        assert {k: r.n_words for k, r in rows.items()} == {i: len(t) for i, t in enumerate(texts)}
    overlapping = [
        dictionary.search(docs, "doc", "text", overlapping=True, max_prefixes=m).collect() for m in (1000, 15)
    ]
    every = {
        i: sorted(
            (s, n, " ".join(t[s : s + n])) for s in range(len(t)) for n in range(1, 5) if tuple(t[s : s + n]) in set(phrases) and s + n <= len(t)
        )
        for i, t in enumerate(texts)
    }
    for rows in overlapping:
        assert {r.doc: [(h.pos, h.n, h.phrase) for h in r.hits] for r in rows} == every


@pytest.mark.parametrize("max_prefixes", [1000, 3])
def test_list_search_keeps_elements_apart(spark, small, max_prefixes):
    docs = spark.createDataFrame([(1, ["machine learning", "model", "learning rate"]), (2, [])], "doc long, texts array<string>")
    rows = {r.doc: r for r in small.search_list(docs, "doc", "texts", max_prefixes=max_prefixes).collect()}
    assert [h.phrase for h in rows[1].hits] == ["learning rate"]
    assert rows[1].n_words == 5 and rows[2].hits == []


def test_mean_times_count_is_total(spark, small):
    docs = spark.createDataFrame([(1, "machine machine learning model learning rate"), (2, "none")], "doc long, text string")
    for r in small.search_metrics(docs, "doc", "text").collect():
        assert r.mean_weight * r.n_hits == pytest.approx(r.total_weight)


def test_last_insertion_wins_and_empty_phrases_drop(spark):
    d = spark.createDataFrame([("a b", 1), ("A-b", 2), ("!!", 3)], "keyword string, trie_id long")
    entries = PhraseDictionary.build(d).entries.collect()
    assert [(e.phrase, e.value) for e in entries] == [("a b", 2)]


def test_phrase_ids_are_depth_first(spark):
    d = spark.createDataFrame(
        [("b", 0), ("a c", 1), ("a", 2), ("b a", 3), ("a b", 4)], "keyword string, trie_id long"
    )
    rows = PhraseDictionary.build(d).phrase_ids().orderBy("phrase_id").collect()
    assert [r.phrase for r in rows] == ["b", "b a", "a", "a c", "a b"]
    assert [r.phrase_id for r in rows] == list(range(5))
    counts = PhraseDictionary.build(d).counts().first()
    assert (counts.nodes, counts.phrases) == (6, 5)


def test_matrix_counts_texts_and_lists(spark, small):
    texts = spark.createDataFrame([(1, "machine works machine learning model")], "doc long, text string")
    lists = spark.createDataFrame([(1, ["machine", "other", "machine"])], "doc long, text array<string>")
    names = {r.phrase_id: r.phrase for r in small.phrase_ids().collect()}
    got = {names[r.phrase_id]: r.n for r in small.document_matrix(texts, "doc", "text").collect()}
    assert got == {"machine": 1, "machine learning model": 1}
    got = {names[r.phrase_id]: r.n for r in small.document_matrix(lists, "doc", "text").collect()}
    assert got == {"machine": 2}


def test_argument_checks(spark, small):
    docs = spark.createDataFrame([(1, 2)], "doc long, text long")
    plain = PhraseDictionary.build(spark.createDataFrame([("a", 1)], "keyword string, trie_id long"))
    with pytest.raises(ValueError):
        plain.search_metrics(docs, "doc", "text")
    with pytest.raises(ValueError):
        small.document_matrix(docs, "doc", "text")
    with pytest.raises(ValueError):
        PhraseDictionary.build(docs, phrase="doc", value="text")
    with pytest.raises(ValueError):
        PhraseDictionary.build(spark.createDataFrame([("a", 1)], "keyword string, trie_id long"), weight="weight")
    assert PhraseDictionary.build_optional(None) is None


def test_match_needs_the_exact_phrase(spark, small):
    docs = spark.createDataFrame([("machine",), ("Learning, rate",), ("learning",)], "text string")
    rows = {r.text: r.matched for r in small.match(docs, "text").collect()}
    assert rows == {"machine": True, "Learning, rate": True, "learning": False}


@pytest.mark.parametrize("max_prefixes", [1000, 3])
@pytest.mark.parametrize("lists", [False, True])
def test_odd_rows_are_the_same_however_the_dictionary_is_cut(spark, small, max_prefixes, lists):
    rows = [(None, "machine"), (None, "machine"), (7, "machine"), (7, "learning rate"), (8, None), (9, ""), (None, None)]
    docs = spark.createDataFrame([(k, ([t] if lists else t) if t is not None else None) for k, t in rows], f"doc long, text {'array<string>' if lists else 'string'}")
    search = small.search_list if lists else small.search
    found = sorted(((r.doc or 0, r.n_words, [h.value for h in r.hits]) for r in search(docs, "doc", "text", max_prefixes=max_prefixes).collect()))
    assert found == [(0, 0, []), (0, 1, [1]), (0, 1, [1]), (7, 1, [1]), (7, 2, [3]), (8, 0, []), (9, 0, [])]


def test_an_empty_dictionary_finds_nothing(spark):
    empty = PhraseDictionary.build(spark.createDataFrame([], "keyword string, trie_id long, weight double"), weight="weight")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc long, text string")
    assert sorted((r.doc, r.n_words, r.hits) for r in empty.search(docs, "doc", "text").collect()) == [(1, 2, []), (2, 0, [])]
    lists = spark.createDataFrame([(1, ["a b", "c"])], "doc long, text array<string>")
    assert empty.search_list(lists, "doc", "text").first().n_words == 3
    assert {tuple(r) for r in empty.word_metrics(docs, "doc", "text").collect()} == {(1, 0, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0)}


def test_lemmas_meet_in_phrases_and_texts(spark):
    lemmas = spark.createDataFrame([("models", "model"), ("models", "modelx"), ("Rates", "rate"), (None, "a")], "word string, lemma string")
    d = spark.createDataFrame([("learning models", 1), ("rate", 2)], "keyword string, trie_id long")
    dictionary = PhraseDictionary.build(d, lemmas=lemmas)
    texts = ["learning model", "learning models", "learning models, Rates", "rates"]
    docs = spark.createDataFrame([(1, t) for t in texts] + [(2, None)], "doc long, text string")
    values = sorted((r.n_words, [h.value for h in r.hits]) for r in dictionary.search(docs, "doc", "text").collect())
    # "models," is looked up with its comma and "rates" in its own case, so neither has a lemma.
    assert values == [(0, []), (1, []), (2, [1]), (2, [1]), (3, [2])]
    lists = spark.createDataFrame([(1, ["learning", "models Rates", None])], "doc long, text array<string>")
    assert [h.value for h in dictionary.search_list(lists, "doc", "text").first().hits] == [2]
    assert {(r.text, r.matched) for r in dictionary.match(docs, "text").collect()} >= {("learning model", True), ("rates", False)}


def test_values_of_equal_phrases_combine(spark):
    d = spark.createDataFrame([("a b", 5, 1), ("A-b", 2, 2)], "keyword string, trie_id long, at long")
    for combine, value in ((None, 2), (F.max, 5), (F.sum, 7)):
        assert [e.value for e in PhraseDictionary.build(d, order="at", combine=combine).entries.collect()] == [value]


def test_stored_prefixes_keep_weights_and_insertions(spark, small, tmp_path):
    rows = [("machine", 1, 0.5, "core", "x"), ("machine", 9, 0.1, "core", "y"), ("learning rate", 3, 0.7, "core", "x")]
    store.save_store(spark.createDataFrame(rows, "keyword string, trie_id long, weight double, dict string, source string"), str(tmp_path / "s"), weight="weight")
    loaded = PhraseDictionary.from_prefixes(store.load_part(spark, str(tmp_path / "s")), weighted=True)
    assert {(e.phrase, e.value, e.weight, e.ord, e.last_ord) for e in loaded.entries.collect()} == {("machine", 9, 0.1, 1, 9), ("learning rate", 3, 0.7, 3, 3)}


def test_large_dictionary_is_filtered_in_one_pass(spark, small):
    """One scan of the texts whatever the dictionary's size; the filter never drops a key, and the join takes out what it lets through."""
    from termweave.operators.membership import KeyFilter, text_hashes

    docs = spark.createDataFrame([(i, "machine learning model and learning rate") for i in range(50)], "doc long, text string")
    found = small.search(docs, "doc", "text", max_prefixes=1)
    assert {tuple(h.phrase for h in r.hits) for r in found.collect()} == {("machine learning model", "learning rate")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    keys = spark.range(5_000).selectExpr("cast(id as string) AS k")
    held = KeyFilter.of(keys, lambda b: text_hashes(b.column("k")), 5_000)
    import pyarrow as pa

    assert held.may_hold(text_hashes(pa.array([str(i) for i in range(5_000)]))).all()
    assert held.may_hold(text_hashes(pa.array([f"x{i}" for i in range(5_000)]))).mean() < 0.2
