"""Forms that keep work and memory in proportion to large inputs give the same rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termweave.catalog import QUERIES
from termweave.functions.text import dictionary_words, extraction_clean, fulltext_clean
from termweave.functions.vectors import trigram_vector
from termweave.operators import keyphrase, models, patterns, scan, similarity, tfidf, words
from termweave.operators.dictionary import PhraseDictionary
from termweave.plans import bibliography as bib
from termweave.plans import dictionaries
from termweave.operators.edits import Texts, distance


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distances():
    draw = random.Random(1)
    texts = ["".join(draw.choice("abcé") for _ in range(draw.choice([0, 1, 2, 20, 63, 64, 65, 255, 257]))) for _ in range(60)]
    pairs = [(draw.randrange(60), draw.randrange(60)) for _ in range(200)]
    found = Texts(texts).distances(*np.array(pairs).T)
    expected = [plain_distance(texts[i], texts[j]) for i, j in pairs]
    assert found.tolist() == expected == [distance(texts[i], texts[j]) for i, j in pairs]


def test_phrase_scores_need_no_exchange_and_equal_the_joins(spark):
    """only rows that share a key move; they count as one document, as in the joins."""
    rows = [(1, "Graph search is slow. Fast graph search wins."), (2, "Deep nets learn features, and nets need data."), (3, "Graph search. Deep nets."), (3, "Graph search. Deep nets."), (None, "Lost words here."), (4, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    once = docs.where("id < 3")
    assert "Exchange" not in plan(keyphrase.scored_phrases(once, "id", "text")) and "Exchange" not in plan(keyphrase.scored_terms(once, "id", "text"))
    terms = keyphrase.term_scores(keyphrase.term_statistics(docs, "id", "text"), "id")
    joined = keyphrase.phrase_scores(keyphrase.candidate_phrases(docs, "id", "text"), terms, "id")

    def shown(df):
        return sorted(map(str, df.withColumn("score", F.round("score", 9)).collect()))

    assert shown(keyphrase.scored_phrases(docs, "id", "text")) == shown(joined)
    assert shown(keyphrase.scored_terms(docs, "id", "text")) == shown(terms)


def test_keywords_are_chosen_where_the_text_is_read(spark):
    """The same choice as `best_of`, without its comparisons in expressions, also with equal scores and long words."""
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.choice([3, 5, 9, 70]))) for _ in range(150)]
    texts = [" ".join(draw.choice(words) + draw.choice(["", "", "", ".", ","]) for _ in range(n)) for n in (0, 1, 5, 60, 400, 900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    expected = keyphrase.analysed(docs, "id", "text", "phrases").select("id", keyphrase.best_of("phrases").alias("keywords"))
    found = keyphrase.analysed(docs, "id", "text", "keywords")
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    assert "levenshtein" not in plan(keyphrase.extract_keywords(docs, "id", "text"))


def test_rounding_equals_spark(spark):
    draw = random.Random(3)
    values = [draw.random() * 10.0 ** draw.randrange(-9, 9) for _ in range(500)] + [0.5e-9, 1.5e-9, 0.0000000125, 2.0**60, 0.0, 1234567.0000000005]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", F.round("v", 9).alias("r")).collect()
    assert keyphrase._rounded(np.array([r.v for r in rows])).tolist() == [r.r for r in rows]


def test_texts_are_cleaned_as_the_expression_does(spark):
    odd = [None, "", " \t Über-Straße ﬁn ½ ① \x1c https://x.y/z?\x1da b http://q end \n", "a\x00b\x85 c,d.!?-_é漢字 K̊", "\x1c keeps \x1f", "https://only"]
    docs = spark.createDataFrame([(t,) for t in odd], "t string")
    assert [keyphrase._plain(t) for t in odd] == [r.p for r in docs.select(extraction_clean("t").alias("p")).collect()]


def test_batches_are_searched_in_bounded_parts(monkeypatch):
    """A batch is cut by its bytes or words; before, all of it was searched at once."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([["a"] * n for n in (3, 0, 9, 1, 1, 0, 2)])], names=["id", "words"])
    monkeypatch.setattr(scan, "WORDS_AT_ONCE", 4)
    parts = list(scan._word_parts(iter([batch, batch.slice(0, 0)])))
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(7)) and len(parts) == 2
    sizes = [sum(map(len, p.column("words").to_pylist())) for p in parts]
    assert all(n < 4 + max(map(len, p.column("words").to_pylist())) for n, p in zip(sizes, parts, strict=True))


def test_hits_do_not_depend_on_the_parts(spark, monkeypatch):
    texts = ["deep neural nets", None, "", "a neural graph of deep neural nets deep", "naïve graph search"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    words = spark.createDataFrame([(w, i) for i, w in enumerate(["deep neural nets", "neural", "graph", "graph search", "naïve"])], "keyword string, trie_id long")
    dictionary = PhraseDictionary.build(words)

    def found():
        rows = [patterns.substring_hits(docs, "id", "text", words, max_alternatives=0), *(dictionary.search(docs, "id", "text", max_prefixes=n) for n in (100, 1))]
        return [sorted(map(str, r.collect())) for r in rows]

    whole = found()
    assert whole[1] == whole[2]
    monkeypatch.setattr(patterns, "BLOCK_BYTES", 5)
    monkeypatch.setattr(scan, "WORDS_AT_ONCE", 2)
    assert found() == whole


def test_trigram_vectors_are_made_once_per_batch(spark):
    """no expression per slot and trigram."""
    texts = ["abc", "ABC", "", None, "naïve K", "aaaaaaa"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string").select("t", trigram_vector("t").alias("v"))
    assert "md5" not in plan(docs)
    for r in docs.collect():
        if r.t is None:
            assert r.v == [None] * 64
            continue
        padded, counts = f"  {r.t.lower()}  ", [0.0] * 64
        for i in range(len(padded) - 2):
            h = int(hashlib.md5(padded[i : i + 3].encode()).hexdigest()[:7], 16)
            counts[h % 64] += -1.0 if h // 64 % 2 else 1.0
        length = math.sqrt(sum(c * c for c in counts))
        assert r.v == [c / length if length else 0.0 for c in counts]


def test_alternatives_share_their_beginnings(spark):
    """as one alternation, longest first, but equal beginnings are tried once."""
    draw = random.Random(4)
    assert patterns._alternation(["abc", "abd", "ab", "x.y"]) == "a(?:b(?:c|d)?)|x\\.y"
    for _ in range(300):
        words = list({"".join(draw.choice("ab.") for _ in range(draw.randrange(1, 5))) for _ in range(draw.randrange(1, 8))})
        text = "".join(draw.choice("ab.c") for _ in range(30))
        plain = "|".join(patterns._quoted(w) for w in sorted(words, key=lambda w: (-len(w), w)))
        assert re.findall(plain, text) == re.findall(patterns._alternation(words), text)


def test_best_similar_leaves_one_row_per_keyword_and_source(spark):
    """the sweep counts the same without a row for each pair; null names, null sources, repeated and odd rows included."""
    draw = random.Random(5)
    vectors = [[draw.gauss(0, 1) for _ in range(4)] for _ in range(40)]
    core = [(f"k{i}" if i else None, ["cso", "method", "task", None][i % 4], v) for i, v in enumerate(vectors[:24])] + [("k1", "task", vectors[30]), ("k2", "cso", None)]
    ext = [(f"K{i}" if i != 5 else None, v) for i, v in enumerate(vectors)] + [("K7", vectors[31]), ("K8", [0.0] * 4), ("K9", None)]
    core = spark.createDataFrame(core, "keyword string, source string, embedding array<double>")
    ext = spark.createDataFrame(ext, "keyword string, embedding array<double>").coalesce(1)
    order = ("cso", "method", "task")

    def swept(similar):
        return sorted(map(str, similarity.threshold_sweep(similar, [0.3, 0.6, 0.9], order).collect()))

    pairs, best = similarity.similar_keywords(core, ext, 0.3), similarity.best_similar(core, ext, 0.3)
    assert swept(best) == swept(pairs) == swept(similarity.best_similar(core, ext, 0.3, max_bytes=0))
    assert best.count() < pairs.count() and best.count() <= 4 * 40 + 4


def test_papers_without_a_work_do_not_meet_in_one_task(spark):
    """null keys of a left join were one partition."""
    papers = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 8 == 0, F.col("id").cast("string")).alias("openalex_id"))
    works = spark.range(0, 4000, 16).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = bib.with_works(papers, works)
        rows = joined.withColumn("p", F.spark_partition_id()).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert joined.columns == ["id", "openalex_id", "id_openalex", "title"]
    assert sorted((r.id, r.title) for r in rows) == sorted((str(i), None if i % 16 else "t") for i in range(4000))
    assert max(Counter(r.p for r in rows).values()) < 1600


def test_fulltext_steps_are_computed_once(spark):
    """the cleaned words stood in the plan once for each use."""
    docs = spark.createDataFrame([(None,), ("short",), ("x " * 200,), ("word " * 120 + "introduction " + "body text here " * 60,)], "t string")
    cleaned = docs.select(fulltext_clean("t").alias("c"))
    assert plan(cleaned).count("regexp_replace(lower(") == 1
    assert [r.c and r.c[:9] for r in cleaned.collect()] == [None, None, None, "body text"]


def _named(spark, n, times=1):
    rng = np.random.default_rng(3)
    rows = [(f"k{i}", ["cso", None][i % 2], rng.normal(size=8).tolist()) for i in range(n)]
    core = spark.createDataFrame([(k, s, rng.normal(size=8).tolist() if t else v) for k, s, v in rows for t in range(times)], "keyword string, source string, embedding array<double>")
    ext = spark.createDataFrame([(k.upper(), v) for k, _, v in rows for _ in range(times)], "keyword string, embedding array<double>")
    return core, ext


def _by_hand(core, ext, threshold):
    best = {}
    for k, s, v in core.collect():
        for e, w in ext.collect():
            cos = float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
            if cos > threshold and e.lower() != k:
                best[e.lower(), s, k] = max(best.get((e.lower(), s, k), -2.0), cos)
    return {k: round(v, 9) for k, v in best.items()}


@pytest.mark.parametrize("limits", [{}, {"max_bytes": 0, "rows_per_cell": 5}])
@pytest.mark.parametrize("times", [1, 2])
def test_similar_keywords_move_no_pair_of_unique_names(spark, limits, times):
    core, ext = _named(spark, 40, times)
    found = similarity.similar_keywords(core, ext, 0.2, **limits)
    rows = found.collect()
    assert {(r.keyword, r.source, r.core_keyword): round(r.cos, 9) for r in rows} == _by_hand(core, ext, 0.2) and len(rows) == len(_by_hand(core, ext, 0.2))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("Aggregate [keyword" in plan) == (times == 2)


def test_crowded_cells_are_met_in_shards(spark, monkeypatch):
    """A visitor of many cells is sent once for each shard, not once for each cell."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(str(i), rng.normal(size=16).tolist()) for i in range(300)], "id string, vector array<double>")
    seen = {}
    for size in (0, 150):
        monkeypatch.setattr(similarity, "SHARD_ROWS", size)
        dealt = spark.sparkContext.accumulator(0)
        plain = similarity._streamed

        def counted(threshold):
            inner = plain(threshold)

            def run(batches):
                def told():
                    for b in batches:
                        dealt.add(b.num_rows)
                        yield b

                yield from inner(told())

            return run

        monkeypatch.setattr(similarity, "_streamed", counted)
        seen[size] = {(r.core_id, r.ext_id) for r in similarity.similar_pairs(df, df, 0.1, max_bytes=0, rows_per_cell=10).collect()}, dealt.value
        monkeypatch.setattr(similarity, "_streamed", plain)
    assert seen[0][0] == seen[150][0] and seen[150][0]
    assert seen[150][1] < 300 * 5 < seen[0][1]


def test_joined_scan_moves_a_run_once_for_each_part(spark):
    """the words of a part that are equal are one row of the join; all rows, keys and hits stay."""
    words = [(i % 3 if i % 4 else None, (["the", "deep", "net", "of", "deep", "sea"] * 5)[: i % 31] if i % 7 else None) for i in range(60)]
    rows = spark.createDataFrame(words, "id long, words array<string>").coalesce(1)
    phrases = spark.createDataFrame([("deep net", 1, 0.5), ("deep", 2, 0.25), ("the deep sea", 3, None), ("of deep", 4, 1.0)], "keyword string, trie_id long, weight double")
    vocab = PhraseDictionary.build(phrases, weight="weight")
    for overlapping in (False, True):
        small = scan.phrase_hits(rows, "id", vocab, overlapping)
        large = scan.phrase_hits(rows, "id", vocab, overlapping, max_prefixes=0)
        assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert sorted(map(str, scan.phrase_sums(rows, "id", vocab).collect())) == sorted(map(str, scan.phrase_sums(rows, "id", vocab, max_prefixes=0).collect()))
    present = rows.select("id", F.lit(0).cast("long").alias("n_words"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    table = vocab.prefixes.select("prefix", "depth", "is_terminal", "value", "weight")
    sent = scan._candidates(present, table, vocab.size(), "greedy").where("n > 0").collect()
    assert len(sent) <= 6 and not [r for r in sent if r.prefix in ("the", "of")]  # 900 runs before, "the" and "of" among them


def test_linear_scores_read_the_texts_once(spark):
    """one scan gives counts, document frequencies and scores; a phrase is counted where its text is read."""
    texts = [(i if i != 3 else None, None if i == 5 else " ".join(["deep", "net", "deep", "sea"][: i % 5] * 3)) for i in range(20)] + [(4, "net sea")]
    read = spark.sparkContext.accumulator(0)

    def told(text):
        read.add(1)
        return text

    docs = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    watched = docs.withColumn("text", F.udf(told, "string")("text"))
    vocab = tfidf.vocabulary(spark.createDataFrame([("deep", 0), ("net", 1), ("deep net", 2), ("sea", 3)], "keyword string, trie_id long"))
    coefficients = spark.createDataFrame([(0, 1.0), (2, -0.5)], "phrase_id long, weight double")
    found = models.linear_scores(tfidf.tfidf(watched, "id", "text", vocab), "id", coefficients, 0.25, vocab)
    plain = models.linear_scores(tfidf.tfidf(docs, "id", "text", vocab, max_prefixes=0), "id", coefficients, 0.25)
    by_id = [{r.id: round(r.probability, 9) for r in x.collect()} for x in (found, plain)]
    assert by_id[0] == by_id[1] and len(by_id[0]) > 10
    assert read.value == len(texts)
    counts = tfidf.term_counts(docs, "id", "text", vocab)
    assert "_counted" in plan(counts)


def test_classifier_forms_agree(spark, monkeypatch):
    """with a small vocabulary a step sends the coefficients and sums slopes in the tasks; repeated and null keys, missing labels."""
    texts = [(i % 17 if i % 9 else None, " ".join(["deep", "net", "deep", "sea"][: i % 5] * 3), [0, 1, None][i % 3]) for i in range(40)]
    docs = spark.createDataFrame(texts, "id long, text string, label int")
    vocab = tfidf.vocabulary(spark.createDataFrame([("deep", 0), ("net", 10), ("deep net", 2), ("sea", 7), ("never", 9)], "keyword string, trie_id long"))
    found = []
    for joined in (False, True):
        steps, taken = models._gradient_step, []
        monkeypatch.setattr(models, "_gradient_step", lambda *a, steps=steps, taken=taken: taken.append(1) or steps(*a))
        if joined:
            monkeypatch.setattr(type(vocab.size()), "fits", lambda *a: False)
        model = models.fit_text_classifier(docs, "id", "text", "label", vocab, steps=4)
        scored = models.score_texts(model, docs, "id", "text", vocab)
        found.append((round(model.intercept, 9), sorted((r.phrase_id, round(r.weight, 9)) for r in model.coefficients.collect()), sorted((str(r.id), round(r.probability, 9)) for r in scored.collect())))
        monkeypatch.undo()
        assert len(taken) == (4 if joined else 0)
    assert found[0] == found[1] and found[0][1]


def test_negative_keywords_are_found_once(spark):
    """both sides of the split take the same negative keywords, whose texts are searched once."""
    read = spark.sparkContext.accumulator(0)

    def told(word):
        read.add(1)
        return word

    dictionary = spark.createDataFrame([("deep", 1), ("net", 2), (None, 3)], "keyword string, n long")
    negative = spark.createDataFrame([("net",), (None,), ("net",)], "keyword string").coalesce(1).select(F.udf(told, "string")("keyword").alias("keyword"))
    kept, removed = dictionaries.split_by_negative(dictionary, negative)
    assert sorted(r.n for r in kept.collect()) == [1, 3] and [r.n for r in removed.collect()] == [2]
    assert read.value == 3


def test_pattern_lengths_are_looked_up_only_behind_their_beginnings(monkeypatch):
    """a place is tested for the lengths of the patterns that begin as it does, also with more lengths than bits."""
    draw = random.Random(8)
    heads = ["".join(draw.choice("abcd") for _ in range(4)) for _ in range(40)]
    words = sorted({draw.choice(heads) + "".join(draw.choice("ab") for _ in range(n)) for n in range(90) for _ in range(3)})
    index = patterns.PatternIndex(pa.array(words))
    texts = [" ".join(draw.choice(words) if draw.random() < 0.3 else draw.choice(heads) + draw.choice("cd") * 100 for _ in range(40)) for _ in range(5)]
    hashed = []
    plain_hashes = patterns.Windows.hashes
    monkeypatch.setattr(patterns.Windows, "hashes", lambda self, at, length: hashed.append(len(at)) or plain_hashes(self, at, length))
    found = index.search(pa.array(texts)).to_pylist()
    longest_first = re.compile("|".join(sorted(words, key=len, reverse=True)))
    assert [[h["phrase"] for h in hits] for hits in found] == [longest_first.findall(t) for t in texts]
    lengths, begun = [n for n, _, _ in index.by_length], {w[:4] for w in words}
    before = sum(n <= len(t) - i for t in texts for i in range(len(t) - 3) if t[i : i + 4] in begun for n in lengths)
    assert sum(hashed[1:]) < before / 2  # each place was tested for each length


@pytest.mark.parametrize("run_bytes", [4, 8_000_000])
def test_words_are_counted_where_they_are_read(spark, monkeypatch, run_bytes):
    """the words of the expression, counted per run of texts and group."""
    monkeypatch.setattr(words, "RUN_BYTES", run_bytes)
    texts = ["Graph graphs, a GRAPH", None, "", "naïve \u212aelvin \u0130stanbul stra\u00dfe", "x" * 40, "1a2b", " graph "]
    rows = [(i % 2 if i else None, t) for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "source int, text string")
    plain = docs.select("source", F.explode(dictionary_words("text")).alias("keyword"))
    for by, longer in ((["source"], 0), ([], 0), (["source"], 3)):
        found = words.word_counts(docs, "text", by, longer).groupBy(*by, "keyword").agg(F.sum("times").alias("n"))
        expected = plain.where(F.length("keyword") > longer).groupBy(*by, "keyword").agg(F.count(F.lit(1)).alias("n"))
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    every = "".join(chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000)
    assert words._words(pa.array([every]))[0].to_pylist() == re.findall("[a-z]+", every.lower())


def test_vectors_are_made_behind_a_distinct(spark):
    """no condition on a vector has it made for every occurrence of a word."""
    rows = spark.createDataFrame([("a",), ("a",)], "w string")
    vectors = rows.distinct().select("w", trigram_vector("w").alias("v"))
    steps = plan(vectors.where(F.exists("v", lambda x: x != 0)).join(rows.distinct(), "w"))
    assert steps.count("ArrowEvalPython") == 1 and "ArrowEvalPython" not in steps[steps.rindex("HashAggregate") :]


def test_similar_words_read_the_texts_once(spark, tmp_path):
    """the result's plan starts from the found pairs; pairs equal those of all words."""
    docs = ["neural network networks", "Networks, networking and zebras", None, "neurally zebra"]
    items = [(1, "network zebra"), (2, "neural networks"), (3, "network")]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = QUERIES["similar_words"](spark, str(tmp_path))
    assert "documents.parquet" not in plan(found)

    def vector(word):
        padded, counts = f"  {word}  ", np.zeros(64)
        for i in range(len(padded) - 2):
            h = int(hashlib.md5(padded[i : i + 3].encode()).hexdigest()[:7], 16)
            counts[h % 64] += -1.0 if h // 64 % 2 else 1.0
        return counts / np.linalg.norm(counts)

    core = {}
    for item, text in reversed(items):
        core |= dict.fromkeys(text.split(), ["cso", "method", "task"][item % 3])
    near = [(w, s, c) for w in {w for t in docs if t for w in re.findall("[a-z]+", t.lower())} for c, s in core.items() if w != c and vector(w) @ vector(c) > 0.7501]
    best = {w: min(["cso", "method", "task"].index(s) for x, s, _ in near if x == w) for w, _, _ in near}
    expected = sorted((w, s, c) for w, s, c in near if ["cso", "method", "task"].index(s) == best[w])
    assert expected and sorted(map(tuple, found.collect())) == expected


def test_core_dictionary_reads_its_keywords_once(spark):
    """the keywords were found four times."""
    read = spark.sparkContext.accumulator(0)

    def handed_on(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [("graph", 0.1, "cso", 2), ("graph", 0.1, "task", 5), ("nets", 0.1, "task", 1), ("nets", 0.1, "task", 3), ("deep", 0.2, "cso", 1), ("map", 0.1, "cso", 1)]
    once = spark.createDataFrame(rows, "keyword string, score double, source string, n long").mapInArrow(handed_on, "keyword string, score double, source string, n long")
    found = dictionaries.core_dictionary(once)
    assert sorted(map(tuple, found.collect())) == [("graph", 1, 1.0, "cso", 1), ("nets", 2, 1.0, "task", 0)] and read.value == len(rows)
    assert sorted(map(tuple, dictionaries.core_dictionary(once, times="n").collect())) == [("graph", 2, 1.0, "cso", 1), ("nets", 4, 1.0, "task", 0)]


def test_tokens_equal_a_walk(monkeypatch):
    """texts are cut as arrays, word by word they took most of the time; ties follow their phrases."""
    draw = random.Random(3)
    texts = [None, "", "..", "1 2. -", *("".join(draw.choice(["a", "B", "-", "7", " ", ",", ".", "!", "ab", "AB", "x-y", "\0"]) for _ in range(draw.randrange(60))) for _ in range(60))]
    tokens = keyphrase.Tokens(texts)
    terms = tokens.terms().to_pylist()
    expected, known, n_sents = [], [], []
    for d, text in enumerate(texts):
        own, sent = {}, 0
        for part in re.split("[.!?]+", text or ""):
            kept = [w for w in part.replace(",", " ").split(" ") if re.search("[a-zA-Z]", w)]
            for i, w in enumerate(kept):
                own.setdefault(w.lower(), len(known) + len(own))
                expected.append((own[w.lower()], sent, (len(w) > 1 and w == w.upper()) + 2 * (i > 0 and "A" <= w[0] <= "Z")))
            sent += bool(kept)
        known += [(d, w) for w in own]
        n_sents.append(sent)
    assert list(zip(tokens.code.tolist(), tokens.sent.tolist(), tokens.flags.tolist())) == expected
    assert list(zip(tokens.term_doc.tolist(), terms)) == known and tokens.n_sents.tolist() == n_sents
    assert tokens.among(frozenset(["a", "ab"])).tolist() == [t in ("a", "ab") for t in terms]
    phrases = tokens.phrases(tokens.among(frozenset(["a"])), np.ones(len(terms)), 3)
    for held in (phrases, keyphrase.Phrases(phrases.known, phrases.term, phrases.doc, phrases.codes, phrases.tf, np.zeros(len(phrases.tf)))):
        every = held.texts(slice(None)).to_pylist()
        assert every == [" ".join(terms[c] for c in run if c >= 0) for run in held.codes.tolist()]
        monkeypatch.setattr(keyphrase, "LOOKED_AT", 4)
        best, score = held.chosen(len(texts), 3, 0.9)
        for d in range(len(texts)):
            ranked, taken = sorted((score[i], every[i]) for i in np.flatnonzero(held.doc == d)), []
            for _, t in ranked:
                if len(taken) < 3 and all(1 - plain_distance(t, k) / max(len(t), len(k)) <= 0.9 for k in taken):
                    taken.append(t)
            assert [every[i] for i in best if held.doc[i] == d] == taken
    assert not len(keyphrase.Tokens([]).code) and not len(keyphrase.Tokens([None]).phrases(np.zeros(0, bool), np.zeros(0), 3).tf)


def test_index_takes_little_more_than_its_patterns(monkeypatch):
    """what was sent for each pattern was three times as much, so far smaller sets had to be joined, with the texts moved; hashes may repeat."""
    draw = random.Random(5)
    words = sorted({"".join(draw.choice("abcdeé") for _ in range(draw.randrange(1, 30))) for _ in range(3000)})
    index = patterns.PatternIndex(pa.array(["none", *words]).slice(1))
    assert sum(h.nbytes + t.nbytes for _, h, t in index.by_length) == sum(len(w.encode()) + patterns.HASH_BYTES for w in words)
    texts = [None, "", *("".join(draw.choice([*words[:50], " ", "é", "f"]) for _ in range(60)) for _ in range(20))]
    longest_first = re.compile("|".join(sorted(words, key=lambda w: -len(w.encode()))))
    expected = [longest_first.findall(t or "") for t in texts]
    assert [[h["phrase"] for h in hits] for hits in index.search(pa.array(texts)).to_pylist()] == expected
    monkeypatch.setattr(patterns, "_short", lambda hashes: (hashes >> np.uint64(62)).astype(np.uint32))
    monkeypatch.setattr(patterns, "BLOCK_BYTES", 100)
    index = patterns.PatternIndex(pa.array(words))
    assert [[h["phrase"] for h in hits] for hits in index.search(pa.array(texts)).to_pylist()] == expected
    assert patterns.PatternIndex(pa.array([], pa.string())).search(pa.array(texts)).to_pylist() == [[]] * len(texts)


def test_joined_windows_are_one_row_for_each_part(spark, monkeypatch):
    """a window that stands often in a part is moved once; hits lie within a text, also in texts longer than a block."""
    texts = ["graphs and graph", None, "", "gra", "ph graph", "naïve graph " * 30 + "gr", "aph"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    words = spark.createDataFrame([("graph",), ("graphs",), ("naïve g",), ("ï",)], "keyword string")
    expected = [(i, re.findall("graphs|graph|naïve g|ï", t or "")) for i, t in enumerate(texts)]
    moved, made = [], scan.joined
    monkeypatch.setattr(scan, "joined", lambda candidates, *rest: moved.append(candidates) or made(candidates, *rest))
    for block in (patterns.BLOCK_BYTES, 16):
        monkeypatch.setattr(patterns, "BLOCK_BYTES", block)
        found = patterns.substring_hits(docs, "id", "text", words, max_alternatives=0, max_bytes=0)
        assert sorted((r.id, r.hits) for r in found.collect()) == expected
    assert 4 <= moved[0].where("n > 0").count() < 10
