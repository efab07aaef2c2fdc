import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from termweave.functions import fixed, text, vectors
from termweave.functions.ids import hashed_id


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression.alias("r")).first().r


def test_hashed_ids_equal_python(spark):
    keys = [f"key {i}" for i in range(2000)] + ["", "é", "日本"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", hashed_id("k", "task/").alias("id")).collect()
    for r in rows:
        assert r.id == str(int(hashlib.md5(("task/" + r.k).encode()).hexdigest(), 16))
    assert one(spark, None, hashed_id("t")) is None


@pytest.mark.parametrize("value", ["Café naïve Ünïcode ﬁne ½", "ＡＢ １", "plain", "Ångström №"])
def test_full_fold_equals_nfkd(spark, value):
    expected = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode()
    assert one(spark, value, text.ascii_fold("t")) == expected


def test_fold_covers_latin_letters(spark):
    letters = "".join(chr(c) for c in range(0xC0, 0x250))
    expected = unicodedata.normalize("NFKD", letters).encode("ascii", "ignore").decode()
    assert one(spark, letters, text.ascii_fold("t")) == expected


def test_text_functions(spark):
    assert one(spark, " <b>A</b>*x\n y   z  ", text.markup_clean("t")) == "A  x  y z"
    assert one(spark, "http://a/b/1234.56", text.last_path_part("t")) == "1234.56"
    assert one(spark, "1234.5678v12.pdf", text.paper_id_of_file("t")) == "1234.5678"
    assert one(spark, "<https://x/topics/neural_nets_%28ai%29>", text.topic_label(text.uri_local_name("t", "topics/"))) == "neural nets (ai)"
    assert one(spark, "Abstract: We, the 2 ABSTRACTs!", text.abstract_clean("t")) == "we the 2 s"
    assert one(spark, "See https://x.y/z Größe_[1]", text.extraction_clean("t")) == "See  Groe1"
    assert one(spark, "Deep (old) [x] Net-work {y} 3", text.keyword_clean("t")) == "deep   net-work"
    assert one(spark, "naïve B2B-Net", text.dictionary_words("t")) == ["na", "ve", "b", "b", "net"]
    assert one(spark, "   ", text.dictionary_words("t")) == []
    assert one(spark, "title introduction body", text.body_cut("t")) == " body"
    assert one(spark, "title abstract body text", text.body_cut("t")) == "y text"
    assert one(spark, "abstract body", text.body_cut("t")) == "abstract body"


def test_fulltext_gate(spark):
    good = " ".join(["network"] * 101)
    assert one(spark, good, text.fulltext_clean("t")) == good
    assert one(spark, " ".join(["network"] * 100), text.fulltext_clean("t")) is None


def test_inverted_index_keeps_key_order(spark):
    value = '{"InvertedIndex": {"we": [0, 3], "show": [1], "that": [2]}}'
    assert one(spark, value, text.inverted_index_text("t")) == "we show that"
    assert one(spark, value, text.inverted_index_text("t", positional=True)) == "we show that we"


def test_keyword_lists(spark):
    scored = F.from_json("t", "array<struct<keyword:string,score:double>>")
    value = '[{"keyword": "deep net", "score": 0.05}, {"keyword": "net", "score": 0.01}, {"keyword": "graph", "score": 0.2}]'
    assert one(spark, value, text.keywords_up_to_score(text.long_keywords(scored), 0.1)) == ["deep net"]
    assert one(spark, None, text.long_keywords(scored)) == []


def test_cosine_and_trigram_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(vectors.cosine("a", "b").alias("c")).collect()] == [pytest.approx(0.96), 0.0]
    phrases = spark.createDataFrame([("neural network",), ("neural networks",), ("zebra",)], "p string").select("p", vectors.trigram_vector("p").alias("v"))
    near, far, own = (
        phrases.alias("a").join(phrases.alias("b"), (F.col("a.p") == "neural network") & (F.col("b.p") == other)).select(vectors.cosine("a.v", "b.v")).first()[0]
        for other in ("neural networks", "zebra", "neural network")
    )
    assert own == pytest.approx(1.0) and near > 0.7 > far


def test_fixed_lists_are_plain_words():
    assert len(set(fixed.ENGLISH_STOP_WORDS)) == len(fixed.ENGLISH_STOP_WORDS)


def test_fold_of_every_code_point(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    df = spark.range(0, 0x110000, numPartitions=8).where("id > 0 AND NOT id BETWEEN 55296 AND 57343")
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    folded = dict(df.select("id", text.ascii_fold(char).alias("f")).where("f <> ''").collect())
    expected = {c: unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in points}
    assert folded == {c: f for c, f in expected.items() if f}


def test_fulltext_windows_whole_words(spark):
    body = "naïve reasoning about ab things 12-34 " * 60
    assert "na ve reasoning things" in one(spark, body, text.fulltext_clean("t"))
