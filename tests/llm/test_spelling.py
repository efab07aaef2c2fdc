import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES, make_docs
from termweave.llm import spelling


def plain_words(rows, every=None, least_length=6, least_count=5):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            if every:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                if h % every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, times=5):
    out, form = {}, {}
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], words[form[w]] if form[w] else None, root)
    return out


def result(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize("every", [None, 3, 199])
def test_documents_equal_brute_force(spark, docs, every):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    words = plain_words(rows, every)
    found = result(spelling.group_variants(docs, every=every))
    assert found == plain_variants(words) and len(found) > 100


def test_every_kind_of_edit_and_long_chains(spark):
    base = ["abcdef", "abcdefg", "xabcdef", "abcxdef", "bcdef", "abcdf", "abcdex", "xbcdef", "abdcef", "aaaaaa", "aaaaaaa", "aaaaa", "ab", "a", "b", "été", "ete", "éte", "àèìòùú", "àèìòùúv"]
    base += ["z" * n for n in range(2, 90)] + ["z" * n + "q" for n in range(2, 60, 7)]
    words = {w: i * i + 1 for i, w in enumerate(base)}
    words |= {"chain" + "abcdefghij"[:k]: 6**k for k in range(10)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    want = plain_variants(words)
    for single in ("a", "b"):  # words without chunks are in no pair
        want[single] = (words[single], 0, None, None, single)
    shorter = [w for w in words if len(w) == 2]
    found = result(spelling.variants(frame))
    for w in shorter:
        near = [v for v in words if len(v) > 1 and v != w and one_edit(w, v)]
        assert found[w][1] == len(near)
    assert {w: v for w, v in found.items() if len(w) > 2} == {w: v for w, v in want.items() if len(w) > 2}
    assert found["chain"][4] == "chainabcdefghi"


def test_edge_cases(spark):
    df = make_docs(spark, EDGES + ["Color color colour colors COLORS colors colors colors"] * 6, word=F.lit("x"), n=F.lit(1))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert result(spelling.group_variants(df)) == plain_variants(plain_words(rows))
    assert spelling.group_variants(df.limit(0)).count() == 0
    nulls = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert result(spelling.group_variants(nulls, every=2)) == plain_variants(plain_words([(None, t) for _, t in rows], 2))
    assert result(spelling.group_variants(df.unionByName(df), least_count=5)) == plain_variants(plain_words(rows * 2))
