import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES, make_docs
from termweave.llm import fim

WEIRD = [
    "one line", "a\nb\nc", "\n\n\n", "a\n", "x <P> y\nz", "<S", "<", "a<\n<\nP>\n", "<\nS>\n<M\n>", "\r\na\x0bb\x85c d\n", "é\nñ\U0001f600\n" * 50,
    "<M<P", "x" * 5000, ("long " * 900 + "\n") * 30, "é" * 3001 + "\n" + "\U0001f600" * 2999,
]


def plain(doc, text, transformed=100, suffix_first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= transformed:
        return ("plain", n, None, None, text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    spm = h[3] % 100 < suffix_first
    return ("spm" if spm else "psm", n, len(a), len(b), f"<S>{c}<P>{a}<M>{b}" if spm else f"<P>{a}<S>{c}<M>{b}")


def test_outputs_and_digests(spark):
    texts = EDGES + WEIRD
    docs = make_docs(spark, texts, row=F.lit(1), chunk=F.lit("x"), form=F.lit(None), n=F.lit(3)).repartition(3)
    for transformed, first in ((100, 50), (50, 100)):
        rates = fim.Rates(transformed, first)
        want = {i: plain(i, t, transformed, first) for i, t in enumerate(texts)}
        rows = fim.transform(docs, rates=rates).collect()
        assert {r.doc_id: (r.form, r.n, r.prefix_chars, r.middle_chars, r.output) for r in rows} == want
        found = fim.digests(fim.in_output_order(fim.pieces(docs, rates=rates))).collect()
        assert len(found) == len(texts)
        for r in found:
            assert (r.form, r.n, r.prefix_chars, r.middle_chars) == want[r.doc][:4]
            assert r.output_sha256 == hashlib.sha256(want[r.doc][4].encode()).hexdigest()
            assert r.restored_sha256 == hashlib.sha256((texts[r.doc] or "").encode()).hexdigest()


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16])
def test_small_chunks(monkeypatch, size):
    """Cutting and reading back without Spark, at chunk sizes that split lines, characters and sentinels."""
    monkeypatch.setattr(fim, "CHUNK_BYTES", size)
    for key, text in enumerate(WEIRD[:12] + ["<" * 9 + "\n<S\n" * 4]):
        about, out = fim.cut(key, text, fim.Rates(100, 50))
        want = plain(key, text)
        assert about == want[:4] and b"".join(out).decode() == want[4]
        stream = b"".join(out)
        for step in (1, 2, 3, 4, 100):
            reader = fim.Reader(about[0])
            parts = [x for i in range(0, len(stream), step) for x in reader.read(stream[i : i + step])] + list(reader.end())
            assert b"".join(c for _, _, c in sorted(parts, key=lambda x: x[:2])).decode() == text


def test_edge_tables(spark):
    df = make_docs(spark, ["a\nb\nc\n", "q"])
    twice = df.unionByName(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("long")))
    rows = fim.transform(twice, rates=fim.Rates(100, 50)).collect()
    assert len(rows) == 6 and len({(r.doc_id, r.output) for r in rows}) == 4
    assert fim.transform(df.limit(0)).count() == 0
    assert fim.digests(fim.in_output_order(fim.pieces(df.limit(0)))).count() == 0


def test_one_exchange_serves_both_sorts(spark):
    plan = fim.digests(fim.in_output_order(fim.pieces(make_docs(spark, ["a"]))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 2
