import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import EDGES, make_docs
from termweave.llm import bpe, packing

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = ["", " ", "  a  b\n\n c\t\td ", "<|endoftext|>x <|endoftext|>", "a<|endoftext|>", "aaaa" * 300, "日本語 🙂 é é ​\xa0\x1c\x85x", "don't I'll '' 's", "12345 " * 9, "=-=-" * 99, "ΑΣ Σ İI   x"]


@pytest.fixture(scope="module")
def known():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aeinst THE'.,!\n\t 01é<|>", max_size=80))
def test_ids_equal_the_library(text):
    lib = Tokenizer.from_file(BYTES) if not hasattr(test_ids_equal_the_library, "lib") else test_ids_equal_the_library.lib
    words = Tokenizer.from_file(WORDS) if not hasattr(test_ids_equal_the_library, "words") else test_ids_equal_the_library.words
    test_ids_equal_the_library.lib, test_ids_equal_the_library.words = lib, words
    assert bpe.load(BYTES)[1].encode(text) == packed(lib.encode(text, add_special_tokens=False).ids)
    assert packing.token_ids([text], WORDS)[0] == packed(words.encode(text, add_special_tokens=False).ids)


def test_encode_decode_over_tables(spark, docs, known):
    texts = [*TEXTS, *EDGES]
    df = make_docs(spark, texts, ids=F.lit("clash"), n_tokens=F.lit(-1)).unionByName(docs, allowMissingColumns=True)
    rows = bpe.decode(bpe.encode(df, BYTES), BYTES).collect()
    assert len(rows) == len(texts) + docs.count()
    for r in rows:
        ids = known[0].encode(r.text or "", add_special_tokens=False).ids
        assert bytes(r.ids) == packed(ids) and r.n_tokens == len(ids)
        assert r.decoded == known[0].decode(ids, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), BYTES).count() == 0


def best_fit(lengths, capacity):
    """Number of bins by the plain method."""
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= x]
        room = min(fits) if fits else capacity
        if fits:
            bins.remove(room)
        bins.append(room - x)
    return len(bins)


@pytest.mark.parametrize("seed", range(25))
def test_plan_equals_plain_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 5, 37, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
    bins = {}
    for length, _, pieces, first, per_bin, offset in packing.best_fit_plan(Counter(lengths), capacity):
        for i in range(pieces):
            bins.setdefault(first + i // per_bin, []).append((offset + i % per_bin * length, length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    assert Counter(x for b in bins.values() for _, x in b) == Counter(lengths)
    assert len(bins) == best_fit(lengths, capacity)


def test_packing_over_tables(spark, docs, known):
    df = docs.unionByName(make_docs(spark, [*TEXTS, *EDGES]).withColumn("doc_id", F.col("doc_id") + 1_000_000)).withColumn("offset", F.lit("x")).withColumn("length", F.lit("x"))
    pieces = packing.token_pieces(df.select("doc_id", "text", "offset", "length"), WORDS, 2048)
    rows = packing.pack(pieces, 2048).collect()
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    found, bins = {}, {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
    assert found.keys() == texts.keys()
    for key, own in found.items():
        own.sort(key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in own) == packed([*known[1].encode(texts[key] or "", add_special_tokens=False).ids, 0])
        assert [r.start for r in own] == [2048 * i for i in range(len(own))] and all(r.length == 2048 for r in own[:-1])
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == best_fit([r.length for r in rows], 2048)
    assert packing.pack(pieces.limit(0), 2048).count() == 0
