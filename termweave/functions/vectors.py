"""Embedding columns: parsing, cosine similarity and hashed phrase vectors."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def parse_vector(column: Column | str) -> Column:
    """`[0.1, 0.2]` text to an array of doubles."""
    return F.from_json(_c(column), "array<double>")


def as_doubles(column: Column | str) -> Column:
    return _c(column).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda total, x: total + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; a zero vector is similar to nothing (0)."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


@lru_cache(maxsize=1 << 16)
def _number(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:7], 16)


def trigram_vector(phrase: Column | str, dim: int = 64) -> Column:
    """Deterministic phrase embedding: signed hashed character-trigram counts, unit length.

    A trigram's number is its md5's first seven hex digits: the rest by `dim` is its slot,
    the parity of the quotient its sign. Stands in for a model-made embedding where no
    vector table is at hand. Batches are counted as arrays: as an expression, every slot
    looks at every trigram, and each condition on the vector does so again. Conditions on
    the vector stay behind it: carried below a `distinct` or to the other side of a join,
    they would have it made for every occurrence of a phrase.
    """

    def counted(texts: pa.Array) -> pa.Array:
        known = [text or "" for text in texts.to_pylist()]
        size = np.array([len(text) for text in known], np.int64)
        grams = np.maximum(0, size - 2)
        row = np.repeat(np.arange(len(known)), grams)
        points = np.frombuffer("".join(known).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.arange(len(row)) + (np.cumsum(size - grams) - (size - grams))[row]
        codes, which = np.unique((points[at] << 42) | (points[at + 1] << 21) | points[at + 2], return_inverse=True)
        mask = (1 << 21) - 1
        number = np.array([_number(chr(c >> 42) + chr(c >> 21 & mask) + chr(c & mask)) for c in codes.tolist()], np.int64)[which]
        signs = np.where(number // dim % 2 == 1, -1.0, 1.0)
        vectors = np.bincount(row * dim + number % dim, signs, len(known) * dim).astype(np.float64).reshape(-1, dim)
        length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        unit = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
        unknown = np.repeat(pc.is_null(texts).to_numpy(zero_copy_only=False), dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(unit.ravel(), mask=unknown))

    return F.arrow_udf(counted, "array<double>").asNondeterministic()(F.concat(F.lit("  "), F.lower(_c(phrase)), F.lit("  ")))
