"""Word counts of texts, made where the texts are read."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.operators.scan import parts

#: Texts are cut into words in runs of about so many bytes; a longer text is a run of its own.
RUN_BYTES = 8_000_000

LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: The lower-case letter of each byte, 0 where it is none; all bytes of other characters are none.
LOWER = np.zeros(256, np.uint8)
LOWER[list(LETTERS)] = LOWER[list(LETTERS.upper())] = list(LETTERS)
#: The only other characters with one of these letters in their lower case.
SPECIAL = ("\u0130", "\u212a")


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-case letter runs of texts, and the text of each."""
    plain = ["" if t is None else t.lower() if any(c in t for c in SPECIAL) else t for t in texts.to_pylist()]
    encoded = [t.encode() for t in plain]
    data = LOWER[np.frombuffer(b" ".join(encoded), np.uint8)]
    letter = data > 0
    edges = np.flatnonzero(np.diff(letter.astype(np.int8), prepend=0, append=0))
    first, last = edges[0::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[letter]))
    bounds = np.cumsum(np.array([len(t) + 1 for t in encoded], np.int64))
    return words, np.searchsorted(bounds, first, side="right")


def word_counts(docs: DataFrame, text: str, by: Sequence[str] = (), longer_than: int = 0) -> DataFrame:
    """`(…by, keyword, times)`: the words that `dictionary_words` finds, counted per run of texts.

    A word has one row for each run that holds it (and group of `by`), so its occurrences
    are the sum of `times`. Texts are cut as arrays and only counts leave the task: exploded
    word by word they take many times longer. Null texts have no word.
    """
    rows = docs.select(*by, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in parts(batch, sizes, RUN_BYTES):
                words, row = _words(part.column("_text"))
                encoded = words.dictionary_encode()
                code, known = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
                if longer_than:
                    kept = pc.greater(pc.binary_length(known), longer_than).to_numpy(zero_copy_only=False)[code]
                    code, row = code[kept], row[kept]
                groups, group = _groups([part.column(c) for c in by], part.num_rows)
                keys, times = np.unique(code * len(groups) + group[row], return_counts=True)
                code, first = np.divmod(keys, max(1, len(groups)))
                columns = [part.column(c).take(pa.array(groups[first])) for c in by]
                yield pa.RecordBatch.from_arrays([*columns, known.take(pa.array(code)), pa.array(times.astype(np.int64))], names=[*by, "keyword", "times"])

    made = T.StructType.fromDDL("keyword string, times long")
    return rows.mapInArrow(run, T.StructType([*rows.select(*by).schema.fields, *made.fields]))


def _groups(columns: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of each group of equal values (nulls are equal), and the group of each row."""
    code = np.zeros(rows, np.int64)
    for column in columns:
        own = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    first, group = np.unique(code, return_index=True, return_inverse=True)[1:]
    return first, group
