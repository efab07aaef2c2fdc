"""Quality rules: repetition within a document, and lines that many documents of a host share.

Every line is hashed after normalising; for each host and line the documents that hold it
are counted. Lines above the limit are boilerplate: they are taken out, and a document of
which too little is left is rejected. Copies of one text must not make its own lines
boilerplate, so documents of one host with the same whole text count once; documents that
differ anywhere count each, also where nearly all they hold is shared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm.common import WordHashes, give_back, list_of, same_text, slices, strings, windows
from termweave.session import durable

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: A document fails below so many words, or where so many hundredths of its words stand in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: A line of a host is boilerplate if more documents hold it than this number, however many documents the host has.
LINE_DOCUMENTS = 20
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.2
DIGITS = re.compile(rb"[0-9]+")


def repeated_words(hashes: np.ndarray, size: int = WINDOW) -> int:
    """Words that stand in a run of `size` words found twice or more in the text, its first occurrence included."""
    if len(hashes) <= size:
        return 0
    _, code, count = np.unique(windows(hashes, size), return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[code] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def line_key(line: bytes) -> int:
    """Signed hash of a line without regard to case (A-Z), white space and the values of numbers."""
    return xxhash.xxh64_intdigest(DIGITS.sub(b"0", b" ".join(line.lower().split()))) - (1 << 63)


def _measure(text: str, known: WordHashes) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    joined = b"".join(words)
    n_chars = len(joined) - len(joined.translate(None, bytes(range(0x80, 0xC0)))) if not joined.isascii() else 0
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen, duplicates, keys, sizes = set(), 0, {}, 0
    for line in raw.split(b"\n"):
        n = len(line.split())
        if not n:
            continue
        duplicates += line in seen
        seen.add(line)
        key = line_key(line)
        keys[key] = keys.get(key, 0) + n
    hashes = known.of(words)
    return len(words), len(joined) - n_chars, symbols, duplicates, repeated_words(hashes), list(keys), list(keys.values())


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_keys array<long>, line_words array<int>"


def measured(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """`keep` columns with word, symbol and repetition counts, and its distinct lines with their numbers of words."""
    fields = [docs.schema[c] for c in keep]
    names = [f.name for f in T.StructType.fromDDL(MEASURES).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in slices(batch, text):
                found = list(zip(*(_measure(t, known) for t in strings(part, text)), strict=True)) or [()] * 7
                columns = [pa.array(x, pa.int64()) for x in found[:5]]
                lengths = [len(x) for x in found[5]]
                lists = [list_of(np.array([v for x in found[i] for v in x], kind), lengths) for i, kind in ((5, np.int64), (6, np.int32))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns, *lists], names=[*keep, *names])
            give_back()

    return docs.select(*keep, text).mapInArrow(run, T.StructType([*fields, *T.StructType.fromDDL(MEASURES).fields]))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", line_documents: int = LINE_DOCUMENTS, least_left: float = LEAST_LEFT) -> DataFrame:
    """Counts, verdicts and boilerplate lines of each row.

    Columns: `key`, `text_hash` (tells rows with one key apart), `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words`,
    `base_failed` (fewer than 20 words, or over 30 % of the words in repeated windows of
    8), `removed_lines` (hashes of its boilerplate lines), `removed_words`, `kept` (not
    failed, and at least `least_left` of its words outside of boilerplate). Null and
    empty texts have no words and fail. A null host is a host of its own. Rows that
    repeat a key and a text get the same verdict each. An empty table gives no rows.
    """
    one = docs.select(F.col(key).alias("_key"), same_text(text).alias("text_hash"), F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("_host"), F.col(text).alias("_text"))
    base = durable(measured(one, "_text", ["_key", "text_hash", "_host"]))
    # Each text of a host counts once; a hot host is spread over its texts. Equal texts have equal lines, so any row's will do.
    first = base.where("n_words > 0").groupBy("_host", "text_hash").agg(F.first("line_keys").alias("lines")).select("_host", F.explode("lines").alias("line"))
    common = durable(first.groupBy("_host", "line").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > line_documents).select("_host", "line"))
    lines = base.where("n_words > 0").select("_key", "text_hash", "_host", F.explode(F.arrays_zip("line_keys", "line_words")).alias("row"))
    lines = lines.select("_key", "text_hash", "_host", F.col("row.line_keys").alias("line"), F.col("row.line_words").alias("words"))
    hits = lines.join(common, ["_host", "line"]).dropDuplicates(["_key", "text_hash", "_host", "line"])
    gone = hits.groupBy("_key", "text_hash", "_host").agg(F.sum("words").alias("removed_words"), F.array_sort(F.collect_list("line")).alias("removed_lines"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    removed = F.coalesce("removed_words", F.lit(0))
    rows, gone = base.drop("line_keys", "line_words").alias("r"), gone.alias("g")
    same = F.col("r._key").eqNullSafe(F.col("g._key")) & (F.col("r.text_hash") == F.col("g.text_hash")) & (F.col("r._host") == F.col("g._host"))
    out = rows.join(gone, same, "left")
    return out.select(
        F.col("r._key").alias(key),
        F.col("r.text_hash").alias("text_hash"),
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        failed.alias("base_failed"),
        F.coalesce("removed_lines", F.array().cast("array<long>")).alias("removed_lines"),
        removed.alias("removed_words"),
        (~failed & (F.col("n_words") - removed >= least_left * F.col("n_words"))).alias("kept"),
    )


def without_lines(docs: DataFrame, removed: str = "removed_lines", text: str = "text") -> DataFrame:
    """`docs` with the lines taken out of the text whose hashes `removed` lists; null and empty lists change nothing."""
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = fields.names.index(text)
        for batch in batches:
            texts = []
            for value, gone in zip(batch.column(text).to_pylist(), batch.column(removed).to_pylist(), strict=True):
                if value and gone:
                    hashes = set(gone)
                    value = "\n".join(x for x in value.split("\n") if not x.split() or line_key(x.encode("utf-8", "surrogatepass")) not in hashes)
                texts.append(value)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=fields.names)
            give_back()

    return docs.mapInArrow(run, fields)
