"""Spelling variants: words of a corpus that differ by one edit, and the form each is a variant of.

Candidates come from asymmetric q-chunks. A word of length L has two disjoint chunks of
L // 2 characters, at the start and behind it; one edit spares one of them. The other word
of a pair gives all its positional grams of that size that can meet a chunk within a shift
of one. Both sides are filed by the chunk word's length, the chunk's number and its
characters, which is an equi-join; the edit distance is a condition of that join, so that
candidates that fail never become rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import give_back, slices, strings
from termweave.session import durable, release

#: Runs of letters, A-Z being lower-cased before.
RUN = re.compile(r"[a-zÀ-ÿ]+")
#: A task hands on its counts when it holds so many words.
COUNTED = 100_000


def damaged(key: int | None, run: str, n: int, every: int) -> str:
    """`run` of a document `n` long; where `every` divides the CRC-32 of `<id>:<run>`, without one of its characters."""
    h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
    if h % every:
        return run
    at = h % n
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, every: int | None = None) -> DataFrame:
    """`(word, n)`: letter runs of the whole texts, A-Z lower-cased, of at least `least_length` characters and `least_count` occurrences.

    With `every`, one in so many runs of a document loses a character, drawn by a hash of
    document and run: made typing errors for measuring. Tasks add up what they can hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for doc, value in zip(part.column("doc").to_pylist(), strings(part, "text"), strict=True):
                    lowered = value.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                    for word, n in Counter(RUN.findall(lowered)).items():
                        if len(word) >= least_length and (every is None or len(word := damaged(doc, word, len(word), every)) >= least_length):
                            total[word] += n
                if len(total) >= COUNTED:
                    yield _counted(total)
                    total.clear()
            give_back()
        yield _counted(total)

    keyed = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    parts = keyed.mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """`(a, b, n_a, n_b)`: every pair of `words(word, n)`, distinct, that differ by exactly one inserted, deleted or replaced character, once in each order.

    The chunk word is the shorter one, or either of two equally long ones. Words of fewer
    than two characters have no chunks and are in no pair.
    """
    length = F.char_length("word")
    sized = words.where(length >= 2).select("word", "n", length.alias("size"))

    def filed(of: int, starts: list[tuple[int, int]]):
        """Keys of the grams at chunk 0 or 1 of a word of length size - of, moved by a shift."""
        q = F.expr(f"(size - {of}) div 2").cast("int")
        grams = [F.struct((F.col("size") - of).alias("length"), F.lit(part).alias("part"), F.substring("word", q * part + shift + 1, q).alias("gram")) for part, shift in starts]
        return sized.where(F.col("size") - of >= 2).select("word", "n", F.inline(F.array_distinct(F.array(*grams))))

    chunks = durable(filed(0, [(0, 0), (1, 0)]))
    # One replaced character moves nothing; an inserted one moves a chunk by one or not at all.
    longer = filed(1, [(0, 0), (0, 1), (1, 0), (1, 1)])
    a, b = chunks.alias("a"), longer.alias("b")
    same_key = (F.col("a.length") == F.col("b.length")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.gram") == F.col("b.gram"))
    one_edit = F.levenshtein("a.word", "b.word", 1) == 1
    columns = F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b")
    inserted = a.join(b, same_key & one_edit).select(*columns)
    replaced = a.join(chunks.alias("b"), same_key & (F.col("a.word") < F.col("b.word")) & one_edit).select(*columns)
    pairs = inserted.unionByName(replaced).distinct()
    both = F.array(F.struct("a", "b", "n_a", "n_b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b")))
    return pairs.select(F.inline(both))


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """`(word, n, n_near, form, form_n, root)` for each row of `words(word, n)`.

    `n_near` counts the words one edit away. `form` is the most frequent of them (ties: the
    smallest in code-point order) if it is at least `times` as frequent, else null; `root`
    follows the forms to the last one. As counts grow along the way, it ends. `words` must
    be distinct; null words count as unlike any other.
    """
    words = durable(words.select("word", "n"))
    near = near_words(words).groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("_best"))
    own = words.alias("w").join(near.alias("s"), F.col("w.word") == F.col("s.word"), "left")
    frequent = -F.col("_best.less") >= times * F.col("w.n")
    rows = durable(
        own.select("w.word", "w.n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("_best.form")).alias("form"), F.when(frequent, -F.col("_best.less")).alias("form_n"))
    )
    # Every step doubles the way: a word points to what its form points to.
    steps = durable(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = durable(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("_moved")))
        more = not moved.where("_moved").isEmpty()
        release(steps)
        steps = moved.select("word", "root")
        steps._stored_at = moved._stored_at
        if not more:
            break
    release(words)
    found = rows.alias("r").join(steps.alias("s"), F.col("r.word") == F.col("s.word"), "left")
    return found.select("r.word", "n", "n_near", "form", "form_n", F.coalesce("root", "r.word").alias("root"))


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, times: int = 5, every: int | None = None) -> DataFrame:
    """Spelling variants of the words of `docs`: see `word_counts` and `variants`.

    Null and empty texts hold no words; rows that repeat an id or a text count each. A null
    id counts as an empty one where characters are dropped. An empty table gives no rows;
    other columns are not read. `key` is a whole number.
    """
    return variants(word_counts(docs, key, text, least_length, least_count, every), times)
