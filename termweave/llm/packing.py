"""Best-fit decreasing packing of token sequences, exact over the whole corpus.

Documents are tokenised and cut where they are read. Lengths are whole numbers up to the
capacity, so the corpus is described for packing by one count per length: at most
`capacity` numbers, whatever its size. Best-fit decreasing runs on those counts: equal
pieces and equal bins are handled together, and a segment tree over the remaining
capacities finds the tightest open bin in logarithmic time. The plan that comes out (which
pieces of a length, by rank, go to which bins) is joined back to the pieces.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm.common import SLICE_BYTES, give_back, slices, strings
from termweave.session import durable

SPACE = re.compile(r"[ \t\n\r\f\v]+")
#: Texts without these characters are cut by `PIECE` after lower-casing, as the tokenizer would: Latin-1, no special token.
OTHER = re.compile("[^\\x00-\\xff]|<\\|")
LETTERS, NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}\t-\r\x20\x85\xa0]+")


class TightestBin:
    """A segment tree over remaining capacities 0..capacity: which of them have open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.leaves)

    def put(self, remaining: int, is_open: bool) -> None:
        at = self.leaves + remaining
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def find(self, need: int) -> int | None:
        """The smallest remaining capacity of at least `need` that has an open bin."""
        at = self.leaves + need
        if self.open[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of `counts[length]` pieces into bins of `capacity`.

    Rows `(length, first_rank, pieces, first_bin, per_bin, offset)`: the pieces of that
    length with ranks from `first_rank` fill bins from `first_bin` on, `per_bin` in each,
    from `offset`. Bins with the same content are one range of bin numbers; each step
    takes the whole range, so the work depends on the capacity and not on the number of
    pieces.
    """
    tree, ranges, bins, plan = TightestBin(capacity), {}, 0, []

    def add(remaining: int, first: int, number: int) -> None:
        if number and remaining:
            ranges.setdefault(remaining, []).append((first, number))
            tree.put(remaining, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.find(length)
            if remaining is None:
                remaining, first, number = capacity, bins, -(-left // (capacity // length))
                bins += number
            else:
                first, number = ranges[remaining].pop()
                if not ranges[remaining]:
                    del ranges[remaining]
                    tree.put(remaining, False)
            each = remaining // length
            full = min(number, left // each)
            if full:
                plan.append((length, rank, full * each, first, each, capacity - remaining))
                add(remaining - each * length, first, full)
                rank, left, first, number = rank + full * each, left - full * each, first + full, number - full
            if number and left:  # fewer than `each` are left: one bin takes them
                plan.append((length, rank, left, first, left, capacity - remaining))
                add(remaining - left * length, first, 1)
                first, number, left = first + 1, number - 1, 0
            add(remaining, first, number)
    return plan


class Words(dict):
    """Packed ids of words, and of chunks with characters beyond Latin-1, as the tokenizer gives them; a memory of bounded size."""

    def __init__(self, path: str, size: int = 500_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.size = Tokenizer.from_file(path), size
        suffix = json.loads(self.model.to_str())["model"].get("end_of_word_suffix")
        if not suffix:
            raise ValueError("the tokenizer must mark the last token of a word")
        vocab = self.model.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[number for token, number in vocab.items() if token.endswith(suffix)]] = True

    def cut(self, text: str) -> list[str]:
        """Words of a Latin-1 text; in other texts, chunks with other characters stay whole for the tokenizer."""
        if not OTHER.search(text):
            return PIECE.findall(text.lower())
        return [p for c in SPACE.split(text) for p in ([c] if OTHER.search(c) else PIECE.findall(c.lower()))]

    def learn(self, words: set[str]) -> None:
        """Encodes what is not known yet. Plain words are joined by spaces for it: the last token of each ends it."""
        if len(self) > self.size:
            self.clear()
        new = words - self.keys()
        plain = [p for p in new if not OTHER.search(p)]
        for i in range(0, len(plain), 5_000):
            some = plain[i : i + 5_000]
            ids = np.array(self.model.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            packed = ids.tobytes()
            self.update((p, packed[a:b]) for p, a, b in zip(some, ends[:-1], ends[1:], strict=True))
        for p in new.difference(plain):
            self[p] = array("I", self.model.encode(p, add_special_tokens=False).ids).tobytes()


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> Words:
    return Words(path)


def token_ids(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as packed little-endian unsigned 32-bit integers.

    For a tokenizer that drops white space and marks the ends of words, the ids of a text
    are the ids of its words one after another.
    """
    known = _tokenizer(path)
    parts = list(map(known.cut, texts))
    known.learn(set().union(*parts))
    return [b"".join(map(known.__getitem__, p)) for p in parts]


PIECES = "piece int, start long, length long, ids_crc32 long, ids binary"


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, text: str = "text", with_ids: bool = True) -> DataFrame:
    """Each document's ids, closed with `end_id`, cut into pieces of `capacity` ids; only the last may be shorter.

    A null or empty text is the closing id alone. Other columns than the text stay, but
    for those whose names the new columns take. `with_ids=False` leaves the ids null.
    """
    made = ("piece", "start", "length", "ids_crc32", "ids")
    keys = [c for c in docs.columns if c not in (text, *made)]
    fields = [docs.schema[c] for c in keys]
    ends = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 4 * SLICE_BYTES):  # new words are encoded once a slice
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for row, packed in enumerate(token_ids(strings(part, text), path)):
                    packed += ends
                    for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                        own = packed[at : at + 4 * capacity]
                        rows.append(row)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        ids.append(own if with_ids else None)
                kept = part.select(keys).take(pa.array(rows, pa.int64())) if keys else None
                yield pa.RecordBatch.from_arrays(
                    [*(kept.columns if kept else []), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())],
                    names=[*keys, *made],
                )
            give_back()

    return docs.mapInArrow(run, T.StructType([*fields, *T.StructType.fromDDL(PIECES).fields]))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds `sequence_id` and `offset`: best-fit decreasing into sequences of `capacity` over all rows.

    `pieces` has a column `length` from 1 to `capacity`. Sequences are gapless from
    offset 0. Ties among equal lengths go by place in the partitions; columns named
    `sequence_id` and `offset` are replaced. An empty table gives an empty table.

    The driver sees one count per length. Ranks within a length come from counts per
    partition and length, so no length, however common, meets in one task.
    """
    pieces = pieces.drop("sequence_id", "offset")
    # Stored, as it is read twice and a piece's partition and place in it must not change in between.
    placed = durable(pieces.withColumn("_row", F.monotonically_increasing_id())).withColumn("_slice", F.shiftright("_row", 33))
    sizes = placed.groupBy("_slice", "length").agg(F.count(F.lit(1)).alias("_pieces"))
    counts = {r["length"]: r["_pieces"] for r in sizes.groupBy("length").agg(F.sum("_pieces").alias("_pieces")).collect()}
    plan = best_fit_plan(counts, capacity)
    before = W.partitionBy("length").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = durable(sizes.select("_slice", "length", F.coalesce(F.sum("_pieces").over(before), F.lit(0)).alias("_before")))
    names = pieces.columns
    columns = ["length", "rank", "pieces", "first_bin", "per_bin", "offset"]
    steps = pd.DataFrame(plan, columns=columns, dtype=np.int64).sort_values(["length", "rank"])
    table = {int(k): g[columns[1:]].to_numpy() for k, g in steps.groupby("length")}
    nth = F.row_number().over(W.partitionBy("_slice", "length").orderBy("_row")) - 1  # within one partition's pieces of one length
    ranked = placed.withColumn("_nth", nth).join(starts, ["_slice", "length"]).withColumn("_rank", F.col("_before") + F.col("_nth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            bins, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                rows, own = np.flatnonzero(length == x), table[int(x)]
                step = own[np.searchsorted(own[:, 0], rank[rows], "right") - 1]
                inside = rank[rows] - step[:, 0]
                bins[rows] = step[:, 2] + inside // step[:, 3]
                offset[rows] = step[:, 4] + inside % step[:, 3] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(bins), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = T.StructType.fromDDL("sequence_id long, offset long").fields
    return ranked.select(*pieces.columns, "_rank").mapInArrow(run, T.StructType([*pieces.schema.fields, *fields]))
