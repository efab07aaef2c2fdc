"""Phrase scan of documents against a dictionary.

The scan is greedy: from a start it follows the longest dictionary *prefix*, emits
the phrase if that prefix is one, and goes on behind it; there is no back-off to a
shorter phrase and no second look inside a failed walk. As a set: with L(i) the
length of the longest prefix starting at word i, the visited starts are those not
covered by an earlier visited interval [j, j + L(j)), and a visited start is a hit
when its longest prefix is a phrase.

A dictionary that was measured to be small is sent to every task as sorted arrays, which
walk whole batches of documents. A larger one stays distributed: tasks build a compact
filter of its prefixes, which is all that is sent, and one pass over the texts walks with
it. The few word runs that pass are joined with the prefix table, which decides, and meet
again per document, where they are folded. The words themselves never move, and both ways
give the same result.

Every row of the texts gives one row, whatever its key: null texts hold no word, null
keys and keys that stand on several rows stay apart, an empty dictionary finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators.membership import KeyFilter, mixed, text_hashes
from termweave.operators.prefixes import prefix_rows

# Stands between two list elements; never a word, so no phrase crosses it.
BOUNDARY = ""

GOLDEN = np.uint64(0x9E3779B97F4A7C15)

#: Lists are walked in runs of about so many words; a longer list is a run of its own.
WORDS_AT_ONCE = 200_000

MAX_PREFIXES = 1_000_000
MAX_PREFIX_BYTES = 64 * 1024 * 1024

HIT = "struct<pos:int,n:int,phrase:string,value:bigint,weight:double>"
HIT_COLUMNS = ["pos", "n", "phrase", "value", "weight"]


@dataclass(frozen=True)
class DictionarySize:
    """What the prefixes of all phrases take at most."""

    phrases: int
    prefixes: int
    bytes: int
    longest: int

    @classmethod
    def measure(cls, entries: DataFrame) -> DictionarySize:
        depth = F.size("words")
        row = entries.agg(
            F.count(F.lit(1)).alias("phrases"),
            F.coalesce(F.sum(depth), F.lit(0)).alias("prefixes"),
            F.coalesce(F.sum(F.octet_length("phrase") * depth), F.lit(0)).alias("bytes"),
            F.coalesce(F.max(depth), F.lit(0)).alias("longest"),
        ).first()
        return cls(row["phrases"], row["prefixes"], row["bytes"], row["longest"])

    def fits(self, max_prefixes: int = MAX_PREFIXES, max_bytes: int = MAX_PREFIX_BYTES) -> bool:
        """Whether the prefixes may be sent to every task."""
        return self.prefixes <= max_prefixes and self.bytes <= max_bytes


def parts(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about `limit` together, so that the work on it takes bounded memory however large batches are."""
    of = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), batch.num_rows]
    for first, last in zip(edges, edges[1:], strict=False):
        if last > first:
            yield batch.slice(first, last - first)


def _word_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from parts(batch, pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64), WORDS_AT_ONCE)


def visited(at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which starts (ascending) the greedy walk visits; `length` is that of the longest prefix there."""
    begin, end = [], []
    reach = -1
    # Prefixes of one word cover nothing else, so only longer ones decide what is visited.
    longer = length > 1
    for start, stop in zip(at[longer].tolist(), (at + length)[longer].tolist()):
        if start >= reach:
            begin.append(start)
            end.append(stop)
            reach = stop
    before = np.searchsorted(np.array(begin, np.int64), at, side="left")
    return np.concatenate([[-1], np.array(end, np.int64)])[before] <= at


class PrefixWalker:
    """The prefix table as sorted arrays: (parent node, word) -> node.

    Node 0 is the root. Built only from a table whose size was checked.
    """

    def __init__(self, table: pa.Table):
        rows = table.sort_by([("depth", "ascending"), ("prefix", "ascending")])
        prefixes = rows["prefix"].to_pylist()
        node = {prefix: i + 1 for i, prefix in enumerate(prefixes)}
        cut = [prefix.rpartition(" ") for prefix in prefixes]
        self.vocabulary: dict[str, int] = {}
        word = np.array([self.vocabulary.setdefault(last, len(self.vocabulary)) for _, _, last in cut], np.int64)
        parent = np.array([node[head] if head else 0 for head, _, _ in cut], np.int64)
        keys = parent * max(1, len(self.vocabulary)) + word
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], order + 1
        self.depth = int(pc.max(rows["depth"]).as_py() or 0)
        self.terminal = np.concatenate([[False], rows["is_terminal"].to_numpy().astype(bool)])
        self.phrases = rows["prefix"].combine_chunks()
        self.values = rows["value"].combine_chunks()
        self.weights = rows["weight"].combine_chunks()

    def word_ids(self, words: pa.Array) -> np.ndarray:
        """Only the distinct words of a batch are looked up."""
        encoded = words.dictionary_encode()
        known = np.array([self.vocabulary.get(w, -1) for w in encoded.dictionary.to_pylist()], np.int64)
        return known[encoded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.empty(0, np.int64)

    def steps(self, word: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per depth: the positions at which a prefix of that depth starts, and its node."""
        at = np.flatnonzero(word >= 0)
        node = np.zeros(len(at), np.int64)
        for depth in range(1, self.depth + 1):
            inside = at + depth - 1 < end[at]
            at, node = at[inside], node[inside]
            next_word = word[at + depth - 1]
            key = np.where(next_word >= 0, node * len(self.vocabulary) + next_word, -1)
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[slot] == key
            at, node = at[found], self.nodes[slot[found]]
            if not len(at):
                return
            yield depth, at, node

    def longest(self, word: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions at which a prefix starts, with node and length of the longest one."""
        length = np.zeros(len(word), np.int64)
        last = np.zeros(len(word), np.int64)
        for depth, at, node in self.steps(word, end):
            length[at], last[at] = depth, node
        at = np.flatnonzero(length)
        return at, last[at], length[at]

    def greedy(self, word: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, nodes and lengths of the greedy hits."""
        at, node, length = self.longest(word, end)
        hit = visited(at, length) & self.terminal[node]
        return at[hit], node[hit], length[hit]

    def overlapping(self, word: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every phrase occurrence, overlapping ones too."""
        found = [(at, node, np.full(len(at), depth)) for depth, at, node in self.steps(word, end)]
        if not found:
            empty = np.empty(0, np.int64)
            return empty, empty, empty
        at, node, length = (np.concatenate(part) for part in zip(*found))
        phrase = self.terminal[node]
        order = np.lexsort((length[phrase], at[phrase]))
        return at[phrase][order], node[phrase][order], length[phrase][order]

    def scan(self, batch: pa.RecordBatch, walk: str) -> pa.Array:
        """One list of hits per row of the column `words`; those that are no phrase have a null phrase."""
        lists = batch.column("words")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        at, node, length = getattr(self, walk)(self.word_ids(lists.flatten()), np.repeat(bounds[1:], sizes))
        row = pa.array(node - 1, mask=~self.terminal[node])
        document = np.searchsorted(bounds, at, side="right") - 1
        columns = [
            pa.array((at - bounds[document]).astype(np.int32)),
            pa.array(length.astype(np.int32)),
            self.phrases.take(row),
            self.values.take(row),
            self.weights.take(row),
        ]
        hits = pa.StructArray.from_arrays(columns, names=HIT_COLUMNS)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds).astype(np.int32)), hits)


def _sums(hits: pa.ListArray) -> list[pa.Array]:
    """Number of hits, of those with a weight, and their weight, per row."""
    sizes = pc.list_value_length(hits).to_numpy(zero_copy_only=False).astype(np.int64)
    weights = hits.flatten().field("weight")
    document = np.repeat(np.arange(len(sizes)), sizes)
    known = pc.is_valid(weights).to_numpy(zero_copy_only=False)
    weighted = np.bincount(document[known], minlength=len(sizes))
    values = pc.fill_null(weights, 0.0).to_numpy(zero_copy_only=False)
    return [pa.array(sizes), pa.array(weighted.astype(np.int64)), pa.array(np.bincount(document, values, len(sizes)).astype(np.float64))]


def _fold(starts: pa.ListArray, walk: str) -> pa.ListArray:
    """Hits of a document from the prefixes found in it."""
    sizes = pc.list_value_length(starts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = starts.flatten()
    document = np.repeat(np.arange(len(sizes)), sizes)
    pos, n = (flat.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("pos", "n"))
    phrase = pc.is_valid(flat.field("phrase")).to_numpy(zero_copy_only=False)
    if walk == "overlapping":
        kept = np.lexsort((n, pos, document))
    else:
        # The longest at each start.
        order = np.lexsort((~phrase, -n, pos, document))
        span = int((pos + n).max(initial=0)) + 1
        at = (document * span + pos)[order]
        order = order[np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]]
        kept = order[visited((document * span + pos)[order], n[order]) & phrase[order]]
    bounds = np.searchsorted(document[kept], np.arange(len(sizes) + 1))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat.take(pa.array(kept)))


def _with_column(batch: pa.RecordBatch, columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    kept = [name for name in batch.schema.names if name not in ("words", "_starts")]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], names=[*kept, *names])


def _outcome(hits: pa.ListArray, sums: bool) -> tuple[list[pa.Array], list[str]]:
    return (_sums(hits), ["n_hits", "_weighted", "total_weight"]) if sums else ([hits], ["hits"])


def _walked(rows: DataFrame, entries: DataFrame, walk: str, sums: bool) -> DataFrame:
    """`rows` with `hits` (or their sums) in place of `words`; the size of `entries` was checked."""
    table = prefix_rows(entries).select("prefix", "depth", "is_terminal", "value", "weight").toArrow()
    walker = rows.sparkSession.sparkContext.broadcast(PrefixWalker(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _word_parts(batches):
            yield _with_column(part, *_outcome(walker.value.scan(part, walk), sums))

    return rows.mapInArrow(run, _schema(rows.drop("words"), sums))


def _schema(rows: DataFrame, sums: bool) -> str:
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    found = "n_hits bigint, _weighted bigint, total_weight double" if sums else f"hits array<{HIT}>"
    return ", ".join([*columns, found])


def _found(words: DataFrame, key: str, dictionary, walk: str, sums: bool, max_prefixes: int, max_bytes: int) -> DataFrame:
    present = F.coalesce("words", F.array().cast("array<string>"))
    n_words = F.size(F.filter(present, lambda w: w != BOUNDARY)).cast("long")
    rows = words.select(key, n_words.alias("n_words"), present.alias("words"))
    size = dictionary.size()
    if size.fits(max_prefixes, max_bytes):
        return _walked(rows, dictionary.entries, walk, sums)
    table = prefix_rows(dictionary.entries).select("prefix", "depth", "is_terminal", "value", "weight")
    return joined(_candidates(rows, table, size, walk), rows.drop("words"), table, walk, sums)


def _run_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a run of words from that of the run without its last one."""
    return mixed(before + GOLDEN) ^ word


def _prefix_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of the prefixes of a column, word by word as the texts are walked."""
    words = pc.split_pattern(batch.column("prefix"), " ")
    size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, first = text_hashes(words.flatten()), np.cumsum(size) - size
    out = np.zeros(len(size), np.uint64)
    for depth in range(int(size.max(initial=0))):
        long = np.flatnonzero(size > depth)
        out[long] = _run_hash(out[long], flat[first[long] + depth])
    return out


def _candidates(rows: DataFrame, table: DataFrame, size: DictionarySize, walk: str) -> DataFrame:
    """Word runs of `rows` that may count, one row for each part of a batch and distinct run: `(_part, _told, n, prefix, at)`.

    `at` holds the places of the run, counted through the words of the part, whose size is
    bounded. One row of each part, without a prefix, carries the columns of its rows and how
    many words come before each. A run that no phrase may end with counts only as a longer
    prefix, which one word is not, so frequent short words do not leave the task.
    """
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(KeyFilter.of(table.select("prefix"), _prefix_hashes, size.prefixes))
    ends = sc.broadcast(KeyFilter.of(table.where("is_terminal").select("prefix"), _prefix_hashes, size.phrases))
    longest, kept = size.longest, [c for c in rows.columns if c != "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _word_parts(batches):
            lists = batch.column("words")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            bounds, flat = np.concatenate([[0], np.cumsum(sizes)]), lists.flatten()
            hashes, end = text_hashes(flat), np.repeat(bounds[1:], sizes)
            real = pc.not_equal(flat, BOUNDARY).to_numpy(zero_copy_only=False).astype(bool)
            at, so_far = np.arange(len(hashes)), np.zeros(len(hashes), np.uint64)
            runs = []
            for depth in range(1, longest + 1):
                inside = at + depth - 1 < end[at]
                at, so_far = at[inside], so_far[inside]
                so_far = _run_hash(so_far, hashes[at + depth - 1])
                held = shared.value.may_hold(so_far) & real[at + depth - 1]
                at, so_far = at[held], so_far[held]
                if not len(at):
                    break
                told = at[ends.value.may_hold(so_far)] if depth == 1 or walk == "overlapping" else at
                prefix = pc.binary_join_element_wise(*[flat.take(pa.array(told + i)) for i in range(depth)], " ").cast(pa.string()).dictionary_encode()
                runs.append((depth, prefix.dictionary, told, prefix.indices.to_numpy(zero_copy_only=False)))
            yield part_rows(batch, kept, bounds[:-1], runs)

    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    columns = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "words")
    return numbered.mapInArrow(run, PART_ROWS.format(columns))


PART_ROWS = "_part long, _told array<struct<{}>>, n int, prefix string, at array<int>"


def part_rows(part: pa.RecordBatch, kept: list[str], begin: np.ndarray, found: list[tuple[int, pa.Array, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The rows that stand for a part of a batch: one with its columns and where each of its rows begins, and one per run.

    What was found are, for each size, the distinct runs, and the places with the run that is there.
    """
    runs, places, sizes, counts = [pa.nulls(1, pa.string())], [begin], [np.zeros(1, np.int32)], [np.array([len(begin)])]
    for size, distinct, at, which in found:
        runs.append(distinct)
        places.append(at[np.argsort(which, kind="stable")])
        sizes.append(np.full(len(distinct), size, np.int32))
        counts.append(np.bincount(which, minlength=len(distinct)))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
    n = len(offsets) - 1
    told = pa.StructArray.from_arrays([part.column(c) for c in kept], names=kept)
    columns = [
        pa.array(np.full(n, part.column("_row")[0].as_py())),
        pa.ListArray.from_arrays(pa.array([0, *[len(told)] * n], pa.int32()), told),
        pa.array(np.concatenate(sizes)),
        pa.concat_arrays(runs),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(places).astype(np.int32))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["_part", "_told", "n", "prefix", "at"])


def joined(candidates: DataFrame, rows: DataFrame, table: DataFrame, walk: str, sums: bool) -> DataFrame:
    """The columns of each row with the hits that follow from those runs that `table(prefix, depth, ...)` holds; the runs of a part meet again, sorted."""
    known = table.select(F.col("prefix").alias("_prefix"), "depth", "is_terminal", "value", "weight")
    # A key of its own for the row without a prefix: nulls would meet in one task.
    own_key = F.coalesce("prefix", F.concat(F.lit(f"{BOUNDARY}\0"), F.col("_part").cast("string")))
    met = candidates.withColumn("_run", own_key).join(known, (F.col("_run") == F.col("_prefix")) & (F.col("n") == F.col("depth")), "left")
    useful = F.col("is_terminal") if walk == "overlapping" else F.col("is_terminal") | ((F.col("n") > 1) & F.col("_prefix").isNotNull())
    phrase = F.when(F.col("is_terminal"), F.col("prefix")).alias("phrase")
    told = met.where(useful | (F.col("n") == 0)).select("_part", "_told", "n", phrase, "value", "weight", "at")

    def folded(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        first, runs = whole.slice(0, 1), whole.slice(1)
        of, begin = first.column("_told").flatten(), first.column("at").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.list_value_length(runs.column("at")).to_numpy(zero_copy_only=False).astype(np.int64)
        place = runs.column("at").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, run = place[order], pa.array(np.repeat(np.arange(len(sizes)), sizes)[order])
        row = np.searchsorted(begin, place, side="right") - 1
        columns = [pa.array((place - begin[row]).astype(np.int32)), *[runs.column(c).take(run) for c in HIT_COLUMNS[1:]]]
        bounds = pa.array(np.searchsorted(row, np.arange(len(of) + 1)).astype(np.int32))
        outcome, names = _outcome(_fold(pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(columns, names=HIT_COLUMNS)), walk), sums)
        return pa.RecordBatch.from_arrays([*of.flatten(), *outcome], names=[*[f.name for f in of.type], *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            part = batch.column("_part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a and part[a] != now:
                    if held:
                        yield folded(held)
                    now, held = part[a], []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield folded(held)

    return told.repartition("_part").sortWithinPartitions("_part", "n").mapInArrow(run, _schema(rows, sums))


def phrase_hits(
    words: DataFrame, key: str, dictionary, overlapping: bool = False, max_prefixes: int = MAX_PREFIXES, max_bytes: int = MAX_PREFIX_BYTES
) -> DataFrame:
    """`(key, n_words, hits)` for every row of `words(key, words)`."""
    return _found(words, key, dictionary, "overlapping" if overlapping else "greedy", False, max_prefixes, max_bytes)


def phrase_sums(words: DataFrame, key: str, dictionary, max_prefixes: int = MAX_PREFIXES, max_bytes: int = MAX_PREFIX_BYTES) -> DataFrame:
    """`(key, n_words, n_hits, mean_weight, total_weight)` of the greedy hits.

    Hits without a weight count but weigh nothing and are not in the mean.
    """
    found = _found(words, key, dictionary, "greedy", True, max_prefixes, max_bytes)
    mean = F.when(F.col("_weighted") > 0, F.col("total_weight") / F.col("_weighted")).otherwise(F.lit(0.0))
    return found.select(key, "n_words", "n_hits", mean.alias("mean_weight"), "total_weight")
