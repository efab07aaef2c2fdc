"""Key-phrase extraction from term statistics (Campos et al., Information Sciences 509, 2020).

Every statistic is a count per document and term, and a row holds the whole document, so
everything is counted where the text is read and no token moves: one pass cleans the texts,
codes the tokens of a run of documents as whole numbers, counts terms, sentences, neighbours
and candidate phrases of all of them by sorting arrays, and chooses the key phrases. Their
cleaning and lemmas behind it are native expressions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.functions.fixed import ENGLISH_STOP_WORDS, EXTRACTION_TEXT, URL
from termweave.functions.text import keyword_clean, keywords_in_chunks, long_keywords, outside_ascii
from termweave.operators.edits import Texts
from termweave.operators.lemma import lemmatise
from termweave.session import durable

# Extraction parameters.
MAX_WORDS = 3
WINDOW = 5
TOP = 10
DEDUP_LIMIT = 0.2

#: Documents are analysed in runs of about so many bytes.
RUN_BYTES = 1_000_000
#: The best phrases of a document are looked for among so many of the lowest scores first, then among twice as many.
LOOKED_AT = 128

STATISTICS = "tf long, tf_upper long, tf_capital long, sents long, median_sent double, n_sents long, left_terms long, left_total long, right_terms long, right_total long"
TERMS = f"array<struct<term string, {STATISTICS}, score double>>"
PHRASES = "array<struct<phrase string, tf long, score double>>"
KEYWORDS = "array<struct<keyword string, score double>>"
MADE = {"terms": TERMS, "phrases": PHRASES, "counts": "array<struct<phrase string, tf long>>", "keywords": KEYWORDS}


LINK = re.compile(URL, re.ASCII)
DROPPED = dict.fromkeys(map(ord, outside_ascii(EXTRACTION_TEXT)))


def _plain(text: str | None) -> str | None:
    """`extraction_clean` of one text. Folding letters one by one in expressions takes longer than the whole analysis."""
    if not text:
        return text
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return LINK.sub("", text.strip(" \t\n\x0b\x0c\r")).translate(DROPPED)


#: What the characters of a cleaned text are: nothing, the end of a sentence, part of a word, a letter.
SPACE, END, PART, LETTER = 0, 1, 2, 3
KIND = np.full(256, PART, np.uint8)
KIND[list(b" ,")], KIND[list(b".!?")] = SPACE, END
KIND[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = LETTER
SMALL = np.array([ord(chr(c).lower()) if c < 128 else c for c in range(256)], np.uint8)
CAPITAL = SMALL != np.arange(256)


def _counted_before(marks: np.ndarray) -> np.ndarray:
    """How many are marked before each place, and in all."""
    return np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])


class Tokens:
    """The tokens of a run of cleaned texts as arrays: term code, sentence, flags; terms are told apart by document.

    Words are parts between blanks, commas and ends of sentences that hold a letter; sentences
    without a word do not count. A flag tells that a word is in capitals (1) or, not being the
    first of its sentence, starts with one (2). Codes follow the terms' first places.
    """

    def __init__(self, texts: list[str | None]):
        encoded = [(text or "").encode() for text in texts]
        data = np.frombuffer(b".".join(encoded), np.uint8)
        bounds = np.cumsum(np.array([len(x) + 1 for x in encoded], np.int64))
        kind = KIND[data]
        edges = np.flatnonzero(np.diff((kind >= PART).astype(np.int8), prepend=0, append=0))
        first, last = edges[0::2], edges[1::2]
        letters, capitals, ends = _counted_before(kind == LETTER), _counted_before(CAPITAL[data]), _counted_before(kind == END)
        held = letters[last] > letters[first]
        first, last = first[held], last[held]
        size, doc = last - first, np.searchsorted(bounds, first, side="right")
        # Texts are parted by ends, so no sentence spans two.
        opens = np.diff(ends[first], prepend=-1) != 0
        self.whole = np.cumsum(opens) - 1
        self.n_sents = np.bincount(doc[opens], minlength=len(texts)).astype(np.int64)
        self.sent = self.whole - (np.cumsum(self.n_sents) - self.n_sents)[doc]
        up = capitals[last] - capitals[first]
        self.flags = ((size > 1) & (up == letters[last] - letters[first])) + 2 * (CAPITAL[data[first]] & ~opens)
        inside = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        spelled = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(SMALL[data[inside]])).dictionary_encode()
        #: The distinct terms of the run; `term` tells which of them each term is.
        self.known = spelled.dictionary
        word = spelled.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, at, code = np.unique(doc * len(self.known) + word, return_index=True, return_inverse=True)
        order = np.argsort(at)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.code, self.term_doc, self.term = place[code], doc[at[order]], word[at[order]]

    def terms(self) -> pa.Array:
        return self.known.take(pa.array(self.term))

    def among(self, words: frozenset[str]) -> np.ndarray:
        """Whether each term is one of the words."""
        return pc.is_in(self.known, pa.array(sorted(words), pa.string())).to_numpy(zero_copy_only=False)[self.term]

    def statistics(self, window: int) -> dict[str, np.ndarray]:
        n = len(self.term)

        def counted(at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
            return np.bincount(at, weights=weights, minlength=n).astype(np.int64)

        span = int(self.sent.max()) + 1 if len(self.sent) else 1
        held = np.unique(self.code * span + self.sent)
        sents = counted(held // span)
        start = np.cumsum(sents) - sents
        middle = (held[start + (sents - 1) // 2] % span + held[start + sents // 2] % span) / 2 if n else np.empty(0)
        keys = [np.empty(0, np.int64)]
        for i in range(1, window + 1):
            near = self.whole[i:] == self.whole[:-i]
            keys.append(self.code[i:][near] * n + self.code[:-i][near])
        pairs, times = np.unique(np.concatenate(keys), return_counts=True)
        behind, before = (pairs // n, pairs % n) if n else (pairs, pairs)
        return {
            "tf": counted(self.code),
            "tf_upper": counted(self.code, self.flags & 1),
            "tf_capital": counted(self.code, self.flags >> 1),
            "sents": sents,
            "median_sent": middle,
            "n_sents": self.n_sents[self.term_doc],
            "left_terms": counted(behind),
            "left_total": counted(behind, times),
            "right_terms": counted(before),
            "right_total": counted(before, times),
        }

    def scores(self, s: dict[str, np.ndarray], stop: np.ndarray) -> np.ndarray:
        """A lower score marks a more telling term."""
        docs, content = len(self.n_sents), ~stop
        tf, doc = s["tf"].astype(float), self.term_doc
        n = np.maximum(1, np.bincount(doc[content], minlength=docs))
        mean = np.bincount(doc[content], weights=tf[content], minlength=docs) / n
        spread = (mean + np.sqrt(np.bincount(doc[content], weights=(tf[content] - mean[doc[content]]) ** 2, minlength=docs) / n))[doc]
        most = np.zeros(docs)
        np.maximum.at(most, doc, tf)
        case = np.maximum(s["tf_upper"], s["tf_capital"]) / (1 + np.log(tf))
        position = np.log(np.log(3 + s["median_sent"]))
        frequency = np.where(spread > 0, tf / np.where(spread > 0, spread, 1), tf)
        diverse = s["left_terms"] / np.maximum(1, s["left_total"]) + s["right_terms"] / np.maximum(1, s["right_total"])
        related = 1 + diverse * tf / most[doc]
        return related * position / (case + frequency / related + s["sents"] / s["n_sents"] / related)

    def phrases(self, stop: np.ndarray, scores: np.ndarray | None, longest: int) -> Phrases:
        """The candidates by document: runs within a sentence, no stop word at either end; without term scores theirs are no numbers."""
        words, counts, values = [np.empty((0, longest), np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for n in range(1, longest + 1):
            at = np.arange(len(self.code) - n + 1)
            last = at + n - 1
            at = at[(self.whole[at] == self.whole[last]) & ~stop[self.code[at]] & ~stop[self.code[last]]]
            runs = self.code[at[:, None] + np.arange(n)]
            _, first, tf = np.unique(_row_keys(runs, len(self.term)), return_index=True, return_counts=True)
            runs = runs[first]
            words.append(np.pad(runs, ((0, 0), (0, longest - n)), constant_values=-1))
            counts.append(tf)
            if scores is None:
                values.append(np.full(len(tf), np.nan))
            else:
                parts = scores[runs]
                values.append(parts.prod(axis=1) / (tf * (1 + parts.sum(axis=1))))
        codes = np.concatenate(words)
        doc = self.term_doc[codes[:, 0]]
        order = np.argsort(doc, kind="stable")
        return Phrases(self.known, self.term, doc[order], codes[order], np.concatenate(counts)[order], np.concatenate(values)[order])


@dataclass
class Phrases:
    """Candidate phrases by document, their words as term codes (-1 behind the last one); `term` tells which of `known` a code is."""

    known: pa.Array
    term: np.ndarray
    doc: np.ndarray
    codes: np.ndarray
    tf: np.ndarray
    score: np.ndarray

    def texts(self, at: np.ndarray | slice) -> pa.Array:
        """The phrases, their words joined by blanks."""
        words = pa.concat_arrays([self.known, pa.array([""], pa.string())])
        codes = np.append(self.term, len(self.known))[self.codes[at]]  # the code -1 is the empty word
        parts = [words.take(pa.array(codes[:, i])) for i in range(codes.shape[1])]
        return pc.utf8_rtrim(pc.binary_join_element_wise(*parts, " "), " ")

    def ranks(self) -> np.ndarray | None:
        """The place of each term among the sorted words, the empty one before all; phrases follow each other as these
        do word by word, as a blank comes before what words are made of (None: but not here)."""
        if pc.any(pc.match_substring(self.known, "\0")).as_py():
            return None
        rank = np.empty(len(self.known), np.int64)
        rank[pc.sort_indices(self.known).to_numpy()] = np.arange(len(rank))
        return np.append(rank[self.term], -1)

    def sort_ties(self, order: np.ndarray, ties: np.ndarray, ranks: np.ndarray | None) -> None:
        """Sorts each of these stretches of `order` by its phrases."""
        size = ties[:, 1] - ties[:, 0] + 1
        at = np.repeat(ties[:, 0] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        rows, group = order[at], np.repeat(np.arange(len(ties)), size)
        if ranks is None:
            texts = self.texts(rows).to_pylist()
            order[at] = rows[sorted(range(len(rows)), key=lambda i: (group[i], texts[i]))]
        else:
            order[at] = rows[np.lexsort((*ranks[self.codes[rows]].T[::-1], group))]

    def chosen(self, docs: int, top: int = TOP, limit: float = DEDUP_LIMIT) -> tuple[np.ndarray, np.ndarray]:
        """What `best_of` takes: their places, by document and best first, and all rounded scores.

        The phrases of a document are looked at in growing windows of their order, and only
        those have their words put together. The n-th taken phrases of all documents meet
        the phrases left in their windows at once.
        """
        doc, rounded = self.doc, _rounded(self.score)
        order = np.argsort(rounded, kind="stable")
        # Short numbers are sorted by their digits.
        order = order[np.argsort(doc[order].astype(np.uint16 if docs <= 1 << 16 else np.int64), kind="stable")]
        own = doc[order]
        begin = np.searchsorted(own, np.arange(docs + 1))
        begin, most = begin[:-1], np.diff(begin)
        same = (np.diff(own) == 0) & (np.diff(rounded[order]) == 0)
        ties = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))).reshape(-1, 2)
        tied = own[ties[:, 0]]
        starts = ties[:, 0] - begin[tied]
        taken, local = np.full((docs, top), -1, np.int64), np.zeros(len(order), np.int64)
        low, high, ranks = 0, LOOKED_AT, self.ranks()
        while (going := np.flatnonzero((most > low) & (taken[:, -1] < 0))).size:
            # Equal scores follow their phrases; a group that starts in this window is sorted to its end.
            self.sort_ties(order, ties[(starts >= low) & (starts < high) & (taken[tied, -1] < 0)], ranks)
            size = np.minimum(most[going], high) - low
            left = order[np.repeat(begin[going] + low - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            held = np.concatenate([left, np.unique(taken[np.unique(doc[left])])])
            held = held[held >= 0]
            local[held] = np.arange(len(held))
            window = Texts(self.texts(held).to_pylist())
            for n in range(top):
                if not len(left):
                    break
                opens = np.flatnonzero(np.diff(doc[left], prepend=-1))
                opens = opens[taken[doc[left[opens]], n] < 0]
                taken[doc[left[opens]], n] = left[opens]
                left = np.delete(left, opens)
                if n < top - 1:
                    row, other = local[left], local[taken[doc[left], n]]
                    size, length = window.size[row], window.size[other]
                    longer = np.maximum(size, length)
                    near = 1 - np.abs(size - length) / longer > limit  # else the lengths alone tell them apart
                    rest = np.flatnonzero(near)
                    near[rest] = 1 - window.distances(row[rest], other[rest]) / longer[rest] > limit
                    left = left[~near]
            low, high = high, high * 2
        return taken[taken >= 0], rounded


def _row_keys(rows: np.ndarray, codes: int) -> np.ndarray:
    """One sortable value for each row of codes: a number where it fits 64 bits."""
    width = rows.shape[1]
    if codes**width >= 1 << 62:
        return np.ascontiguousarray(rows).view([("", rows.dtype)] * width).ravel()
    key = rows[:, 0]
    for i in range(1, width):
        key = key * codes + rows[:, i]
    return key


def _rounded(values: np.ndarray) -> np.ndarray:
    """Values at nine digits, halves away from zero as Spark's `round` does."""
    scaled = values * 1e9
    out = np.rint(scaled) / 1e9
    # Near a half, or where the product is not exact enough to tell, the decimal digits decide.
    unsure = (np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3) | (np.abs(scaled) > 1e12)
    for i in np.flatnonzero(unsure & np.isfinite(values)).tolist():
        value = float(values[i])
        out[i] = float(Decimal(repr(value)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) if abs(value) < 1e15 else value
    return out


def _lists(doc: np.ndarray, docs: int, columns: dict[str, pa.Array]) -> pa.Array:
    offsets = np.searchsorted(doc, np.arange(docs + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def analysed(
    docs: DataFrame,
    key: str,
    text: str,
    wanted: str,
    stop_words: list[str] | None = None,
    window: int = WINDOW,
    max_words: int = MAX_WORDS,
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """`(key, carried columns, wanted)`, one row per document.

    Wanted are the statistics of its terms, its scored candidate phrases (or only their
    counts), or its keywords, which are the phrases that `best_of` takes.
    """
    stops = frozenset(ENGLISH_STOP_WORDS if stop_words is None else stop_words)
    kept = [key, *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("_plain")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part_of = (np.cumsum(size) - size) // RUN_BYTES
            edges = [*np.flatnonzero(np.diff(part_of, prepend=-1)).tolist(), len(size)]
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                tokens = Tokens([_plain(x) for x in part.column("_plain").to_pylist()])
                stop = tokens.among(stops)
                counts = tokens.statistics(window) if wanted != "counts" else None
                scores = tokens.scores(counts, stop) if counts else None
                if wanted == "terms":
                    made = _lists(tokens.term_doc, b - a, {"term": tokens.terms(), **{k: pa.array(v) for k, v in counts.items()}, "score": pa.array(scores)})
                else:
                    found = tokens.phrases(stop, scores, max_words)
                    if wanted == "keywords":
                        best, score = found.chosen(b - a)
                        made = _lists(found.doc[best], b - a, {"keyword": found.texts(best), "score": pa.array(score[best])})
                    else:
                        columns = {"phrase": found.texts(slice(None)), "tf": pa.array(found.tf)}
                        made = _lists(found.doc, b - a, columns if scores is None else {**columns, "score": pa.array(found.score)})
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), made], names=[*kept, wanted])

    plain = docs.select(*kept, F.col(text).alias("_plain"))
    made = T.StructType.fromDDL(f"{wanted} {MADE[wanted]}")
    return plain.mapInArrow(run, T.StructType([*plain.select(*kept).schema.fields, *made.fields]))


def term_statistics(docs: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """Counts per document and term that the term score is made of. Rows that repeat a key are documents of their own."""
    return analysed(docs, key, text, "terms", window=window).select(key, F.inline("terms")).drop("score")


def term_scores(statistics: DataFrame, key: str, stop_words: list[str] | None = None) -> DataFrame:
    """`(key, term, tf, score)`; a lower score marks a more telling term."""
    stop_words = ENGLISH_STOP_WORDS if stop_words is None else stop_words
    doc = W.partitionBy(key)
    content_tf = F.when(~F.col("term").isin(stop_words), F.col("tf"))
    spread = F.coalesce(F.avg(content_tf).over(doc) + F.stddev_pop(content_tf).over(doc), F.lit(0.0))
    scaled = statistics.withColumn("_spread", spread).withColumn("_max_tf", F.max("tf").over(doc))

    def diversity(terms: str, total: str) -> Column:
        return F.when(F.col(total) > 0, F.col(terms) / F.col(total)).otherwise(0.0)

    case = F.greatest("tf_upper", "tf_capital") / (1 + F.log("tf"))
    position = F.log(F.log(3 + F.col("median_sent")))
    frequency = F.when(F.col("_spread") > 0, F.col("tf") / F.col("_spread")).otherwise(F.col("tf"))
    neighbours = diversity("left_terms", "left_total") + diversity("right_terms", "right_total")
    related = 1 + neighbours * F.col("tf") / F.col("_max_tf")
    different = F.col("sents") / F.col("n_sents")
    score = related * position / (case + frequency / related + different / related)
    return scaled.select(key, "term", "tf", score.alias("score"))


def candidate_phrases(docs: DataFrame, key: str, text: str, max_words: int = MAX_WORDS, stop_words: list[str] | None = None) -> DataFrame:
    """`(key, phrase, tf)`: runs of up to `max_words` words within a sentence, no stop word at either end."""
    return analysed(docs, key, text, "counts", stop_words, max_words=max_words).select(key, F.inline("counts"))


def phrase_scores(candidates: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """`(key, phrase, tf, score)` from the scores of a phrase's terms."""
    parts = candidates.select(key, "phrase", "tf", F.explode(F.split("phrase", " ")).alias("term"))
    scored = parts.join(terms.select(key, "term", "score"), [key, "term"])
    sums = scored.groupBy(key, "phrase", "tf").agg(F.product("score").alias("_product"), F.sum("score").alias("_sum"))
    return sums.select(key, "phrase", "tf", (F.col("_product") / (F.col("tf") * (1 + F.col("_sum")))).alias("score"))


def _apart(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key stands once, and those that share theirs or have none (None: there are no such rows)."""
    shared = durable(docs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | F.col(key).isNull()).select(key))
    if shared.isEmpty():
        return docs, None
    met = shared.select(F.col(key).alias("_shared"))
    equal = F.col(key).eqNullSafe(F.col("_shared"))
    return docs.join(met, equal, "left_anti"), docs.join(met, equal, "left_semi")


def scored_terms(docs: DataFrame, key: str, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """`term_scores` of the texts, scored where they are read. Only rows that share a key, which count as one document, are moved."""
    once, shared = _apart(docs, key)
    found = analysed(once, key, text, "terms", stop_words).select(key, F.inline("terms")).select(key, "term", "tf", "score")
    return found if shared is None else found.unionByName(term_scores(term_statistics(shared, key, text), key, stop_words))


def scored_phrases(docs: DataFrame, key: str, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """`phrase_scores` of the texts, scored where they are read. Only rows that share a key are moved; rows without one have no phrase."""
    once, shared = _apart(docs, key)
    found = analysed(once, key, text, "phrases", stop_words).select(key, F.inline("phrases"))
    if shared is None:
        return found
    shared = shared.where(F.col(key).isNotNull())
    terms = term_scores(term_statistics(shared, key, text), key, stop_words)
    return found.unionByName(phrase_scores(candidate_phrases(shared, key, text, stop_words=stop_words), terms, key))


def distinct_best(scored: DataFrame, key: str, top: int = TOP, limit: float = DEDUP_LIMIT) -> DataFrame:
    """`(key, keywords)` of scored phrases in rows: see `best_of`."""
    listed = scored.groupBy(key).agg(F.collect_list(F.struct("phrase", "score")).alias("_scored"))
    return listed.select(key, best_of("_scored", top, limit).alias("keywords"))


def best_of(scored: str, top: int = TOP, limit: float = DEDUP_LIMIT) -> Column:
    """Best phrases first, without near copies of an already taken one, from a list of `(phrase, score)`.

    The list is bounded by the phrases of one document. Scores are compared at nine
    digits with the phrase as tie-break, so the order does not depend on how the
    floating point sums were grouped.
    """
    ranked = F.array_sort(F.transform(scored, lambda p: F.struct(F.round(p["score"], 9).alias("score"), p["phrase"].alias("keyword"))))

    def unlike(a: Column, b: Column) -> Column:
        return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)) <= limit

    taken = F.aggregate(
        ranked,
        F.slice(ranked, 1, 0),
        lambda kept, c: F.when(
            (F.size(kept) < top) & F.forall(kept, lambda k: unlike(k["keyword"], c["keyword"])), F.concat(kept, F.array(c))
        ).otherwise(kept),
    )
    return F.transform(taken, lambda k: F.struct(k["keyword"], k["score"]))


def extract_keywords(
    docs: DataFrame,
    key: str,
    text: str,
    chunks: str | None = None,
    lemmas: DataFrame | None = None,
    stop_words: list[str] | None = None,
) -> DataFrame:
    """`(key, keywords array<struct<keyword, score>>)` for every document, an empty list where nothing is found.

    Optional refinement: keep only keywords inside a noun chunk (`chunks`, a list
    column of `docs`) and lemmatise their words by a table.
    """
    found = analysed(docs, key, text, "keywords", stop_words, carried=(chunks,) if chunks else ())
    cleaned = F.transform("keywords", lambda k: F.struct(keyword_clean(k["keyword"]).alias("keyword"), k["score"].alias("score")))
    found = found.withColumn("keywords", cleaned)
    if chunks:
        inside = keywords_in_chunks(F.col("keywords.keyword"), chunks)
        found = found.withColumn("keywords", F.filter("keywords", lambda k: F.array_contains(inside, k["keyword"])))
    if lemmas is not None:
        found = _lemmatised(found, key, lemmas)
    return found.select(key, long_keywords("keywords").alias("keywords"))


def _lemmatised(found: DataFrame, key: str, lemmas: DataFrame) -> DataFrame:
    words = F.flatten(F.transform("keywords", lambda k: F.concat(F.split(k["keyword"], " "), F.array(F.lit("\n")))))
    changed = lemmatise(found.withColumn("_words", words), "_words", lemmas)
    phrases = F.transform(F.split(F.array_join("_words", " "), "\n"), lambda p: F.trim(p))
    rebuilt = F.transform("keywords", lambda k, i: F.struct(F.get(phrases, i).alias("keyword"), k["score"].alias("score")))
    return changed.withColumn("keywords", rebuilt).drop("_words")


def keyword_rows(extracted: DataFrame, key: str, keywords: str = "keywords") -> DataFrame:
    """`(key, keyword, score)`, one row per extracted keyword."""
    return extracted.select(key, F.inline(keywords)).select(key, "keyword", "score")
