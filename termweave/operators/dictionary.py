"""Phrase dictionaries: normalised phrases, their prefix table and phrase ids."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.functions.text import dictionary_words, split_words
from termweave.operators import scan
from termweave.operators.lemma import lemmatise
from termweave.operators.prefixes import prefix_rows, prefix_steps
from termweave.operators.skew import dense_id, salted_join


def phrase_entries(
    df: DataFrame,
    phrase: str,
    value: str,
    weight: str | None = None,
    order: str | None = None,
    normalise: bool = True,
    by: Sequence[str] = (),
    lemmas: DataFrame | None = None,
    combine: Callable[[str], Column] | None = None,
    fold: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """One row per distinct non-empty phrase (per group of `by`).

    Of equal phrases the last insertion gives the weight, and the value unless
    `combine` (an aggregate such as `F.max`) says how their values become one, or
    `fold(old, new)` is called for every later insertion in order. A fold may depend on
    the order, so the values of one phrase (16 bytes each) meet in one task; an aggregate
    is combined on the map side and has no such limit.
    """
    if combine and fold:
        raise ValueError("give combine or fold, not both")
    df, words = phrase_words(df, phrase, normalise, lemmas)
    rows = df.select(
        *by,
        words.alias("words"),
        F.col(value).cast("long").alias("value"),
        (F.col(weight).cast("double") if weight else F.lit(None).cast("double")).alias("weight"),
        F.col(order or value).cast("long").alias("ord"),
    ).where(F.size("words") > 0)
    return rows.groupBy(*by, F.array_join("words", " ").alias("phrase")).agg(
        F.first("words").alias("words"),
        _one_value(combine, fold).alias("value"),
        F.max_by("weight", "ord").alias("weight"),
        F.min("ord").alias("ord"),
        F.max("ord").alias("last_ord"),
    )


def _one_value(combine: Callable[[str], Column] | None, fold: Callable[[Column, Column], Column] | None) -> Column:
    if combine:
        return combine("value").cast("long")
    if fold is None:
        return F.max_by("value", "ord")
    inserted = F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"])
    return F.aggregate(F.slice(inserted, 2, F.size(inserted)), F.element_at(inserted, 1), lambda old, new: fold(old, new).cast("long"))


def phrase_words(df: DataFrame, text: str | Column, normalise: bool, lemmas: DataFrame | None) -> tuple[DataFrame, Column]:
    """The words of a text column as dictionaries compare them, and the rows to take them from.

    Lemmas are looked up for the raw white-space token, before case and punctuation are dropped.
    """
    if lemmas is None or not normalise:
        return df, dictionary_words(text) if normalise else split_words(text)
    tokens = df.withColumn("_tokens", split_words(text))
    return lemmatise(tokens, "_tokens", lemmas), dictionary_words(F.array_join("_tokens", " "))


class PhraseDictionary:
    """A set of phrases with a value and an optional weight, applied to text columns.

    `entries(phrase, words, value, weight, ord, last_ord)` holds one row per distinct
    normalised phrase (the last insertion wins), `prefixes` one row per distinct
    word prefix. Both are plain DataFrames; scanning cuts the dictionary by its
    measured size. With a table `lemmas(word, lemma)` phrases and texts are
    compared by their lemmas.
    """

    def __init__(self, entries: DataFrame, weighted: bool, normalise: bool = True, lemmas: DataFrame | None = None):
        self.entries = entries
        self.weighted = weighted
        self.normalise = normalise
        self.lemmas = lemmas
        self._size: scan.DictionarySize | None = None

    @classmethod
    def build(
        cls,
        df: DataFrame,
        phrase: str = "keyword",
        value: str = "trie_id",
        weight: str | None = None,
        order: str | None = None,
        normalise: bool = True,
        lemmas: DataFrame | None = None,
        combine: Callable[[str], Column] | None = None,
        fold: Callable[[Column, Column], Column] | None = None,
    ) -> PhraseDictionary:
        """Dictionary from a table; `order` (default: `value`) is the insertion order."""
        if not isinstance(df.schema[phrase].dataType, T.StringType):
            raise ValueError(f"phrase column {phrase!r} must hold strings")
        for column in filter(None, (value, weight, order)):
            if column not in df.columns:
                raise ValueError(f"missing column {column!r}")
        entries = phrase_entries(df, phrase, value, weight, order, normalise, lemmas=lemmas, combine=combine, fold=fold)
        return cls(entries, weighted=weight is not None, normalise=normalise, lemmas=lemmas)

    @classmethod
    def from_prefixes(
        cls, prefixes: DataFrame, weighted: bool, normalise: bool = True, lemmas: DataFrame | None = None
    ) -> PhraseDictionary:
        """Dictionary from a (stored) prefix table, see `prefixes`."""
        phrases = prefixes.where("is_terminal")
        words = F.split("prefix", " ").alias("words")
        entries = phrases.select(F.col("prefix").alias("phrase"), words, "value", "weight", "ord", "last_ord")
        return cls(entries, weighted, normalise, lemmas)

    @classmethod
    def build_optional(cls, df: DataFrame | None, **columns) -> PhraseDictionary | None:
        """No keyword table, no dictionary."""
        return None if df is None else cls.build(df, **columns)

    @property
    def prefixes(self) -> DataFrame:
        """`(prefix, depth, is_terminal, value, weight, first_ord, ord, last_ord)`, one row per distinct prefix."""
        return prefix_rows(self.entries)

    def counts(self) -> DataFrame:
        """Number of nodes (distinct prefixes and the root) and of phrases."""
        return self.prefixes.agg(
            (F.count(F.lit(1)) + 1).alias("nodes"),
            F.coalesce(F.sum(F.col("is_terminal").cast("long")), F.lit(0)).alias("phrases"),
        )

    def phrase_ids(self) -> DataFrame:
        """`(phrase_id, phrase)`: ids in depth-first order, children in insertion order.

        The order key of a phrase is the list of first insertions along its prefixes;
        arrays compare element by element with the shorter one first, which is exactly
        pre-order.
        """
        steps = prefix_steps(self.entries, "phrase")
        path = (
            steps.join(self.prefixes.select("prefix", "first_ord"), "prefix")
            .groupBy("phrase")
            .agg(F.array_sort(F.collect_list(F.struct("depth", "first_ord"))).alias("steps"))
        )
        ordered = path.select("phrase", F.transform("steps", lambda s: s["first_ord"]).alias("_path"))
        return dense_id(ordered, ["_path"], "phrase_id").select("phrase_id", "phrase")

    def words_of(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """`(key, words)` of a text column."""
        rows, words = phrase_words(df.select(key, text) if key != text else df.select(key), text, self.normalise, self.lemmas)
        return rows.select(key, words.alias("words"))

    def match(self, df: DataFrame, text: str) -> DataFrame:
        """Exact look-up of the whole text: adds `matched`, `value` and `weight`.

        Texts without a word are one frequent key, which is cut into pieces.
        """
        rows, words = phrase_words(df, text, self.normalise, self.lemmas)
        keyed = rows.select(*df.columns, F.array_join(words, " ").alias("_phrase"))
        known = self.entries.select(F.col("phrase").alias("_phrase"), "value", "weight", F.lit(True).alias("matched"))
        joined = salted_join(keyed, known, "_phrase", "left").drop("_phrase")
        return joined.withColumn("matched", F.coalesce("matched", F.lit(False)))

    def search(self, df: DataFrame, key: str, text: str, **limits) -> DataFrame:
        """`(key, n_words, hits)`: greedy, non-overlapping phrase hits in text order."""
        return scan.phrase_hits(self.words_of(df, key, text), key, self, **limits)

    def search_list(self, df: DataFrame, key: str, texts: str, **limits) -> DataFrame:
        """Like `search` for a list of texts per row; no hit crosses a list element."""
        column = df.schema[texts].dataType
        if not isinstance(column, T.ArrayType):
            raise ValueError(f"{texts!r} must be a list of texts")
        boundary = F.array(F.lit(scan.BOUNDARY))
        if self.lemmas is None or not self.normalise:
            worded = dictionary_words if self.normalise else split_words
            split = F.transform(F.col(texts), lambda t: F.concat(F.coalesce(worded(t), F.array().cast("array<string>")), boundary))
            words = df.select(key, F.flatten(split).alias("words"))
        else:
            tokens = F.flatten(F.transform(F.col(texts), lambda t: F.concat(F.coalesce(split_words(t), F.array().cast("array<string>")), boundary)))
            lemmatised = lemmatise(df.select(key, tokens.alias("_tokens")), "_tokens", self.lemmas)
            words = lemmatised.select(
                key,
                F.flatten(F.transform("_tokens", lambda t: F.when(t == scan.BOUNDARY, boundary).otherwise(dictionary_words(t)))).alias("words"),
            )
        return scan.phrase_hits(words, key, self, **limits)

    def search_metrics(self, df: DataFrame, key: str, text: str, **limits) -> DataFrame:
        """`(key, n_hits, mean_weight, total_weight)` of the greedy hits."""
        if not self.weighted:
            raise ValueError("mean and total weight need a weight column")
        return scan.phrase_sums(self.words_of(df, key, text), key, self, **limits).drop("n_words")

    def search_count(self, df: DataFrame, key: str, text: str, **limits) -> DataFrame:
        return scan.phrase_sums(self.words_of(df, key, text), key, self, **limits).select(key, "n_hits")

    def word_metrics(self, df: DataFrame, key: str, text: str, **limits) -> DataFrame:
        """`(key, n_hits, ratio[, mean_weight, total_weight])` of single-word look-ups.

        The ratio is the share of all words that are in the dictionary.
        """
        single = PhraseDictionary(self.entries.where(F.size("words") == 1), self.weighted, self.normalise, self.lemmas)
        sums = scan.phrase_sums(self.words_of(df, key, text), key, single, **limits)
        ratio = F.when(F.col("n_words") > 0, F.col("n_hits") / F.col("n_words")).otherwise(0.0)
        return sums.select(key, "n_hits", ratio.alias("ratio"), *(["mean_weight", "total_weight"] if self.weighted else []))

    def document_matrix(self, df: DataFrame, key: str, docs: str, **limits) -> DataFrame:
        """Sparse `(key, phrase_id, n)` counts for text or phrase-list documents."""
        kind = df.schema[docs].dataType
        ids = self.phrase_ids()
        if isinstance(kind, T.StringType):
            # The scan itself gives the ids, so no phrase is joined afterwards.
            id_column = F.col("phrase_id")
            entries = ids.select(
                "phrase", F.split("phrase", " ").alias("words"), id_column.alias("value"),
                F.lit(None).cast("double").alias("weight"), id_column.alias("ord"), id_column.alias("last_ord"),
            )
            numbered = PhraseDictionary(entries, False, self.normalise, self.lemmas)
            found = numbered.search(df, key, docs, **limits).select(key, F.explode("hits.value").alias("phrase_id"))
            return found.groupBy(key, "phrase_id").agg(F.count(F.lit(1)).alias("n"))
        if not isinstance(kind, T.ArrayType):
            raise ValueError("a document must be a text or a list of phrases")
        # Counting before the id join leaves one row per document and phrase.
        counted = df.select(key, F.explode(docs).alias("phrase")).groupBy(key, "phrase").agg(F.count(F.lit(1)).alias("n"))
        return salted_join(counted, ids, "phrase").select(key, "phrase_id", "n")

    def size(self) -> scan.DictionarySize:
        """Measured once: phrases and the most that their prefixes can take."""
        if self._size is None:
            self._size = scan.DictionarySize.measure(self.entries)
        return self._size
