"""Language identification by function words, and the language filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions.fixed import LANGUAGE_WORDS
from termweave.functions.text import split_words


def letter_words(text: Column | str) -> Column:
    """Lower-case letter runs of any script."""
    text = F.col(text) if isinstance(text, str) else text
    return split_words(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def function_word_counts(words: Column | str) -> dict[str, Column]:
    words = F.col(words) if isinstance(words, str) else words

    def count_of(listed: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(listed)))

    return {language: count_of(listed) for language, listed in LANGUAGE_WORDS.items()}


def identify_language(df: DataFrame, text: str, name: str = "detected") -> DataFrame:
    """Adds the language with most function words, `und` where none occurs.

    Counted inside the row: nothing is exploded or shuffled. Ties go to the
    alphabetically first language.
    """
    counted = df.withColumn("_words", letter_words(text))
    scores = F.array(
        *[F.struct((-n).alias("minus"), F.lit(language).alias("language")) for language, n in function_word_counts("_words").items()]
    )
    best = F.array_min(scores)
    found = F.when(best["minus"] == 0, F.lit("und")).otherwise(best["language"])
    return counted.withColumn(name, found).drop("_words")


def keep_language(df: DataFrame, language: str, column: str = "lang", text: str | None = None) -> DataFrame:
    """Rows in `language`, by the given column where the table has it, else identified from `text`."""
    if column in df.columns:
        return df.where(F.col(column) == language)
    if text is None:
        raise ValueError(f"no column {column!r} and no text to identify the language from")
    return identify_language(df, text, column).where(F.col(column) == language)
