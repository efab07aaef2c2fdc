"""Text clean-up and predicates as native column expressions (no Python per row)."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from termweave.functions import fixed


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip(column: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(_c(column), r"(?U)^\s+|\s+$", "")


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, not once for each time it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def split_words(column: Column | str) -> Column:
    """White-space tokens without empty strings."""
    return F.array_remove(F.split(_c(column), r"(?U)\s+"), "")


def word_count(column: Column | str) -> Column:
    return F.size(split_words(column))


def markup_clean(column: Column | str) -> Column:
    return strip(F.regexp_replace(_c(column), "(?U)" + fixed.MARKUP, " "))


def last_path_part(column: Column | str) -> Column:
    return F.substring_index(_c(column), "/", -1)


def paper_id_of_file(column: Column | str, extension: str = ".pdf") -> Column:
    """File name without its extension and without a version suffix."""
    base = F.regexp_replace(_c(column), "." + extension.lstrip("."), "")
    return F.regexp_replace(base, "v.*", "")


def uri_local_name(column: Column | str, marker: str) -> Column:
    """Text between the first and a possible second `marker`, without the closing angle bracket."""
    parts = F.split(_c(column), f"\\Q{marker}\\E")
    return F.replace(F.get(parts, F.lit(1)), F.lit(">"), F.lit(""))


def topic_label(column: Column | str) -> Column:
    """Readable topic name: decoded parentheses and blanks for underscores."""
    opened = F.replace(_c(column), F.lit("%28"), F.lit("("))
    closed = F.replace(opened, F.lit("%29"), F.lit(")"))
    return F.replace(closed, F.lit("_"), F.lit(" "))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters beyond ASCII whose compatibility decomposition leaves one ASCII character, and those that leave several."""
    single, several = {}, {}
    for char in map(chr, range(0x80, sys.maxunicode + 1)):
        folded = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if folded:
            (single if len(folded) == 1 else several)[char] = folded
    return "".join(single), "".join(single.values()), several


@lru_cache(maxsize=1)
def _several_pattern() -> str:
    """A character class of the characters that fold to several, as ranges."""
    codes = sorted(map(ord, _fold_tables()[2]))
    firsts = [c for c in codes if chr(c - 1) not in _fold_tables()[2]]
    lasts = [c for c in codes if chr(c + 1) not in _fold_tables()[2]]
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(firsts, lasts)) + "]"


def ascii_fold(column: Column | str) -> Column:
    """Fold letters to ASCII by their compatibility decomposition and drop the rest.

    Characters that fold to one are translated. Ligatures and the like, which fold to
    several, are looked up one by one, only in texts that hold any.
    """
    source, target, several = _fold_tables()
    one_by_one = F.array_join(F.transform(F.split(_c(column), ""), _expanded), "")
    expanded = F.when(F.regexp_like(_c(column), F.lit(_several_pattern())), one_by_one).otherwise(_c(column))
    return F.regexp_replace(F.translate(expanded, source, target), r"[^\x00-\x7F]", "")


def _expanded(char: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in _fold_tables()[2].items() for x in pair])
    return F.when(char > "\x7f", F.coalesce(F.element_at(table, char), char)).otherwise(char)


@lru_cache(maxsize=8)
def outside_ascii(pattern: str) -> str:
    """The ASCII characters a one-character pattern matches."""
    return "".join(c for c in map(chr, range(1, 128)) if re.fullmatch(pattern, c))


def extraction_clean(column: Column | str) -> Column:
    """Text as key-phrase extraction reads it: ASCII, no URLs, plain punctuation."""
    folded = strip(ascii_fold(column))
    no_urls = F.regexp_replace(folded, fixed.URL, "")
    # Only ASCII is left, so deleting the listed characters equals the pattern and is cheaper.
    return F.translate(no_urls, outside_ascii(fixed.EXTRACTION_TEXT), "")


def keyword_clean(column: Column | str) -> Column:
    """Keyword without bracketed groups, only letters, dashes and blanks."""
    no_groups = F.regexp_replace(_c(column), "(?d)" + fixed.BRACKET_GROUPS, "")
    return strip(F.lower(F.regexp_replace(no_groups, fixed.KEYWORD_LETTERS, "")))


def abstract_clean(column: Column | str) -> Column:
    # Runs become one blank at once; they would be collapsed below anyway.
    plain = F.regexp_replace(_c(column), fixed.ALPHANUMERIC + "+", " ")
    unmarked = F.regexp_replace(plain, "(?i)abstract", "")
    return F.lower(F.regexp_replace(strip(unmarked), r"\s+", " "))


def dictionary_words(column: Column | str) -> Column:
    """Tokens as dictionaries see them: lower-case letter runs, anything else separates."""
    return F.array_remove(F.split(F.lower(_c(column)), fixed.DICTIONARY_TEXT), "")


def dictionary_text(column: Column | str) -> Column:
    return F.array_join(dictionary_words(column), " ")


def words_in_window(words: Column | str, shortest: int = fixed.SHORTEST_WORD, longest: int = fixed.LONGEST_KEPT_WORD) -> Column:
    return F.filter(_c(words), lambda w: F.length(w).between(shortest, longest))


def body_cut(column: Column | str) -> Column:
    """Drop everything up to the later of the two body markers' first occurrences.

    The cut always skips the length of the longer marker name; a marker at the
    very start does not cut.
    """
    text = _c(column)
    found = F.greatest(*[F.instr(text, marker) for marker in fixed.BODY_MARKERS]) - 1
    skipped = len(fixed.BODY_MARKERS[1])
    return F.when(found > 0, F.substring(text, found + skipped + 1, F.length(text))).otherwise(text)


def passes_fulltext_gate(words: Column | str) -> Column:
    """Enough words and none of them overlong."""
    words = _c(words)
    no_overlong = F.forall(words, lambda w: F.length(w) <= fixed.LONGEST_ALLOWED_WORD)
    return (F.size(words) > fixed.MIN_TEXT_WORDS) & no_overlong


def without_stop_words(words: Column | str, stop_words: list[str] | None = None) -> Column:
    stop_words = fixed.ENGLISH_STOP_WORDS if stop_words is None else stop_words
    return F.filter(_c(words), lambda w: ~w.isin(stop_words))


def fulltext_clean(column: Column | str, stop_words: list[str] | None = None) -> Column:
    """Full-text chain: lower case without digits and punctuation, no stop words, word window, letters only, body cut, gate.

    The window looks at whole words; what is no letter separates only afterwards, so
    `naïve` keeps its pieces. Null where the text does not pass the gate.
    """
    plain = F.regexp_replace(F.lower(_c(column)), fixed.DIGITS_PUNCTUATION, "")
    kept = F.array_join(words_in_window(without_stop_words(split_words(plain), stop_words)), " ")
    body = _bind(strip(F.regexp_replace(kept, r"[^a-z\s]+", " ")), body_cut)
    return _bind(body, lambda t: F.when(_bind(split_words(t), passes_fulltext_gate), strip(t)))


def inverted_index_text(column: Column | str, positional: bool = False) -> Column:
    """Words of an inverted index (JSON text) as one string.

    Default: the index keys in stored order. `positional` rebuilds the original
    word order from the stored positions.
    """
    parsed = F.from_json(_c(column), "InvertedIndex map<string,array<int>>")["InvertedIndex"]
    if not positional:
        return F.array_join(F.map_keys(parsed), " ")
    placed = F.flatten(
        F.transform(
            F.map_entries(parsed),
            lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("word"))),
        )
    )
    return F.array_join(F.transform(F.array_sort(placed), lambda s: s["word"]), " ")


def name_and_description(name: Column | str, description: Column | str) -> Column:
    return F.concat(_c(name), F.lit(" "), _c(description))


def keywords_in_chunks(keywords: Column | str, chunks: Column | str) -> Column:
    """Keywords that are part of at least one noun chunk."""
    chunks = _c(chunks)
    return F.filter(_c(keywords), lambda k: F.exists(chunks, lambda c: F.contains(F.lower(c), F.lower(k))))


def keywords_up_to_score(keywords: Column | str, limit: float) -> Column:
    """Names of the scored keywords whose score does not exceed `limit`."""
    kept = F.filter(_c(keywords), lambda k: k["score"] <= limit)
    return F.transform(kept, lambda k: k["keyword"])


def long_keywords(keywords: Column | str, chars: int = fixed.MIN_KEYWORD_CHARS) -> Column:
    kept = F.filter(_c(keywords), lambda k: F.length(k["keyword"]) > chars)
    return F.coalesce(kept, F.slice(F.array(F.struct(F.lit("").alias("keyword"), F.lit(0.0).alias("score"))), 1, 0))


def keyword_string(keywords: Column | str, longest: int) -> Column:
    """Keyword list as one comma-separated label of at most `longest` characters."""
    return F.substring(F.array_join(_c(keywords), ", "), 1, longest)


def null_to_empty(column: Column | str) -> Column:
    return F.coalesce(_c(column), F.lit(""))


def tfidf_words(column: Column | str, stop_words: list[str] | None = None) -> Column:
    """Word tokens of at least two characters after accent folding, without stop words."""
    folded = F.lower(ascii_fold(column))
    return without_stop_words(F.regexp_extract_all(folded, F.lit(f"({fixed.TFIDF_TOKEN})"), F.lit(1)), stop_words)
