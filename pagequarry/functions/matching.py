"""Query analysis and term matching as Columns, evaluated in the JVM; and the same for Python text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation taken off a query word's ends, and what folding replaces.
LEADING = "([{\"'«“‘¿¡`"
TRAILING = ")]}([{\"'»”’`,;:!?."
FOLD_FROM = "àáâäãåæèéêëìíîïòóôöõœùúûüýÿñçß"
FOLD_TO = "aaaaaaaeeeeiiiioooooouuuuyyncs"
#: What may join the keywords in a page's stem.
STEM_JOINERS = ("", "-", "_", ".", " ")
#: Characters that may stand before a term that a line defines, besides white space.
LINE_LEADS = "*`-+|>_[\""

_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


# ---- one query, at plan time
def keywords_of(query: str, fold: bool = False) -> list[str]:
    """Lower-case keywords in order, without surrounding punctuation, empty ones and repeats."""
    words = (normalized_text(w.lstrip(LEADING).rstrip(TRAILING), fold) for w in query.split())
    return list(dict.fromkeys(w for w in words if w))


def normalized_text(text: str, fold: bool = False) -> str:
    text = text.lower()
    return text.translate(_FOLD) if fold else text


# ---- Columns
def unicode_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalized(text: Column, fold: bool = False) -> Column:
    text = F.lower(text)
    return F.translate(text, FOLD_FROM, FOLD_TO) if fold else text


def keywords(query: Column, fold: bool = False) -> Column:
    """As keywords_of, for a column; empty array for null and for queries of punctuation only."""
    lead, trail = F.lit(LEADING), F.lit(TRAILING)
    words = F.split(F.regexp_replace(F.coalesce(query, F.lit("")), r"(?U)\s+", " "), " ")
    words = F.transform(words, lambda w: normalized(F.rtrim(F.ltrim(w, lead), trail), fold))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def occurrences(text: Column, word: Column, cap: int) -> Column:
    """Non-overlapping occurrences as substrings, from the left, up to cap."""
    n = (F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)
    return F.least(F.lit(cap), n.cast("int"))


def _quoted(word: Column | str) -> Column:
    # Keywords are lower case, so they can't hold \E.
    return F.concat(F.lit(r"\Q"), F.lit(word) if isinstance(word, str) else word, F.lit(r"\E"))


def whole_words(text: Column, word: Column | str) -> Column:
    """Of the occurrences counted above, those with no ASCII letter or digit on either side.

    The alternation takes the same places as counting does; only whole ones fill the group.
    """
    q = _quoted(word)
    pattern = F.concat(F.lit("((?<![A-Za-z0-9])"), q, F.lit("(?![A-Za-z0-9]))|"), q)
    return F.size(F.filter(F.regexp_extract_all(text, pattern, F.lit(1)), lambda x: x != ""))


def starts_a_line(text: Column, word: Column | str) -> Column:
    """Whether a line starts with the word after leading white space and marks; what is skipped is never given back."""
    return F.regexp_like(text, F.concat(F.lit(r'(?U)(?:\A|\n)[\s*`+|>_\["-]*+'), _quoted(word)))


def stem_matches(stem: Column, words: Column) -> Column:
    """Whether a page's stem is the whole query, joined in one of the usual ways."""
    return F.array_contains(F.array(*[F.array_join(words, j) for j in STEM_JOINERS]), stem)


# ---- Python text, for kernels
_STRIP_LEADS = re.compile(r'[\s*`+|>_\["-]*')


def line_start(text: str, at: int) -> bool:
    """Whether text[at:] is what a line starts with, once leading white space and marks are skipped."""
    begin = text.rfind("\n", 0, at) + 1
    return _STRIP_LEADS.match(text, begin).end() == at


def is_whole(text: str, begin: int, end: int) -> bool:
    return not (begin and _ascii_word(text[begin - 1])) and not (end < len(text) and _ascii_word(text[end]))


def _ascii_word(ch: str) -> bool:
    return ch.isascii() and ch.isalnum()
