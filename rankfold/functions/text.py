"""Text operators as Column functions (all JVM-side)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankfold import fixed_values as fv
from rankfold.schema import text_or_empty

# Every character Python's str.strip() removes; SQL trim() removes only U+0020.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       "
    "         　"
)
LINE_BREAKS = "\\r\\n|[\\n\\x0b\\f\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"


def strip_space(column: Column) -> Column:
    return F.btrim(column, F.lit(WHITESPACE))


def split_lines(column: Column) -> Column:
    return F.split(column, LINE_BREAKS)


def any_of(conditions: Sequence[Column]) -> Column:
    """OR of many conditions as a balanced tree, so long lists stay shallow."""
    if not conditions:
        return F.lit(False)
    if len(conditions) == 1:
        return conditions[0]
    middle = len(conditions) // 2
    return any_of(conditions[:middle]) | any_of(conditions[middle:])


def contains_any(column: Column, words: Sequence[str]) -> Column:
    """Substring test against a short word list.

    A chain of ``contains`` compiles into the surrounding stage and stops at the
    first hit; a lambda over a literal array would be interpreted per element.
    """
    return any_of([column.contains(w) for w in words])


def word_pattern(words: Sequence[str]) -> str:
    """One alternation matching any phrase not glued to letters or digits."""
    phrases = "|".join(re.escape(w).replace(r"\ ", " ") for w in words)
    return rf"(^|[^a-z0-9])(?:{phrases})($|[^a-z0-9])"


def contains_word(column: Column, words: Sequence[str]) -> Column:
    """Whole-word test; the pattern only runs on texts that hold the letters at all."""
    return contains_any(column, words) & F.rlike(column, F.lit(word_pattern(words)))


def matches_any(column: Column, words: Sequence[str], match: str = "substring") -> Column:
    if match == "substring":
        return contains_any(column, words)
    if match == "word":
        return contains_word(column, words)
    if match == "exact":
        return column.isin(list(words))
    if match == "regex":
        return any_of([F.rlike(column, F.lit(w)) for w in words])
    raise ValueError(f"unknown match kind: {match}")


def search_text(title: Column, description: Column) -> Column:
    """Lower-cased title and description, the text keyword tests look at."""
    return F.lower(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(description)))


def has_signal(title: Column, description: Column, words: Sequence[str] = fv.SIGNAL_WORDS,
               match: str = "substring") -> Column:
    return matches_any(search_text(title, description), words, match)


def title_class(title: Column, seniority: Sequence[str] = fv.SENIORITY_WORDS,
                other: Sequence[str] = fv.OTHER_ROLE_WORDS,
                wanted: Sequence[str] = fv.WANTED_ROLE_WORDS,
                match: str = "substring") -> Column:
    """True for a wanted role that is neither senior nor of another profession."""
    lowered = F.lower(text_or_empty(title))
    return (
        ~matches_any(lowered, tuple(seniority) + tuple(other), match)
        & matches_any(lowered, wanted, match)
    )


def extract_urls(column: Column, href: str = fv.HREF_PATTERN,
                 link: str = fv.MARKDOWN_LINK_PATTERN) -> Column:
    """All href targets, then all markdown link targets."""
    return F.concat(
        F.regexp_extract_all(column, F.lit(href), F.lit(1)),
        F.regexp_extract_all(column, F.lit(link), F.lit(1)),
    )


def pick_url(urls: Column, preferred: Sequence[str] = fv.APPLY_URL_WORDS,
             avoided: Sequence[str] = fv.AVOIDED_URL_WORDS,
             last_resort: Sequence[str] = fv.LAST_RESORT_URL_WORDS) -> Column:
    """First preferred link, else first not avoided, else last resort, else the last, else ''."""

    def first(test) -> Column:
        return F.get(F.filter(urls, test), F.lit(0))

    return F.coalesce(
        first(lambda u: contains_any(F.lower(u), preferred)),
        first(lambda u: ~contains_any(u, avoided)),
        first(lambda u: contains_any(u, last_resort)),
        F.try_element_at(urls, F.lit(-1)),
        F.lit(""),
    )


def clean_cell(column: Column, steps: Sequence[tuple[str, str]] = fv.CELL_CLEANING) -> Column:
    """Visible text of a table cell."""
    cleaned = reduce(
        lambda c, step: F.regexp_replace(c, step[0], step[1]), steps, text_or_empty(column)
    )
    return strip_space(cleaned)


def looks_like_shell(html: Column, markers: Sequence[str] = fv.SHELL_MARKERS) -> Column:
    return contains_any(html, markers)


def is_thin_page(text: Column, html: Column, min_chars: int = fv.THIN_PAGE_CHARS,
                 markers: Sequence[str] = fv.SHELL_MARKERS) -> Column:
    return (F.char_length(text) < min_chars) & looks_like_shell(html, markers)


def cut(column: Column, chars: int | None) -> Column:
    """The first ``chars`` characters; None keeps the whole text."""
    return column if chars is None else F.substring(column, 1, chars)


def title_case(column: Column) -> Column:
    """Capital first letter of every run of letters (initcap only knows blanks)."""
    runs = F.regexp_extract_all(column, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")
