"""Normalised keys, tokenizers and small text helpers as Column expressions.

Java's regular expressions are set to behave like the Unicode-aware ones the
results must match: ``(?U)`` makes ``\\s`` and ``\\b`` Unicode-aware and ``(?d)``
makes ``.`` stop only at ``\\n``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from entitylake.functions.binding import let, record

# The key and token rules that results depend on.
LEADING_ARTICLE = r"(?i)^(the|a|an)\s+"
NOT_NAME_KEY = r"[^a-zA-Z0-9 ]"
PARENTHESISED = r"(?dU)\s*\(.*?\)\s*"
TOKEN_SEPARATOR = r"[^a-z0-9]+"
MIN_TOKEN_LENGTH = 3
# Possessive repeats: the same words, found without a stack that grows with the word.
WORD = r"[\p{L}\p{N}]++(?:['.][\p{L}\p{N}]++)*+"
CLOCK = r"^(\d+):(\d+)"
OUTER_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
INNER_SPACE = r"(?U)[\s\x1c-\x1f]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space, Unicode's included, from both ends (``trim`` knows only blanks)."""
    return F.regexp_replace(col(c), OUTER_SPACE, "")


def squeeze(c: Column | str) -> Column:
    """Each run of white space becomes one blank; both ends stripped."""
    return F.trim(F.regexp_replace(col(c), INNER_SPACE, " "))


def blank_to_null(c: Column | str) -> Column:
    """``nullif(c, '')``, which would evaluate ``c`` twice."""
    return let(col(c), lambda v: F.when(v != "", v))


def first_match(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The group's text in the first match, null without one."""
    return blank_to_null(F.regexp_extract(col(c), pattern, group))


def all_matches(c: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def match_groups(c: Column | str, pattern: str, groups: int) -> Column:
    """All groups of the first match as an array, null without a match.

    The pattern is scanned twice whatever the number of groups, where one
    ``regexp_extract`` per group would scan it ``groups`` times.
    """
    separator = "\x1f"
    layout = separator.join(f"${{g{i}}}" for i in range(1, groups + 1))
    named = _name_groups(pattern)
    return let(
        F.regexp_extract(col(c), pattern, 0),
        lambda hit: F.when(
            hit != "", F.split(F.regexp_replace(hit, named, layout), separator)
        ),
    )


def _name_groups(pattern: str) -> str:
    """Give the capturing groups names g1, g2, ... so that ``${g1}0`` is not read as ``$10``."""
    numbers = iter(range(1, 1000))
    return re.sub(r"(?<!\\)\((?!\?)", lambda _: f"(?<g{next(numbers)}>", pattern)


def contains_any(c: Column | str, words: Iterable[str]) -> Column:
    """Whether any of the literal substrings occurs; one pass over the text."""
    return col(c).rlike("|".join(java_literal(w) for w in words))


def java_literal(word: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|\-])", r"\\\1", word)


def starts_with_any(c: Column | str, prefixes: Iterable[str]) -> Column:
    return col(c).rlike("^(?:" + "|".join(java_literal(p) for p in prefixes) + ")")


def count_of(c: Column, piece: str) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    return (F.length(c) - F.length(F.replace(c, F.lit(piece)))) / F.lit(len(piece))


def name_key(c: Column | str) -> Column:
    """Join key of an entity name.

    Only one leading article at position 0 is dropped, then everything but ASCII
    letters, digits and blanks.  Names in other scripts therefore share the key
    ``''``; inner double blanks stay.
    """
    without_article = F.regexp_replace(col(c), LEADING_ARTICLE, "")
    return F.lower(F.trim(F.regexp_replace(without_article, NOT_NAME_KEY, "")))


def variant_key(c: Column | str) -> Column:
    """Key shared by the variants of a title: parenthesised parts removed."""
    return F.lower(strip(F.regexp_replace(col(c), PARENTHESISED, "")))


def label_key(c: Column | str) -> Column:
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))


def tokens(c: Column | str) -> Column:
    """Search tokens: ASCII letters and digits, at least three characters long."""
    return F.filter(
        F.split(F.lower(col(c)), TOKEN_SEPARATOR),
        lambda t: F.length(t) >= MIN_TOKEN_LENGTH,
    )


def words(c: Column | str) -> Column:
    """Unicode words in lower case; ``r.e.m.`` gives ``r.e.m`` and ``u2`` stays."""
    return all_matches(F.lower(col(c)), WORD, 0)


def clock_seconds(c: Column | str) -> Column:
    """``m:ss`` to seconds; of ``h:mm:ss`` only the first two numbers count."""
    minutes, seconds = (F.regexp_extract(col(c), CLOCK, g).try_cast("int") for g in (1, 2))
    return minutes * 60 + seconds


def clock_text(c: Column | str) -> Column:
    """Seconds to ``m:ss``; ``?`` when missing or zero."""
    whole = F.floor(col(c))
    return F.when(
        col(c) != 0,
        F.format_string("%d:%02d", F.floor(whole / 60).cast("int"), (whole % 60).cast("int")),
    ).otherwise(F.lit("?"))


def sorted_unique(items: Column) -> Column:
    """Stripped, non-empty, distinct and sorted."""
    return F.sort_array(
        F.array_distinct(F.filter(F.transform(items, strip), lambda x: x != ""))
    )


def term_counts(token_list: Column) -> Column:
    """Array of (term, tf) of one token list, computed inside the row.

    The list is sorted once and run lengths are read off, so counting needs no
    explode and no shuffle, whatever the length of the text.
    """

    def runs(ordered: Column) -> Column:
        first_of_run = F.filter(
            F.sequence(F.lit(1), F.size(ordered)),
            lambda i: (i == 1)
            | (F.element_at(ordered, i) != F.element_at(ordered, F.greatest(i - 1, F.lit(1)))),
        )
        return let(
            first_of_run,
            lambda starts: F.transform(
                starts,
                lambda at, n: record(
                    term=F.element_at(ordered, at),
                    tf=F.coalesce(F.get(starts, n + 1), F.size(ordered) + 1) - at,
                ),
            ),
        )

    empty = F.array().cast("array<struct<term:string,tf:int>>")
    return let(
        F.sort_array(token_list),
        lambda ordered: F.when(F.size(ordered) > 0, runs(ordered)).otherwise(empty),
    )
