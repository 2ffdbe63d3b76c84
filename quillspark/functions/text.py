"""Text functions: tokens, counts, distances, as Column builders. A null counts as the empty string."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import regex


def _class(delimiter: str | None) -> str:
    return r"\x00-\x20" if delimiter is None else regex.quote(delimiter)


def tokens(s: Column, delimiter: str | list[str] | None = None) -> Column:
    """Array of tokens. Delimiters: blanks, any character of a text, or each text of a list, the first in it first."""
    pat = "(?:" + "|".join(map(regex.quote, delimiter)) + ")+" if isinstance(delimiter, list) else f"[{_class(delimiter)}]+"
    return F.filter(F.split(F.coalesce(s, F.lit("")), pat, -1), lambda x: x != "")


def _equals(target: str) -> Callable[[Column], Column]:
    return lambda x: x == target


def token_count(s: Column, delimiter: str | None = " ") -> Column:
    """Number of tokens."""
    return F.size(tokens(s, delimiter))


def contains_strings(s: Column, targets: list[str]) -> Column:
    """Array: whether each target occurs."""
    return F.array(*(F.coalesce(F.contains(s, F.lit(t)), F.lit(False)) for t in targets))


def strings_counts(s: Column, targets: list[str]) -> Column:
    """Array: occurrences of each target that don't overlap."""
    s = F.coalesce(s, F.lit(""))
    return F.array(*(((F.char_length(s) - F.char_length(F.replace(s, F.lit(t), F.lit("")))) / len(t)).cast("int") for t in targets))


def tokens_counts(s: Column, targets: list[str], delimiter: str | None = " ") -> Column:
    """Array: tokens equal to each target."""
    found = tokens(s, delimiter)
    return F.array(*(F.size(F.filter(found, _equals(t))) for t in targets))


def replace_tokens(s: Column, targets: list[str], repls: list[str], delimiter: str | None = None) -> Column:
    """Whole tokens replaced, what separates them kept; one replacement may serve all."""
    repls = repls * len(targets) if len(repls) == 1 else repls
    if len(repls) != len(targets):
        raise ValueError("as many replacements as targets, or one")
    table = F.create_map(*[F.lit(x) for t, r in dict(zip(reversed(targets), reversed(repls), strict=True)).items() for x in (t, r)])
    c = _class(delimiter)
    pieces = F.regexp_extract_all(s, F.lit(f"([{c}]+|[^{c}]+)"), 1)
    return F.array_join(F.transform(pieces, lambda x: F.coalesce(F.try_element_at(table, x), x)), "")


def normalize_spaces(s: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"[\x00-\x20]+", " "))


def edit_distance(s: Column, target: str | Column) -> Column:
    """Levenshtein distance in characters."""
    t = target if isinstance(target, Column) else F.lit(target)
    return F.levenshtein(F.coalesce(s, F.lit("")), F.coalesce(t, F.lit("")))


def porter_stemmer_measure(s: Column, vowels: str = "aeiou", y: str = "y") -> Column:
    """Changes from a run of vowels to a consonant; y is a consonant at the start and after a vowel."""
    v, w = regex.quote(vowels), regex.quote(y)
    sure = F.regexp_replace(F.coalesce(s, F.lit("")), rf"(?:(?<=[{v}])|\A)[{w}]", "\x01")  # y as a consonant
    return F.regexp_count(sure, F.lit(rf"[{v}{w}]++[^{v}{w}]"))
