"""String functions as Column builders: no action, no UDF, so they work in batch and in streams.

Positions are 0-based and count characters. A null string gives null unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import regex



def char_class(test: Callable[[str], bool]) -> str:
    """The inside of a character class: the characters up to U+FFFF that pass; no predicate knows others."""
    out: list[list[int]] = []
    for c in range(0x10000):
        if test(chr(c)):
            if out and c == out[-1][1] + 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)


# A digit has a digit's value (superscripts and circled ones too), a number any value (fractions, Roman and Chinese ones too).
_ALPHA = r"a-zA-Z[\p{L}&&[^\x{10000}-\x{10ffff}]]"
_DIGIT, _NUMERIC, _DECIMAL = map(char_class, (str.isdigit, str.isnumeric, str.isdecimal))
_SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANK = r"[\x00-\x20]+"


def _all(s: Column, chars: str) -> Column:
    return s.rlike(rf"\A[{chars}]+\z")


def _i(x: Column) -> Column:
    return x.cast("int")


# Attributes and predicates


def length(s: Column) -> Column:
    """Characters."""
    return F.char_length(s)


def byte_count(s: Column) -> Column:
    """UTF-8 bytes."""
    return F.octet_length(s)


def is_null(s: Column, empty_is_null: bool = False) -> Column:
    """Whether the row is null, or empty if that counts; never null itself."""
    return s.isNull() | ((s == "") & F.lit(empty_is_null)).eqNullSafe(True)


def isalnum(s: Column) -> Column:
    """Letters and numbers only, at least one."""
    return _all(s, _ALPHA + _NUMERIC)


def isalpha(s: Column) -> Column:
    """Letters only, at least one."""
    return _all(s, _ALPHA)


def isdigit(s: Column) -> Column:
    """Digits only, superscripts and circled ones included."""
    return _all(s, _DIGIT)


def isspace(s: Column) -> Column:
    """White space only."""
    return _all(s, _SPACE)


def isdecimal(s: Column) -> Column:
    """Decimal digits only."""
    return _all(s, _DECIMAL)


def isnumeric(s: Column) -> Column:
    """Numbers of any kind only."""
    return _all(s, _NUMERIC)


def islower(s: Column) -> Column:
    """Not empty and no letter that isn't a small one."""
    return (s != "") & ~s.rlike(r"[\p{L}&&[^\p{Ll}]]")


def isupper(s: Column) -> Column:
    """Not empty and no letter that isn't a capital."""
    return (s != "") & ~s.rlike(r"[\p{L}&&[^\p{Lu}]]")


def is_empty(s: Column) -> Column:
    """Whether the string is empty."""
    return s == ""


# Case


def lower(s: Column) -> Column:
    """Small letters."""
    return F.lower(s)


def upper(s: Column) -> Column:
    """Capitals, one for one: a sharp s stays."""
    return F.array_join(F.transform(F.split(s, "ß"), F.upper), "ß")


def capitalize(s: Column) -> Column:
    """First character a capital, the rest small."""
    return F.concat(_upper1(F.substring(s, 1, 1)), F.lower(F.substr(s, F.lit(2))))


def _upper1(c: Column) -> Column:
    """The capital of a single character."""
    return F.when(c == "ß", c).otherwise(F.upper(c))


def swapcase(s: Column) -> Column:
    """Capitals for small letters and the reverse."""
    return F.array_join(F.transform(F.split(s, ""), lambda c: F.when(c == F.lower(c), _upper1(c)).otherwise(F.lower(c))), "")


def title(s: Column) -> Column:
    """Each run of letters starts with a capital, the rest is small."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(s), F.lit(r"(\p{L}+|\P{L}+)"), 1), lambda r: F.concat(_upper1(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))), "")


# Combining


def cat(columns: list[Column], sep: str = "", na_rep: str | None = None) -> Column:
    """Row by row, with sep between; a null gives null unless na_rep stands in for it."""
    if na_rep is not None:
        columns = [F.coalesce(c, F.lit(na_rep)) for c in columns]
    parts = [columns[0]]
    for c in columns[1:]:
        parts += [F.lit(sep), c]
    return F.concat(*parts)


# Splitting


def split_record(s: Column, delimiter: str | None = None, n: int = -1) -> Column:
    """Parts as an array, at most n splits. Without a delimiter, runs of blanks split and a blank row gives one empty part."""
    limit = n + 1 if n > 0 else -1
    if delimiter is not None:
        return F.split(s, regex.quote(delimiter), limit)
    parts = F.filter(F.split(F.regexp_replace(s, r"\A[\x00-\x20]+", ""), BLANK, limit), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(parts)


def rsplit_record(s: Column, delimiter: str | None = None, n: int = -1) -> Column:
    """The same from the right."""
    return F.reverse(F.transform(split_record(F.reverse(s), delimiter[::-1] if delimiter else None, n), F.reverse))


def split(s: Column, width: int, delimiter: str | None = None, n: int = -1) -> list[Column]:
    """Columns of parts; missing ones are null."""
    parts = split_record(s, delimiter, n)
    return [F.get(parts, i) for i in range(width)]


def rsplit(s: Column, width: int, delimiter: str | None = None, n: int = -1) -> list[Column]:
    """The same from the right."""
    parts = rsplit_record(s, delimiter, n)
    return [F.get(parts, i) for i in range(width)]


def partition(s: Column, delimiter: str = " ") -> Column:
    """[before, delimiter, after] of the first one; [s, "", ""] without."""
    at = F.locate(delimiter, s)
    return F.when(s.isNull(), F.array(*[F.lit(None).cast("string")] * 3)).when(at == 0, F.array(s, F.lit(""), F.lit(""))).otherwise(
        F.array(F.substr(s, F.lit(1), at - 1), F.lit(delimiter), F.substr(s, at + len(delimiter)))
    )


def rpartition(s: Column, delimiter: str = " ") -> Column:
    """[before, delimiter, after] of the last one; ["", "", s] without."""
    after = F.substring_index(s, delimiter, -1)
    return F.when(s.isNull(), F.array(*[F.lit(None).cast("string")] * 3)).when(F.locate(delimiter, s) == 0, F.array(F.lit(""), F.lit(""), s)).otherwise(
        F.array(F.substr(s, F.lit(1), F.char_length(s) - F.char_length(after) - len(delimiter)), F.lit(delimiter), after)
    )


# Substrings


def get(s: Column, i: int) -> Column:
    """The i-th character; empty past the end."""
    return F.substring(s, i + 1, 1)


def slice_(s: Column, start: int, stop: int | None = None, step: int | None = None) -> Column:
    """Characters start to stop, which is the end if null or not positive; every step-th."""
    if stop is not None and stop > 0 and start > stop:
        raise ValueError("start is after stop")
    part = F.substr(s, F.lit(start + 1), F.lit(stop - start)) if stop and stop > 0 else F.substr(s, F.lit(start + 1))
    if step and step > 1:
        return F.array_join(F.filter(F.split(part, ""), lambda c, i: i % step == 0), "")
    return part


def slice_from(s: Column, starts: Column, stops: Column) -> Column:
    """Characters from and to each row's own places; a stop that isn't positive is the end."""
    return F.when(stops > 0, F.substr(s, starts + 1, F.greatest(stops - starts, F.lit(0)))).otherwise(F.substr(s, starts + 1))


def slice_replace(s: Column, start: int, stop: int | None, repl: str) -> Column:
    """repl in place of characters start to stop; appended if start is past the end."""
    n = F.char_length(s)
    tail = F.substr(s, F.lit(stop + 1)) if stop is not None else F.lit("")
    return F.when(n <= start, F.concat(s, F.lit(repl))).otherwise(F.concat(F.substr(s, F.lit(1), F.lit(start)), F.lit(repl), tail))


def insert(s: Column, start: int, repl: str) -> Column:
    """repl at a place; -1 appends; past the end nothing changes."""
    if start < 0:
        return F.concat(s, F.lit(repl))
    return F.when(F.char_length(s) < start, s).otherwise(F.concat(F.substr(s, F.lit(1), F.lit(start)), F.lit(repl), F.substr(s, F.lit(start + 1))))


def repeat(s: Column, n: int) -> Column:
    """n copies, one at least."""
    return F.repeat(s, max(n, 1))


def ljust(s: Column, width: int, fill: str = " ") -> Column:
    """Padded at the right; never cut."""
    return F.when(F.char_length(s) < width, F.rpad(s, width, fill[0])).otherwise(s)


def rjust(s: Column, width: int, fill: str = " ") -> Column:
    """Padded at the left; never cut."""
    return F.when(F.char_length(s) < width, F.lpad(s, width, fill[0])).otherwise(s)


def center(s: Column, width: int, fill: str = " ") -> Column:
    """Padded at both ends, the odd one at the right."""
    lack = F.greatest(F.lit(width) - F.char_length(s), F.lit(0))
    left = _i(F.floor(lack / 2))
    return F.concat(F.repeat(F.lit(fill[0]), left), s, F.repeat(F.lit(fill[0]), _i(lack) - left))


def pad(s: Column, width: int, side: str = "left", fill: str = " ") -> Column:
    """Padded at the left, the right or both."""
    if not fill:
        raise ValueError("fill is empty")
    return {"left": rjust, "right": ljust, "both": center}[side](s, width, fill)


def zfill(s: Column, width: int) -> Column:
    """Zeros after a sign, up to the width."""
    sign = F.regexp_extract(s, r"\A[+-]", 0)
    lack = F.greatest(F.lit(width) - F.char_length(s), F.lit(0))
    return F.concat(sign, F.repeat(F.lit("0"), _i(lack)), F.substr(s, F.char_length(sign) + 1))


def wrap(s: Column, width: int) -> Column:
    """Greedy lines of a width: of the blanks before a word that wouldn't fit, the last becomes a line's end. Longer words stay whole.

    A line is the longest text within the width that ends a word, else a whole word, else blanks at the start; so the work is in proportion to the text.
    """
    line = rf"(?s)\G((?:.{{0,{max(width, 1) - 1}}}[^ ] *|[^ ]+ *)(?=\z| [^ ])| *(?= [^ ])| +(?=\z))(?: |\z)"
    return F.array_join(F.regexp_extract_all(F.regexp_replace(s, r"[\x00-\x20]", " "), F.lit(line), 1), "\n")


def strip(s: Column, chars: str | None = None) -> Column:
    """Without those characters at both ends; blank, tab and line feed by default."""
    return F.btrim(s, F.lit(" \n\t" if chars is None else chars))


def lstrip(s: Column, chars: str | None = None) -> Column:
    """The same at the left."""
    return F.ltrim(s, F.lit(" \n\t" if chars is None else chars))


def rstrip(s: Column, chars: str | None = None) -> Column:
    """The same at the right."""
    return F.rtrim(s, F.lit(" \n\t" if chars is None else chars))


# Replacing


def replace(s: Column, pat: str, repl: str | None, n: int = -1, is_regex: bool = True) -> Column:
    """Matches, all or the first n, by a literal text."""
    if not pat:
        raise ValueError("pattern is empty")
    repl = repl or ""
    if n < 0:
        return F.regexp_replace(s, regex.to_java(pat), regex.plain_replacement(repl)) if is_regex else F.replace(s, F.lit(pat), F.lit(repl))
    java = regex.to_java(pat) if is_regex else regex.quote(pat)
    parts = F.split(s, java, n + 1)
    return F.array_join(parts, repl)


def replace_multi(s: Column, pats: list[str], repls: list[str]) -> Column:
    """Literal targets in one pass from the left, the first in the list first; one replacement may serve all."""
    repls = repls * len(pats) if len(repls) == 1 else repls
    if len(repls) != len(pats):
        raise ValueError("as many replacements as targets, or one")
    known = dict(zip(reversed(pats), reversed(repls), strict=True))
    if all(len(p) == 1 and len(r) <= 1 for p, r in known.items()):
        return translate(s, known)
    table = F.create_map(*[F.lit(x) for p, r in known.items() for x in (p, r)])
    starts = "".join(sorted({regex.quote(p[0]) for p in pats}))
    pieces = F.regexp_extract_all(s, F.lit("(?s)(" + "|".join(map(regex.quote, pats)) + f"|[^{starts}]+|.)"), 1)
    return F.array_join(F.transform(pieces, lambda x: F.coalesce(F.try_element_at(table, x), x)), "")


def replace_multi_regex(s: Column, pats: list[str], repls: list[str]) -> Column:
    """The same with patterns: at each place the first that matches there."""
    repls = repls * len(pats) if len(repls) == 1 else repls
    if len(repls) != len(pats):
        raise ValueError("as many replacements as targets, or one")
    java = [regex.to_java(p)[len(regex.FLAGS) :] for p in pats]
    pieces = F.regexp_extract_all(s, F.lit(f"{regex.FLAGS}((?:" + ")|(?:".join(java) + ")|[\\s\\S])"), 1)

    def one(x: Column) -> Column:
        out = x
        for p, r in reversed(list(zip(java, repls, strict=True))):
            out = F.when(x.rlike(rf"{regex.FLAGS}\A(?:{p})\z"), F.lit(r)).otherwise(out)
        return out

    return F.array_join(F.transform(pieces, one), "")


def replace_with_backrefs(s: Column, pat: str, template: str) -> Column:
    """All matches by a template with \\1 for group 1."""
    return F.regexp_replace(s, regex.to_java(pat), regex.backrefs(template, regex.groups(pat)))


def fillna(s: Column, repl: str | Column) -> Column:
    """A text or another column for nulls."""
    if repl is None:
        raise ValueError("no replacement")
    return F.coalesce(s, repl if isinstance(repl, Column) else F.lit(repl))


def translate(s: Column, table: dict[str, str | None]) -> Column:
    """Characters by characters; null deletes."""
    keep = {k: v for k, v in table.items() if v}
    return F.translate(s, "".join([*keep, *(k for k in table if k not in keep)]), "".join(keep.values()))


def url_encode(s: Column) -> Column:
    """Percent encoding of all but A-Z a-z 0-9 . _ ~ -"""
    return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_decode(s: Column) -> Column:
    """Percent decoding; a plus stays, and so does a row with a malformed code."""
    return F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)


# Searching


def compare(s: Column, target: str) -> Column:
    """Difference of the first bytes that differ; else 1, 0 or -1 by length."""
    t = target.encode()
    h, n = F.hex(F.encode(s, "UTF-8")), F.octet_length(s)
    diffs = F.array(*(F.when(n > i, F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int") - b) for i, b in enumerate(t)))
    first = F.get(F.filter(diffs, lambda d: d != 0), 0)
    return F.when(s.isNotNull(), F.coalesce(first, F.signum(n - len(t)).cast("int")))


def find(s: Column, sub: str, start: int = 0, end: int | None = None) -> Column:
    """Place of the first occurrence in start to end, or -1; an empty one isn't found."""
    if not sub:
        return F.when(s.isNotNull(), F.lit(-1))
    part = s if end is None else F.substr(s, F.lit(1), F.lit(end))
    return F.locate(sub, part, start + 1) - 1


def rfind(s: Column, sub: str, start: int = 0, end: int | None = None) -> Column:
    """Place of the last occurrence in start to end, or -1."""
    part = F.substr(s, F.lit(start + 1), F.lit(end - start)) if end is not None else F.substr(s, F.lit(start + 1))
    at = F.locate(sub[::-1], F.reverse(part))
    return F.when(at == 0, F.lit(-1)).otherwise(F.char_length(part) - at - len(sub) + 1 + start)


def index(s: Column, sub: str, start: int = 0, end: int | None = None) -> Column:
    """find that raises where there is none."""
    at = find(s, sub, start, end)
    return F.when(at < 0, F.raise_error(F.lit("substring not found")).cast("int")).otherwise(at)


def rindex(s: Column, sub: str, start: int = 0, end: int | None = None) -> Column:
    """rfind that raises where there is none."""
    at = rfind(s, sub, start, end)
    return F.when(at < 0, F.raise_error(F.lit("substring not found")).cast("int")).otherwise(at)


def find_from(s: Column, sub: str, starts: Column, ends: Column | None = None) -> Column:
    """find with each row's own places; an end that isn't positive is the string's."""
    part = s if ends is None else F.when(ends > 0, F.substr(s, F.lit(1), ends)).otherwise(s)
    return F.call_function("locate", F.lit(sub), part, starts + 1) - 1


def find_multiple(s: Column, targets: list[str]) -> Column:
    """Array of the places of each target."""
    return F.array(*(find(s, t) for t in targets))


def contains(s: Column, pat: str, is_regex: bool = True) -> Column:
    """Whether the pattern matches anywhere; never in an empty string."""
    return (s != "") & s.rlike(regex.to_java(pat)) if is_regex else F.contains(s, F.lit(pat))


def match(s: Column, pat: str) -> Column:
    """Whether the pattern matches at the start."""
    return (s != "") & s.rlike(r"\A(?:" + regex.to_java(pat) + ")")


def match_strings(s: Column, other: Column) -> Column:
    """Equality in which null equals null."""
    return s.eqNullSafe(other)


def count(s: Column, pat: str) -> Column:
    """Matches that don't overlap; 0 for null and the empty string."""
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(0)).otherwise(F.regexp_count(s, F.lit(regex.to_java(pat))))


def startswith(s: Column, pat: str) -> Column:
    """Whether the string starts so."""
    return F.startswith(s, F.lit(pat))


def endswith(s: Column, pat: str) -> Column:
    """Whether the string ends so."""
    return F.endswith(s, F.lit(pat))


def findall_record(s: Column, pat: str) -> Column:
    """Array of all matches."""
    return F.regexp_extract_all(s, F.lit(regex.to_java(pat)), 0)


def findall(s: Column, pat: str, width: int) -> list[Column]:
    """Columns of matches; missing ones are null."""
    found = findall_record(s, pat)
    return [F.get(found, i) for i in range(width)]


def extract(s: Column, pat: str) -> list[Column]:
    """A column for each group of the first match; null without one or if empty."""
    java = regex.to_java(pat)
    return [F.when(s.rlike(java), F.nullif(F.regexp_extract(s, java, g + 1), F.lit(""))) for g in range(regex.groups(pat))]


def extract_record(s: Column, pat: str) -> Column:
    """The same as an array."""
    return F.array(*extract(s, pat))
