"""The regular-expression dialect, translated to Java's.

`^` and `$` match at lines (\\n alone), `.` excludes \\n alone, `\\Z` is the very end,
classes are Unicode, and negated classes exclude \\n. Malformed patterns raise.
"""

from __future__ import annotations

import re

FLAGS = "(?mdU)"


def to_java(pattern: str) -> str:
    """The pattern for Spark's regexp functions."""
    out, i, inside = [FLAGS], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n == "Z" and not inside:
                out.append(r"\z")
            elif n in "WD" and not inside:
                out.append(f"[^\\{n.lower()}\\n]")
            elif m := re.match(r"[0-7]{1,3}", pattern[i + 1 :]):
                out.append(f"\\x{{{int(m[0], 8):x}}}")
                i += len(m[0]) - 1
            else:
                out.append(c + n)
            i += 2
            continue
        if inside:
            inside = c != "]"
            out.append("\\[" if c == "[" else "\\&" if c == "&" else c)
        elif c == "[":
            inside = True
            if pattern[i + 1 : i + 2] == "^":
                out.append(r"[^\n")
                i += 1
            else:
                out.append(c)
            if pattern[i + 1 : i + 2] == "]":
                out.append(r"\]")
                i += 1
        else:
            out.append(c)
        i += 1
    if inside:
        raise ValueError(f"unterminated class in {pattern!r}")
    return "".join(out)


def quote(literal: str) -> str:
    """A pattern that matches the literal."""
    return "".join("\\" + c if c in r"\.[]{}()<>*+-=!?^$|&#" else c for c in literal)


def plain_replacement(text: str) -> str:
    """A replacement that stands for itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def groups(pattern: str) -> int:
    """Number of capturing groups."""
    n, inside, i = 0, False, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
        elif inside:
            inside = pattern[i] != "]"
        elif pattern[i] == "[":
            inside = True
        elif pattern[i] == "(" and pattern[i + 1 : i + 2] != "?":
            n += 1
        i += 1
    return n


def backrefs(template: str, count: int) -> str:
    """A template with \\N for group N as a Java replacement; groups that don't exist give nothing."""
    out, i = [], 0
    while i < len(template):
        m = re.match(r"\\(\d+)", template[i:])
        if m:
            if int(m[1]) <= count:
                out.append("$" + m[1])
            i += len(m[0])
        else:
            out.append(plain_replacement(template[i]))
            i += 1
    return "".join(out)
