"""Conversions between strings and numbers, booleans, addresses and times, as Column builders.

Numbers without a sign of 32 bits are longs. ANSI-safe: nothing raises on bad text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"s": 1_000_000, "ms": 1_000, "us": 1}


def stol(s: Column) -> Column:
    """Leading sign and digits, wrapped to 64 bits; 0 without."""
    digits = F.regexp_extract(s, r"\A[+-]?([0-9]+)", 1)
    size = F.char_length(digits)
    # Long ones: nine digits at a time, modulo 2^64.
    parts = F.regexp_extract_all(F.lpad(digits, ((F.floor(size / 9) + 1) * 9).cast("int"), "0"), F.lit("([0-9]{9})"), 1)
    modulus = F.lit(str(2**64)).cast("decimal(20,0)")
    step = lambda a, x: ((a * F.lit(10**9).cast("decimal(10,0)") + x.cast("decimal(9,0)")) % modulus).cast("decimal(20,0)")
    folded = F.aggregate(parts, F.lit(0).cast("decimal(20,0)"), step)
    wrapped = F.when(folded >= F.lit(str(2**63)).cast("decimal(20,0)"), folded - modulus).otherwise(folded).cast("decimal(20,0)").cast("bigint")
    value = F.when(size == 0, F.lit(0).cast("bigint")).when(size <= 18, digits.try_cast("bigint")).otherwise(wrapped)
    return F.when(s.isNotNull(), F.when(F.startswith(s, F.lit("-")) & (value != -(2**63)), -value).otherwise(value))


def stoi(s: Column) -> Column:
    """The same, wrapped to 32 bits."""
    low = stol(s).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= 2**31, low - 2**32).otherwise(low).cast("int")


def stod(s: Column) -> Column:
    """Leading number, nan, inf or -inf; 0 without."""
    n = F.regexp_extract(s, r"\A[+-]?[0-9]*[.]?[0-9]*([eE][+-]?[0-9]+)?", 0).try_cast("double")
    special = F.when(s == "nan", F.lit(float("nan"))).when(s == "inf", F.lit(float("inf"))).when(s == "-inf", F.lit(float("-inf")))
    return F.when(s.isNotNull(), F.coalesce(special, F.when(F.abs(n) < 1e-308, F.lit(0.0)).otherwise(n), F.lit(0.0)))


def stof(s: Column) -> Column:
    """stod in single precision."""
    return stod(s).cast("float")


def htoi(s: Column) -> Column:
    """Base 16 of the alphanumeric characters, wrapped to 32 bits; G to Z count as 16 to 35."""
    digit = lambda c: F.when(c == "", F.lit(0)).when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(F.upper(c)) - 55).cast("bigint")
    return F.aggregate(F.split(F.regexp_replace(s, "[^0-9A-Za-z]", ""), ""), F.lit(0).cast("bigint"), lambda a, c: F.when(c == "", a).otherwise((a * 16 + digit(c)).bitwiseAND(F.lit(0xFFFFFFFF))))


def to_booleans(s: Column, true: str = "True") -> Column:
    """Whether the string is the text for true."""
    return s == true


def from_booleans(b: Column, true: str = "True", false: str = "False") -> Column:
    """The texts for true and false."""
    return F.when(b, F.lit(true)).when(~b, F.lit(false))


def ip2int(s: Column) -> Column:
    """Four parts with dots, their digits alone; else 0."""
    parts = F.split(s, "[.]", -1)
    value = F.aggregate(F.transform(parts, lambda x: F.coalesce(F.regexp_replace(x, "[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    return F.when(s.isNull(), F.lit(None)).when(F.size(parts) != 4, F.lit(0).cast("bigint")).otherwise(value)


def int2ip(v: Column) -> Column:
    """Dotted quad."""
    v = v.cast("bigint")
    return F.concat_ws(".", *(F.shiftright(v, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)))


def itos(v: Column) -> Column:
    """Decimal digits."""
    return v.cast("string")


ltos = itos


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), 0)


def dtos(v: Column) -> Column:
    """At most 10 significant digits, one decimal at least; d.ddde+XX above 1e9 and below 1e-4."""
    a = F.abs(v)
    trim = lambda x: F.regexp_replace(F.regexp_replace(x, "0+$", ""), "[.]$", ".0")

    def write(x: Column) -> Column:  # d.ddddddddde+XX
        digits, e = F.concat(F.substring(x, 1, 1), F.substring(x, 3, 9)), F.substring(x, 13, 4).try_cast("int")
        science = F.concat(trim(F.substring(x, 1, 11)), F.substr(x, F.lit(12)))
        whole = F.when(e == 9, F.format_string("%.1f", a)).otherwise(F.concat(F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2)))
        return F.when((a > 1e9) | (a < 1e-4), science).otherwise(trim(F.when(a < 1, F.format_string("%.9f", a)).otherwise(whole)))

    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    body = F.when(a == 0, F.lit("0.0")).otherwise(_let(F.format_string("%.9e", a), write))
    return F.when(v.isNull(), F.lit(None)).when(F.isnan(v), F.lit("NaN")).when(a == float("inf"), F.concat(sign, F.lit("Inf"))).otherwise(F.concat(sign, body))


def ftos(v: Column) -> Column:
    """dtos of a single-precision number."""
    return dtos(v.cast("double"))


#: The int whose hash() in Spark, with the seed 42 there, is 31: what follows it in one hash() has the seed 31.
_SEED_31 = -253957332


def hash32(s: Column) -> Column:
    """MurmurHash3 x86_32 with seed 31 over the UTF-8 bytes, from built-in functions alone.

    Spark's hash() mixes whole words of four bytes in the same way and differs for the bytes behind them. So it takes
    the text's whole words, its last steps are undone, and the bytes behind and the last steps follow.
    """
    mask = F.lit(0xFFFFFFFF)

    def mul(x: Column, b: int) -> Column:
        return _let(x, lambda a: (a * (b & 65535) + (a * (b >> 16)).bitwiseAND(65535) * 65536).bitwiseAND(mask))

    def rot(x: Column, r: int) -> Column:
        return _let(x, lambda a: F.shiftleft(a, r).bitwiseAND(mask).bitwiseOR(F.shiftright(a, 32 - r)))

    def fold(x: Column, *by: int) -> Column:
        return _let(x, lambda a: reduce(lambda y, r: y.bitwiseXOR(F.shiftright(a, r)), by, a))

    mixed = lambda k: mul(rot(mul(k, 0xCC9E2D51), 15), 0x1B873593)
    data = s.cast("string").cast("binary")
    n = F.octet_length(data)
    whole = n - n % 4
    h = F.hash(F.lit(_SEED_31), F.substr(data, F.lit(1), whole)).cast("bigint").bitwiseAND(mask)
    undone = fold(mul(fold(mul(fold(h, 16), 0x7ED1B41D), 13, 26), 0xA5CB9243), 16)
    t = F.rpad(F.hex(F.substr(data, whole + 1)), 6, "0")  # up to three bytes in hexadecimal digits, the first the lowest
    tail = F.when(n % 4 > 0, mixed(F.conv(F.concat(*(F.substring(t, k, 2) for k in (5, 3, 1))), 16, 10).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    x = undone.bitwiseXOR(whole.cast("bigint")).bitwiseXOR(tail).bitwiseXOR(n.cast("bigint"))
    return F.when(s.isNotNull(), fold(mul(fold(mul(fold(x, 16), 0x85EBCA6B), 13), 0xC2B2AE35), 16))


def _i(x: Column) -> Column:
    return x.cast("int")


_WIDTH = {"Y": 4, "y": 2, "m": 2, "d": 2, "H": 2, "I": 2, "M": 2, "S": 2, "f": 6, "j": 3, "p": 2, "z": 5, "Z": 3, "a": 3, "b": 3, "w": 1, "U": 2, "W": 2}
_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def _pieces(fmt: str, units: str) -> list[tuple[str, str, int]]:
    """(specifier or nothing, literal, width) of each part of a format. Fractions of seconds have 3, 6 or 9 digits by unit."""
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] != "%" or fmt[i + 1 : i + 2] == "%":
            out.append(("", fmt[i], 1))
            i += 1 + (fmt[i] == "%")
            continue
        c = fmt[i + 1 : i + 2]
        if c not in _WIDTH and c not in ("A", "B"):
            raise ValueError(f"unknown specifier %{c}")
        out.append((c, "", {"ms": 3, "ns": 9}.get(units, 6) if c == "f" else _WIDTH.get(c, 0)))
        i += 2
    return out


def timestamp2int(s: Column, fmt: str = "%Y-%m-%dT%H:%M:%SZ", units: str = "s") -> Column:
    """Fields at fixed places, literals unchecked, to an integer in units Y M D h m s ms us ns; 0 for empty or short text."""
    at, field, sign = 0, {}, F.lit(1)
    for c, _, n in _pieces(fmt, units):
        if c in ("A", "B"):
            raise ValueError(f"%{c} has no fixed width, so it can't be read")
        if c:
            field[c] = F.substring(s, at + 1, n)
        at += n
    num = lambda c, default: F.coalesce(field[c].try_cast("int"), F.lit(default)) if c in field else F.lit(default)
    year = num("Y", 1970) if "Y" in field else 1900 + num("y", 70)
    month = num("m", 1)
    if "b" in field and "m" not in field:
        month = F.greatest(F.floor((F.position(F.concat(F.lit("-"), F.lower(field["b"])), F.lit("-" + "-".join(m[:3].lower() for m in _MONTHS))) + 3) / 4).cast("int"), F.lit(1))
    day = num("j" if "j" in field and "d" not in field else "d", 1)
    hour = num("H", 0) + (num("I", 0) + (F.when(F.lower(field["p"]) == "pm", 12).otherwise(0) if "p" in field else F.lit(0)) if "I" in field else F.lit(0))
    y = F.when(month <= 2, year - 1).otherwise(year)
    era = F.floor(y / 400)
    yoe = y - era * 400
    doy = F.floor((153 * (month + F.when(month > 2, -3).otherwise(9)) + 2) / 5) + day - 1
    days = (era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468).cast("bigint")
    offset = F.lit(0)
    if "z" in field:
        z = field["z"]
        sign = F.when(F.substring(z, 1, 1) == "-", -1).otherwise(1)
        offset = sign * (F.coalesce(F.substring(z, 2, 2).try_cast("int"), F.lit(0)) * 3600 + F.coalesce(F.substring(z, 4, 2).try_cast("int"), F.lit(0)) * 60)
    seconds = days * 86400 + hour * 3600 + num("M", 0) * 60 + num("S", 0) + offset
    nanos = F.coalesce(F.rpad(field["f"], 9, "0").try_cast("int"), F.lit(0)) if "f" in field else F.lit(0)
    out = {
        "Y": year, "M": (year - 1970) * 12 + month - 1, "D": days, "h": F.floor(seconds / 3600), "m": F.floor(seconds / 60), "s": seconds,
        "ms": seconds * 1000 + F.floor(nanos / 1_000_000), "us": seconds * 1_000_000 + F.floor(nanos / 1000), "ns": seconds * 1_000_000_000 + nanos,
    }[units]
    return F.when(s.isNull(), F.lit(None)).when(F.char_length(s) < max(at - 1, 1), F.lit(0).cast("bigint")).otherwise(out.cast("bigint"))


def int2timestamp(v: Column, fmt: str = "%Y-%m-%dT%H:%M:%SZ", units: str = "s") -> Column:
    """An integer in units M D h m s ms us ns since 1970, or in years (Y), as text in UTC. Names are English."""
    v = v.cast("bigint")
    since = lambda months: F.datediff(F.add_months(F.lit("1970-01-01").cast("date"), months.cast("int")), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000_000
    micros = {
        "Y": lambda: since((v - 1970) * 12), "M": lambda: since(v), "D": lambda: v * 86_400_000_000, "h": lambda: v * 3_600_000_000, "m": lambda: v * 60_000_000, "s": lambda: v * 1_000_000,
        "ms": lambda: v * 1000, "us": lambda: v, "ns": lambda: F.floor(v / 1000).cast("bigint"),
    }[units]()
    t = F.timestamp_micros(micros)
    fraction = F.pmod(v, F.lit({"ms": 1000, "ns": 1_000_000_000}.get(units, 1_000_000))) if units in ("ms", "ns") else F.pmod(micros, F.lit(1_000_000))
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    name = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i)
    week = lambda first: F.floor((F.dayofyear(t) + 6 - F.pmod(F.weekday(t) + first, F.lit(7))) / 7)
    parts = {
        "Y": lambda n: pad(F.year(t), n), "y": lambda n: pad(F.year(t) % 100, n), "m": lambda n: pad(F.month(t), n), "d": lambda n: pad(F.day(t), n), "H": lambda n: pad(F.hour(t), n),
        "I": lambda n: pad(F.when(F.hour(t) % 12 == 0, 12).otherwise(F.hour(t) % 12), n), "M": lambda n: pad(F.minute(t), n), "S": lambda n: pad(F.second(t), n), "f": lambda n: pad(fraction, n),
        "j": lambda n: pad(F.dayofyear(t), n), "p": lambda n: F.when(F.hour(t) < 12, "AM").otherwise("PM"), "z": lambda n: F.lit("+0000"), "Z": lambda n: F.lit("UTC"),
        "a": lambda n: name([d[:3] for d in _DAYS], F.weekday(t) + 1), "A": lambda n: name(_DAYS, F.weekday(t) + 1), "b": lambda n: name([m[:3] for m in _MONTHS], F.month(t)), "B": lambda n: name(_MONTHS, F.month(t)),
        "w": lambda n: (F.dayofweek(t) - 1).cast("string"), "U": lambda n: pad(week(1), n), "W": lambda n: pad(week(0), n),
    }
    return F.concat(*(parts[c](n) if c else F.lit(literal) for c, literal, n in _pieces(fmt, units)))
