"""Golden values of the string, conversion and text functions."""

import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import convert as C
from quillspark.functions import regex
from quillspark.functions import strings as S
from quillspark.functions import text as T


def run(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"pos long, s {kind}")
    return [r.v for r in df.select("pos", f(F.col("s")).alias("v")).orderBy("pos").collect()]


NUMBERS = ["1234", "5678", "90", None, "-876", "543.2", "-0.12", ".55", "-.002", "", "de", "abc123", "123abc", "456e", "-1.78e+5"]
WORDS = ["hello", "there", "world", "accéntéd", None, ""]
CASES = [
    (C.hash32, NUMBERS, [1762063109, 3008518326, 3419725934, None, 1225421472, 2952354928, 2093756495, 1292375090, 2098378342, 1257683291, 3758453927, 213530502, 2957649541, 4248160425, 2735531987]),
    (C.stoi, NUMBERS, [1234, 5678, 90, None, -876, 543, 0, 0, 0, 0, 0, 0, 123, 456, -1]),
    (C.stod, NUMBERS, [1234.0, 5678.0, 90.0, None, -876.0, 543.2, -0.12, 0.55, -0.002, 0.0, 0.0, 0.0, 123.0, 456.0, -178000.0]),
    (C.ip2int, ["192.168.0.1", "10.0.0.1", None, "", "hello", "41.186.0.1", "41.197.0.1"], [3232235521, 167772161, None, 0, 0, 700055553, 700776449]),
    (C.timestamp2int, ["1974-02-28T01:23:45Z", "2019-07-17T21:34:37Z", None, ""], [131246625, 1563399277, None, 0]),
    (lambda s: C.timestamp2int(s, "%m-%d-%Y", "D"), ["12.28.1982"], [4744]),
    (lambda s: S.compare(s, "there"), WORDS, [-12, 0, 3, -19, None, -1]),
    (lambda s: S.find(s, "o"), WORDS, [4, -1, 1, -1, None, -1]),
    (lambda s: S.rfind(s, "d"), WORDS, [-1, -1, 4, 7, None, -1]),
    (S.is_empty, ["true", None, ""], [False, None, True]),
    (S.islower, ["abc", "123", "Abc", "", None], [True, True, False, False, None]),
    (S.title, ["it's a1b", None, ""], ["It'S A1B", None, ""]),
    (S.upper, ["straße", None], ["STRAßE", None]),
    (lambda s: S.split_record(s, "_"), ["héllo", None, "a_bc", "", "_ab"], [["héllo"], None, ["a", "bc"], [""], ["", "ab"]]),
    (lambda s: S.split_record(s, None, 1), ["", None, "a b", " a  bbb   c"], [[""], None, ["a", "b"], ["a", "bbb   c"]]),
    (lambda s: S.rsplit_record(s, "_", 1), ["a_b_c"], [["a_b", "c"]]),
    (S.partition, ["a b c", "ab", None], [["a", " ", "b c"], ["ab", "", ""], [None] * 3]),
    (S.rpartition, ["a b c", "ab"], [["a b", " ", "c"], ["", "", "ab"]]),
    (lambda s: S.zfill(s, 6), ["-12", "7", "+1.5", "1234567"], ["-00012", "000007", "+001.5", "1234567"]),
    (lambda s: S.wrap(s, 10), ["quick brown fox jumped over lazy brown dog", None, ""], ["quick\nbrown fox\njumped\nover lazy\nbrown dog", None, ""]),
    (lambda s: S.wrap(s, 4), ["  ab cd", "  longword x", "a  ", "   ", "a     b", "ab cde f\tgh\n", "é漢字é é"], ["  ab\ncd", " \nlongword\nx", "a  ", "   ", "a    \nb", "ab\ncde\nf gh ", "é漢字é\né"]),
    (lambda s: S.replace_multi(s, ["e", "o"], ["E", "e"]), ["hello"], ["hElle"]),
    (lambda s: S.replace_multi(s, ["ab", "a", "-", "]"], ["1", "22", "", "x"]), ["aab-^]b\na", None], ["221^xb\n22", None]),
    (S.isdigit, ["⁴", "①", "12", "½", "x1", "", None], [True, True, True, False, False, False, None]),
    (S.isnumeric, ["一", "½", "Ⅷ", "12", "a", ""], [True, True, True, True, False, False]),
    (S.isdecimal, ["١٢", "⁴", "12"], [True, False, True]),
    (S.isalnum, ["a一½⁴", "a b", "_"], [True, False, False]),
    (C.stol, ["12345678901234567890123", "-12345678901234567890123", "9223372036854775808", "18446744073709551616", "-", "+7"], [4807115922877859019, -4807115922877859019, -9223372036854775808, 0, 0, 7]),
    (C.stoi, ["12345678901234567890123", "4294967297"], [12345678901234567890123 % 2**32 - (2**32 if 12345678901234567890123 % 2**32 >= 2**31 else 0), 1]),
    (lambda s: C.timestamp2int(s, "%d %b %Y", "D"), ["03 Jan 1970", "01 dec 1970", "01 ??? 1970"], [2, 334, 0]),
    (lambda s: S.extract(s, r"Flight:([A-Z]+)(\d+)")[1], ["ALA Flight:HU7934", "", None], ["7934", None, None]),
    (lambda s: S.replace_with_backrefs(s, r"([a-z])-([a-z])", r"\2-\1\7"), ["a-b"], ["b-a"]),
    (lambda s: S.count(s, "a"), ["aaa", "", None], [3, 0, 0]),
    (lambda s: S.url_decode(S.url_encode(s)), ["a b*~é+%"], ["a b*~é+%"]),
    (S.url_encode, ["123.45 ~AB*"], ["123.45%20~AB%2A"]),
    (lambda s: T.token_count(s, "o"), ["the quick fox jumped over the lazy dog", None, ""], [4, 0, 0]),
    (lambda s: T.edit_distance(s, "puppy"), ["dog", None, "cat", "puppy"], [5, 5, 5, 0]),
    (T.porter_stemmer_measure, ["abandon", None, "abbey", "cleans", "trouble", "", "yearly"], [3, 0, 2, 1, 1, 0, 1]),
    (T.normalize_spaces, [" a \t b ", None], ["a b", None]),
    (lambda s: T.replace_tokens(s, ["the"], ["1"]), ["the  then the"], ["1  then 1"]),
]


@pytest.mark.parametrize("f,values,expected", CASES)
def test_golden(spark, f, values, expected):
    assert run(spark, values, f) == expected


def test_numbers_to_text(spark):
    assert run(spark, [0.0, 103342.313, -25.4294, 839542223232.79, float("nan"), None], C.dtos, "double") == ["0.0", "103342.313", "-25.4294", "8.395422232e+11", "NaN", None]
    assert run(spark, [1553085296, 1582934400], C.int2timestamp, "long") == ["2019-03-20T12:34:56Z", "2020-02-29T00:00:00Z"]
    assert run(spark, [3232235521, None], C.int2ip, "long")[0] == "192.168.0.1"


@pytest.mark.parametrize("f", [S.lower, S.upper, S.swapcase, S.capitalize, S.title, S.strip])
def test_nulls(spark, f):
    assert run(spark, [None, None], f) == [None, None]


def test_long_texts(spark):
    """Work in proportion to the text: a megabyte in seconds."""
    text = "some words of a long text " * 40_000
    df = spark.createDataFrame([(text,)], "s string").repartition(1)
    began = time.time()
    r = df.select(C.hash32(F.col("s")).alias("h"), S.wrap(F.col("s"), 60).alias("w"), S.title(F.col("s")).alias("t"), S.replace_multi(F.col("s"), ["of", "long"], ["x", "y"]).alias("r")).first()
    assert time.time() - began < 30
    assert max(map(len, r.w.split("\n"))) <= 60 and r.w.replace("\n", " ") == text and r.t == text.title() and r.r == text.replace("of", "x").replace("long", "y")


@pytest.mark.parametrize("v", [1e9, 1.5, 123456.7891234, 9.99999999999, 0.000123456789012, 0.5, 99999.99999999, 1e15, 1.25e-7, 12345678.9, 1e9 + 1])
def test_dtos_digits(spark, v):
    got = run(spark, [v, -v], C.dtos, "double")
    assert got[1] == "-" + got[0] and ("e" in got[0]) == (v > 1e9 or v < 1e-4)
    assert abs(float(got[0]) - v) <= max(1e-9 * v, 1e-9) and len(got[0].split("e")[0].replace(".", "").lstrip("0")) <= 11


def test_time_names(spark):
    assert run(spark, [1553085296], lambda v: C.int2timestamp(v, "%A %a %d %B %b %p %I %w %Z %%"), "long") == ["Wednesday Wed 20 March Mar PM 12 3 UTC %"]
    assert run(spark, [2019], lambda v: C.int2timestamp(v, units="Y"), "long") == ["2019-01-01T00:00:00Z"]
    assert run(spark, [-1, 590], lambda v: C.int2timestamp(v, "%Y-%m", "M"), "long") == ["1969-12", "2019-03"]
    with pytest.raises(ValueError, match="specifier"):
        C.int2timestamp(F.lit(1), "%Q")


def test_regex():
    assert regex.to_java(r"a$\Z") == r"(?mdU)a$\z"
    assert regex.to_java(r"[^x]\D") == r"(?mdU)[^\nx][^\d\n]"
    assert regex.groups(r"(a)(?:b)\((c[(])") == 2
    with pytest.raises(ValueError, match="class"):
        regex.to_java("[a")


def test_hash32_whole_words(spark):
    """Long and short texts against a plain MurmurHash3; no step of the plan goes by each four bytes."""
    def plain(data):
        h, m, rot = 31, 0xFFFFFFFF, lambda x, r: ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF
        for i in range(0, len(data), 4):
            k = rot(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
            h = rot(h ^ k, 13) * 5 + 0xE6546B64 & m if i + 4 <= len(data) else h ^ k
        h ^= len(data)
        h = (h ^ h >> 16) * 0x85EBCA6B & m
        h = (h ^ h >> 13) * 0xC2B2AE35 & m
        return h ^ h >> 16

    texts = ["", "a", "ab", "abc", "abcd", "\0\0\0\0\0", "\x7f\u00e9\u20ac", "\U0001f600", *("x\u00f1y z"[: k % 6] * k for k in range(40)), "the whole text \u00ff " * 20_000]
    got = spark.createDataFrame([(x,) for x in [*texts, None]], "s string").select(C.hash32(F.col("s")).alias("h"))
    assert [r.h for r in got.collect()] == [*(plain(x.encode()) for x in texts), None]
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
