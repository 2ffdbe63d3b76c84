"""The registered queries over the test tables, each over its whole table, with the same result in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import convert as C
from quillspark.functions import strings as S
from quillspark.functions import text as T
from quillspark.operators import positions as P
from quillspark.operators.category import Category
from quillspark.sources import columns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _project(name: str, source: str, key: str, column: str, value: Callable[[Column], Column | list[Column]], sql: str | list[str] | None) -> None:
    """A projection: key and v (or v0, v1, ...) for every row of a table. In sql, {s} is the column."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = value(F.col(column))
        cols = [c.alias(f"v{i}") for i, c in enumerate(made)] if isinstance(made, list) else [made.alias("v")]
        return table(spark, sf_dir, source).select(*key.split(","), *cols)

    many = isinstance(sql, list)
    _add(name, query, sql and f"SELECT {key}, " + ", ".join(f"{x.replace('{s}', column)} AS v{i if many else ''}" for i, x in enumerate(sql if many else [sql])) + f" FROM {source}")


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most frequent lower-case tokens of all documents."""
    tokens = table(spark, sf_dir, "documents").select(F.explode(T.tokens(S.lower(F.col("text")))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(50)


_TOK = r"list_filter(string_split_regex(coalesce({s}, ''), '[\x00-\x20]+'), lambda x: x <> '')"
_SP = "list_filter(string_split(coalesce({s}, ''), ' '), lambda x: x <> '')"
_add("q_word_count", word_count, f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOK.replace('{s}', 'lower(text)')}) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 50")


def _docs(name: str, value: Callable[[Column], Column | list[Column]], sql: str | list[str] | None) -> None:
    _project(name, "documents", "doc_id", "text", value, sql)


def _part(name: str, value: Callable[[Column], Column | list[Column]], sql: str | list[str] | None) -> None:
    _project(name, "part", "p_partkey", "p_name", value, sql)


# Attributes, predicates, statistics
_docs("q_len", S.length, "length({s})::INTEGER")
_docs("q_byte_count", S.byte_count, "strlen({s})::INTEGER")
_docs("q_is_empty", lambda s: S.is_empty(F.nullif(s, F.lit("That it."))), "nullif({s}, 'That it.') = ''")
_M = "4294967295::UBIGINT"
_WORDS = "regexp_extract_all(hex(encode({s})), '.{{8}}')"
_LE = "('0x' || {x}[7:8] || {x}[5:6] || {x}[3:4] || {x}[1:2])::UBIGINT"


def _rot(x: str, r: int) -> str:
    return f"((({x}) << {r}) & {_M} | (({x}) >> {32 - r}))"


def _mix(x: str) -> str:
    return f"(({_rot(f'(({x}) * 3432918353::UBIGINT & {_M})', 15)} * 461845907::UBIGINT) & {_M})"


def _fin(x: str, shift: int, by: int) -> str:
    return f"((xor({x}, ({x}) >> {shift}) * {by}::UBIGINT) & {_M})"


_BODY = f"list_reduce(list_prepend(31::UBIGINT, list_transform(w, lambda x: {_mix(_LE.replace('{x}', 'x'))})), lambda a, k: ({_rot('xor(a, k)', 13)} * 5 + 3864292196) & {_M})"
_TAIL = f"CASE WHEN n % 4 = 0 THEN 0 ELSE {_mix(_LE.replace('{x}', 'rpad(t, 8, chr(48))'))} END"
_docs("q_hash", C.hash32, None)
ORACLE_SQL["q_hash"] = f"""
WITH b AS (SELECT doc_id, strlen(text)::UBIGINT AS n, hex(encode(text)) AS h FROM documents),
c AS (SELECT doc_id, n, regexp_extract_all(h, '.{{8}}') AS w, right(h, (n % 4 * 2)::BIGINT) AS t FROM b),
d AS (SELECT doc_id, xor(xor({_BODY}, {_TAIL}), n) AS x FROM c), e AS (SELECT doc_id, {_fin('x', 16, 2246822507)} AS x FROM d), f AS (SELECT doc_id, {_fin('x', 13, 3266489909)} AS x FROM e)
SELECT doc_id, xor(x, x >> 16)::BIGINT AS v FROM f"""
# The whole text, and how many of its tokens (characters, for isspace) hold.
for _n, _f in (("isalnum", S.isalnum), ("isalpha", S.isalpha), ("isdigit", S.isdigit), ("isdecimal", S.isdecimal), ("isnumeric", S.isnumeric), ("isspace", S.isspace)):
    _by, _p = "" if _n == "isspace" else " ", S.char_class(getattr(str, _n))
    _docs(f"q_{_n}", lambda s, f=_f, by=_by: [f(s), F.size(F.filter(F.split(s, by), f))], [f"regexp_full_match({{s}}, '[{_p}]+')", f"len(list_filter(string_split({{s}}, '{_by}'), lambda x: regexp_full_match(x, '[{_p}]+')))::INTEGER"])
    # Every character of all texts, as a string of its own.
    _add(
        f"q_{_n}_chars", lambda s, d, f=_f: table(s, d, "documents").select(F.explode(F.array_distinct(F.split("text", ""))).alias("c")).filter("c <> ''").distinct().select("c", f(F.col("c")).alias("v")),
        f"SELECT c, regexp_full_match(c, '[{_p}]') AS v FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''",
    )
_docs("q_islower", S.islower, r"{s} <> '' AND NOT regexp_matches({s}, '\p{Lu}|\p{Lt}|\p{Lm}|\p{Lo}')")
_docs("q_isupper", S.isupper, r"{s} <> '' AND NOT regexp_matches({s}, '\p{Ll}|\p{Lt}|\p{Lm}|\p{Lo}')")
_add("q_null_count", lambda s, d: table(s, d, "documents").agg(F.count_if(S.is_null(F.nullif("text", F.lit("That it.")), True)).alias("n")), "SELECT count_if(nullif(text, 'That it.') IS NULL OR text = '')::BIGINT AS n FROM documents")
_add("q_info", lambda s, d: P.info(table(s, d, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("s"))), r"""
SELECT count(*) AS total_strings, count_if(text IS NULL)::BIGINT AS null_strings, count_if(text = '')::BIGINT AS empty_strings, (count(DISTINCT text) + max((text IS NULL)::INT))::BIGINT AS unique_strings,
  sum(strlen(text))::BIGINT AS total_bytes, sum(length(text))::BIGINT AS total_chars, max(strlen(text))::INTEGER AS bytes_max, min(CASE WHEN text <> '' THEN strlen(text) END)::INTEGER AS bytes_min,
  max(length(text))::INTEGER AS chars_max, min(CASE WHEN text <> '' THEN length(text) END)::INTEGER AS chars_min, floor(sum(strlen(text)) / count(text))::BIGINT AS bytes_avg, floor(sum(length(text)) / count(text))::BIGINT AS chars_avg,
  sum(length(regexp_replace(text, '[^\x09-\x0d\x20]', '', 'g')))::BIGINT AS whitespace_count, sum(length(regexp_replace(text, '[^0-9]', '', 'g')))::BIGINT AS digits_count,
  sum(length(regexp_replace(text, '[^\p{Lu}]', '', 'g')))::BIGINT AS uppercase_count, sum(length(regexp_replace(text, '[^\p{Ll}]', '', 'g')))::BIGINT AS lowercase_count FROM documents""")
_add("q_histogram", lambda s, d: P.histogram(table(s, d, "documents").select(F.col("text").alias("s"))), "SELECT char, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS char FROM documents) WHERE char <> '' GROUP BY char")

# Conversions
_NUM = "regexp_extract(substring({s}, 10), '^[+-]?[0-9]+')"
_project("q_stoi", "customer", "c_custkey", "c_name", lambda s: C.stoi(F.substr(s, F.lit(10))), f"coalesce(try_cast({_NUM} AS INTEGER), 0)")
_project("q_stol", "customer", "c_custkey", "c_name", lambda s: C.stol(F.substr(s, F.lit(10))), f"coalesce(try_cast({_NUM} AS BIGINT), 0)")
_project("q_stod", "lineitem", "l_orderkey,l_linenumber", "l_extendedprice", lambda c: C.stod(F.concat(F.format_string("%.2f", c), F.lit("x"))), "printf('%.2f', {s})::DOUBLE")
_project("q_stof", "lineitem", "l_orderkey,l_linenumber", "l_quantity", lambda c: C.stof(F.concat(c.cast("int").cast("string"), F.lit(".5 "))), "({s}::INTEGER + 0.5)::FLOAT")
_project("q_htoi", "orders", "o_orderkey", "o_orderkey", lambda c: C.htoi(F.hex(c)), "{s}::BIGINT")
_project("q_to_booleans", "orders", "o_orderkey", "o_orderstatus", lambda c: C.to_booleans(c, "F"), "{s} = 'F'")
_project("q_from_booleans", "labels", "doc_id", "toxic", lambda c: C.from_booleans(c == 1, "yes", "no"), "CASE WHEN {s} = 1 THEN 'yes' WHEN {s} <> 1 THEN 'no' END")
_IP = "(({s} >> 24) & 255)::VARCHAR || '.' || (({s} >> 16) & 255)::VARCHAR || '.' || (({s} >> 8) & 255)::VARCHAR || '.' || ({s} & 255)::VARCHAR"
_project("q_int2ip", "lineitem", "l_orderkey,l_linenumber", "l_partkey * 65537", lambda _: C.int2ip(F.col("l_partkey") * 65537), _IP.replace("{s}", "(l_partkey * 65537)"))
_project("q_ip2int", "lineitem", "l_orderkey,l_linenumber", "l_partkey", lambda c: C.ip2int(C.int2ip(c * 65537)), "(({s} * 65537) & 4294967295)::BIGINT")
_project("q_itos", "lineitem", "l_orderkey,l_linenumber", "l_linenumber", C.itos, "{s}::VARCHAR")
_project("q_ltos", "lineitem", "l_orderkey,l_linenumber", "l_orderkey", C.ltos, "{s}::VARCHAR")
_D = "regexp_replace(printf('%.2f', {s}), '([.][0-9])0$', '\\1')"
_project("q_dtos", "lineitem", "l_orderkey,l_linenumber", "l_extendedprice", lambda c: C.dtos(F.round(c, 2)), _D)
_project("q_ftos", "lineitem", "l_orderkey,l_linenumber", "l_quantity", lambda c: C.ftos(c.cast("float")), "printf('%.1f', {s})")
_project("q_int2timestamp", "orders", "o_orderkey", "o_orderdate", lambda c: C.int2timestamp(F.unix_seconds(c.cast("timestamp"))), "strftime({s}, '%Y-%m-%dT%H:%M:%SZ')")
_project("q_timestamp2int", "orders", "o_orderkey", "o_orderdate", lambda c: C.timestamp2int(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")), "floor(epoch({s}))::BIGINT")

_project("q_stol_long", "orders", "o_orderkey", "o_orderkey", lambda c: C.stol(F.concat(F.when(c % 2 == 0, "-").otherwise("+"), F.repeat(c.cast("string"), 4), F.lit("x"))), "(CASE WHEN {s} % 2 = 0 THEN -1 ELSE 1 END * (repeat({s}::VARCHAR, 4)::HUGEINT % 18446744073709551616 - CASE WHEN repeat({s}::VARCHAR, 4)::HUGEINT % 18446744073709551616 >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END))::BIGINT")
_E = "regexp_replace(regexp_replace(regexp_extract(printf('%.9e', {x}), '^[^e]+'), '0+$', ''), '[.]$', '.0') || regexp_extract(printf('%.9e', {x}), 'e.*$')"
_project("q_dtos_scientific", "lineitem", "l_orderkey,l_linenumber", "l_extendedprice", lambda c: [C.dtos(c * 1e9), C.dtos(c * -1e-12)], [_E.replace("{x}", "({s} * 1e9)"), "'-' || " + _E.replace("{x}", "({s} * 1e-12)")])
_FMT = "%A, %d %B %Y (%a %b) %j %U %W %w %I %p %y %Z%%"
_project("q_int2timestamp_names", "orders", "o_orderkey", "o_orderdate", lambda c: C.int2timestamp(F.unix_seconds(c.cast("timestamp")) + F.col("o_orderkey") % 86400, _FMT), f"strftime({{s}}::TIMESTAMP + to_seconds(o_orderkey % 86400), '{_FMT.replace('%Z', 'UTC')}')")
_project("q_int2timestamp_units", "orders", "o_orderkey", "o_orderdate", lambda c: [C.int2timestamp(F.year(c), units="Y"), C.int2timestamp((F.year(c) - 1970) * 12 + F.month(c) - 1, units="M"), C.int2timestamp(F.col("o_orderkey") * 1_000_003, "%H:%M:%S.%f", "ns"), C.int2timestamp(F.col("o_orderkey") * 1003, "%S,%f", "ms")],
         ["strftime(date_trunc('year', {s}), '%Y-%m-%dT%H:%M:%SZ')", "strftime(date_trunc('month', {s}), '%Y-%m-%dT%H:%M:%SZ')", "strftime(make_timestamp((o_orderkey * 1000003) // 1000), '%H:%M:%S.') || lpad(((o_orderkey * 1000003) % 1000000000)::VARCHAR, 9, '0')", "strftime(make_timestamp(o_orderkey * 1003000), '%S,') || lpad(((o_orderkey * 1003) % 1000)::VARCHAR, 3, '0')"])
_project("q_timestamp2int_formats", "orders", "o_orderkey", "o_orderdate", lambda c: [C.timestamp2int(F.date_format(c, "dd MMM yyyy"), "%d %b %Y", "D"), C.timestamp2int(F.concat(F.date_format(c, "yyMM"), F.lit("05 03:04 PM -0130")), "%y%m%d %I:%M %p %z", "m"), C.timestamp2int(F.date_format(c, "MM/dd/yyyy"), "%m/%d/%Y", "M"), C.timestamp2int(F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit(" 01:02:03.123456789")), "%Y-%m-%d %H:%M:%S.%f", "ns")],
         ["({s}::DATE - DATE '1970-01-01')::BIGINT", "((epoch(make_date(1900 + year({s})::INT % 100, month({s})::INT, 5))::BIGINT + 15 * 3600 + 240 - 5400) // 60)::BIGINT", "((year({s}) - 1970) * 12 + month({s}) - 1)::BIGINT", "((epoch({s})::BIGINT + 3723) * 1000000000 + 123456789)::BIGINT"])
_project("q_ip2int_odd", "orders", "o_orderkey", "o_orderkey", lambda c: C.ip2int(F.when(c % 4 == 0, F.concat(c.cast("string"), F.lit(".2.3"))).when(c % 4 == 1, F.lit("10.x1.300.7")).when(c % 4 == 2, F.concat(F.lit("1.2.3."), (c % 256).cast("string")))), "CASE {s} % 4 WHEN 0 THEN 0 WHEN 1 THEN 10 * 16777216 + 65536 + 300 * 256 + 7 WHEN 2 THEN 16909056 + {s} % 256 END::BIGINT")

# Case
_U = "array_to_string(list_transform(string_split({x}, 'ß'), lambda y: upper(y)), 'ß')"
_docs("q_lower", S.lower, "lower({s})")
_docs("q_upper", S.upper, _U.replace("{x}", "{s}"))
_docs("q_capitalize", S.capitalize, _U.replace("{x}", "left({s}, 1)") + " || lower(substring({s}, 2))")
_docs("q_swapcase", S.swapcase, "array_to_string(list_transform(string_split({s}, ''), lambda c: CASE WHEN c = lower(c) THEN CASE WHEN c = 'ß' THEN c ELSE upper(c) END ELSE lower(c) END), '')")
_docs("q_title", S.title, r"array_to_string(list_transform(regexp_extract_all({s}, '\p{L}+|\P{L}+'), lambda r: CASE WHEN left(r, 1) = 'ß' THEN 'ß' ELSE upper(left(r, 1)) END || lower(substring(r, 2))), '')")

# Combining, splitting
_add("q_cat", lambda s, d: table(s, d, "part").select("p_partkey", S.cat([F.nullif("p_name", F.lit("x")), F.col("p_brand")], "-", "_").alias("v")), "SELECT p_partkey, coalesce(nullif(p_name, 'x'), '_') || '-' || coalesce(p_brand, '_') AS v FROM part")
_add("q_join", lambda s, d: P.join(table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("s")), ","), "SELECT string_agg(n_name, ',' ORDER BY n_nationkey) AS s FROM nation")
_add("q_cat_frames", lambda s, d: P.cat(*(table(s, d, "customer").select(F.col("c_custkey").alias("pos"), F.col(c).alias("s")) for c in ("c_name", "c_mktsegment")), sep="/"), "SELECT c_custkey AS pos, c_name || '/' || c_mktsegment AS s FROM customer")
_docs("q_split_record", lambda s: F.array_join(S.split_record(s, ", ", 3), "|"), "array_to_string(CASE WHEN len(string_split({s}, ', ')) <= 4 THEN string_split({s}, ', ') ELSE list_append(string_split({s}, ', ')[1:3], array_to_string(string_split({s}, ', ')[4:], ', ')) END, '|')")
_docs("q_split_blanks", lambda s: F.array_join(S.split_record(s), "|"), f"array_to_string(CASE WHEN len({_TOK}) = 0 THEN [''] ELSE {_TOK} END, '|')")
_docs("q_rsplit_record", lambda s: F.array_join(S.rsplit_record(s, " ", 1), "|"), "CASE WHEN contains({s}, ' ') THEN array_to_string(string_split({s}, ' ')[:-2], ' ') || '|' || string_split({s}, ' ')[-1] ELSE {s} END")
_docs("q_partition", lambda s: [F.get(S.partition(s, ", "), i) for i in range(3)], [f"CASE WHEN strpos({{s}}, ', ') = 0 THEN {a} ELSE {b} END" for a, b in (("{s}", "left({s}, strpos({s}, ', ') - 1)"), ("''", "', '"), ("''", "substring({s}, strpos({s}, ', ') + 2)"))])
_docs("q_rpartition", lambda s: [F.get(S.rpartition(s, " "), i) for i in range(3)], [f"CASE WHEN strpos({{s}}, ' ') = 0 THEN {a} ELSE {b} END" for a, b in (("''", "left({s}, length({s}) - strpos(reverse({s}), ' '))"), ("''", "' '"), ("{s}", "right({s}, strpos(reverse({s}), ' ') - 1)"))])

# Substrings, padding, stripping
_docs("q_get", lambda s: S.get(s, 7), "substring({s}, 8, 1)")
_docs("q_slice", lambda s: S.slice_(s, 2, 40), "substring({s}, 3, 38)")
_docs("q_slice_step", lambda s: S.slice_(s, 1, None, 3), "array_to_string(list_filter(string_split(substring({s}, 2), ''), lambda c, i: (i - 1) % 3 = 0), '')")
_docs("q_slice_from", lambda s: S.slice_from(s, (F.col("doc_id") % 7).cast("int"), (F.col("doc_id") % 20).cast("int")), "CASE WHEN doc_id % 20 > 0 THEN substring({s}, (doc_id % 7 + 1)::INT, greatest(doc_id % 20 - doc_id % 7, 0)::INT) ELSE substring({s}, (doc_id % 7 + 1)::INT) END")
_docs("q_slice_replace", lambda s: S.slice_replace(s, 5, 9, "<>"), "CASE WHEN length({s}) <= 5 THEN {s} || '<>' ELSE left({s}, 5) || '<>' || substring({s}, 10) END")
_docs("q_insert", lambda s: S.insert(s, 12, "_"), "CASE WHEN length({s}) < 12 THEN {s} ELSE left({s}, 12) || '_' || substring({s}, 13) END")
_docs("q_repeat", lambda s: S.repeat(s, 2), "{s} || {s}")
_PAD = "CASE WHEN length({s}) < 60 THEN {x} ELSE {s} END"
_part("q_pad", lambda s: S.pad(s, 60, "left", "*"), _PAD.replace("{x}", "lpad({s}, 60, '*')"))
_part("q_ljust", lambda s: S.ljust(s, 60, "é"), _PAD.replace("{x}", "rpad({s}, 60, 'é')"))
_part("q_rjust", lambda s: S.rjust(s, 60), _PAD.replace("{x}", "lpad({s}, 60, ' ')"))
_part("q_center", lambda s: S.center(s, 60, "."), _PAD.replace("{x}", "repeat('.', ((60 - length({s})) // 2)::INT) || {s} || repeat('.', (60 - length({s}) - (60 - length({s})) // 2)::INT)"))
_project("q_zfill", "orders", "o_orderkey", "o_orderkey", lambda c: S.zfill(F.when(c % 2 == 0, F.concat(F.lit("-"), c.cast("string"))).otherwise(c.cast("string")), 12), "CASE WHEN {s} % 2 = 0 THEN '-' || lpad({s}::VARCHAR, 11, '0') ELSE lpad({s}::VARCHAR, 12, '0') END")
_docs("q_wrap", lambda s: S.wrap(s, 40), r"list_reduce(string_split(regexp_replace({s}, '[\x00-\x20]', ' ', 'g'), ' '), lambda a, x: a || CASE WHEN x <> '' AND (CASE WHEN strpos(reverse(a), chr(10)) = 0 THEN length(a) ELSE strpos(reverse(a), chr(10)) - 1 END) + 1 + length(x) > 40 THEN chr(10) ELSE ' ' END || x)")
_docs("q_lstrip", lambda s: S.lstrip(s, "TEIthe "), "ltrim({s}, 'TEIthe ')")
_docs("q_strip", lambda s: S.strip(s, ".Ter \n"), "trim({s}, '.Ter ' || chr(10))")
_docs("q_rstrip", lambda s: S.rstrip(s, ".nd "), "rtrim({s}, '.nd ')")

# Replacing
_docs("q_replace", lambda s: S.replace(s, "the", "$1", is_regex=False), "replace({s}, 'the', '$1')")
_docs("q_replace_re", lambda s: S.replace(s, "[aeiou]+", "*"), "regexp_replace({s}, '[aeiou]+', '*', 'g')")
_docs("q_replace_n", lambda s: S.replace(s, " ", "_", 1, False), "CASE WHEN strpos({s}, ' ') = 0 THEN {s} ELSE left({s}, strpos({s}, ' ') - 1) || '_' || substring({s}, strpos({s}, ' ') + 1) END")
_docs("q_replace_multi", lambda s: S.replace_multi(s, ["e", "o"], ["o", "e"]), "translate({s}, 'eo', 'oe')")
_docs("q_replace_multi_re", lambda s: S.replace_multi_regex(s, ["[0-9]", "[A-Z]"], ["#"]), "regexp_replace({s}, '[0-9A-Z]', '#', 'g')")
_docs("q_backrefs", lambda s: S.replace_with_backrefs(s, "([a-z])([0-9])", r"\2-\1"), r"regexp_replace({s}, '([a-z])([0-9])', '\2-\1', 'g')")
_docs("q_fillna", lambda s: S.fillna(F.nullif(s, F.lit("That it.")), "none"), "coalesce(nullif({s}, 'That it.'), 'none')")
_docs("q_translate", lambda s: S.translate(s, {"a": None, "e": "E", "i": "I"}), "translate({s}, 'eia', 'EI')")
_project("q_url_encode", "pages", "page_id", "url", S.url_encode, "url_encode({s})")
_project("q_url_decode_odd", "pages", "page_id", "page_id", lambda c: S.url_decode(F.concat(F.lit("a+b%"), F.when(c % 2 == 0, F.lit("41%C3%A9")).otherwise(F.lit("zz")), c.cast("string"))), "CASE WHEN {s} % 2 = 0 THEN 'a+bAé' ELSE 'a+b%zz' END || {s}::VARCHAR")
_project("q_url_decode", "pages", "page_id", "url", lambda s: S.url_decode(S.url_encode(s)), "{s}")

# Searching
_docs("q_find", lambda s: S.find(s, "th", 3), "CASE WHEN strpos(substring({s}, 4), 'th') = 0 THEN -1 ELSE strpos(substring({s}, 4), 'th') + 2 END::INTEGER")
_docs("q_rfind", lambda s: S.rfind(s, "en"), "CASE WHEN strpos(reverse({s}), 'ne') = 0 THEN -1 ELSE length({s}) - strpos(reverse({s}), 'ne') - 1 END::INTEGER")
_project("q_index", "customer", "c_custkey", "c_name", lambda s: S.index(s, "#"), "(strpos({s}, '#') - 1)::INTEGER")
_project("q_rindex", "customer", "c_custkey", "c_name", lambda s: S.rindex(s, "#"), "(length({s}) - strpos(reverse({s}), '#'))::INTEGER")
_docs("q_find_from", lambda s: S.find_from(s, "e", (F.col("doc_id") % 5).cast("int")), "CASE WHEN strpos(substring({s}, (doc_id % 5 + 1)::INT), 'e') = 0 THEN -1 ELSE strpos(substring({s}, (doc_id % 5 + 1)::INT), 'e') + doc_id % 5 - 1 END::INTEGER")
_docs("q_find_multiple", lambda s: [F.get(S.find_multiple(s, ["e", "xyz"]), i) for i in range(2)], ["(strpos({s}, 'e') - 1)::INTEGER", "(strpos({s}, 'xyz') - 1)::INTEGER"])
_docs("q_compare", lambda s: F.signum(S.compare(s, "The")).cast("int"), "CASE WHEN {s} = 'The' THEN 0 WHEN {s} < 'The' THEN -1 ELSE 1 END::INTEGER")
_docs("q_contains", lambda s: S.contains(s, "token", False), "contains({s}, 'token')")
_docs("q_contains_re", lambda s: S.contains(s, "[0-9]{3}-[0-9]{2}"), "regexp_matches({s}, '[0-9]{3}-[0-9]{2}')")
_docs("q_match", lambda s: S.match(s, "[A-E][a-z]+ "), "regexp_matches({s}, '^[A-E][a-z]+ ')")
_add("q_match_strings", lambda s, d: table(s, d, "part").select("p_partkey", S.match_strings(F.nullif("p_brand", F.lit("Brand#11")), F.nullif("p_type", F.lit("x"))).alias("v")), "SELECT p_partkey, nullif(p_brand, 'Brand#11') IS NOT DISTINCT FROM nullif(p_type, 'x') AS v FROM part")
_docs("q_count", lambda s: S.count(s, "e[nr]"), "len(regexp_extract_all({s}, 'e[nr]'))::INTEGER")
_docs("q_startswith", lambda s: S.startswith(s, "The"), "starts_with({s}, 'The')")
_docs("q_endswith", lambda s: S.endswith(s, "."), "ends_with({s}, '.')")
_docs("q_findall_record", lambda s: F.array_join(S.findall_record(s, "th[a-z]"), "|"), "array_to_string(regexp_extract_all({s}, 'th[a-z]'), '|')")


def _long(name: str, source: str, key: str, column: str, value: Callable[[Column], Column], sql: str) -> None:
    """Long form: key, k from 0 and v, a row for each part of each text, so nothing is cut to a width."""
    _add(name, lambda s, d: table(s, d, source).select(key, F.posexplode(value(F.col(column))).alias("k", "v")), f"SELECT {key}, (i - 1)::INTEGER AS k, m[i] AS v FROM (SELECT {key}, {sql.replace('{s}', column)} AS m FROM {source}), unnest(range(1, len(m) + 1)) AS t(i)")


_long("q_findall", "documents", "doc_id", "text", lambda s: S.findall_record(s, "th[a-z]"), "regexp_extract_all({s}, 'th[a-z]')")
_long("q_split", "part", "p_partkey", "p_name", lambda s: S.split_record(s, " "), "string_split({s}, ' ')")
_long("q_rsplit", "part", "p_partkey", "p_name", lambda s: F.reverse(S.rsplit_record(s, " ")), "list_reverse(string_split({s}, ' '))")
_X = "nullif(regexp_extract({s}, '([a-z]+)://([^/]+)', {g}), '')"
_project("q_extract", "pages", "page_id", "url", lambda s: S.extract(s, "([a-z]+)://([^/]+)"), [_X.replace("{g}", "1"), _X.replace("{g}", "2")])
_project("q_extract_record", "pages", "page_id", "url", lambda s: F.array_join(S.extract_record(s, "([a-z]+)://([^/]+)"), "|"), f"{_X.replace('{g}', '1')} || '|' || {_X.replace('{g}', '2')}")

# Text
_docs("q_token_count", lambda s: T.token_count(s, " "), f"len({_SP})::INTEGER")
_add("q_tokenize", lambda s, d: table(s, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")), f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOK.replace('{s}', 'text')}) AS token FROM documents) GROUP BY token")
_add("q_tokenize_multi", lambda s, d: table(s, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"), ["th", ", "])).alias("v")), "SELECT doc_id, len(list_filter(string_split_regex(text, '(th|, )+'), lambda x: x <> ''))::INTEGER AS v FROM documents")
_add("q_unique_tokens", lambda s, d: table(s, d, "documents").select(F.explode(T.tokens(F.col("text"), " ")).alias("token")).distinct(), f"SELECT DISTINCT unnest({_SP.replace('{s}', 'text')}) AS token FROM documents")
_docs("q_contains_strings", lambda s: [F.get(T.contains_strings(s, ["the", "der"]), i) for i in range(2)], ["contains({s}, 'the')", "contains({s}, 'der')"])
_docs("q_strings_counts", lambda s: [F.get(T.strings_counts(s, ["the", "e"]), i) for i in range(2)], ["((length({s}) - length(replace({s}, 'the', ''))) // 3)::INTEGER", "(length({s}) - length(replace({s}, 'e', '')))::INTEGER"])
_docs("q_tokens_counts", lambda s: [F.get(T.tokens_counts(s, ["the", "der"]), i) for i in range(2)], [f"len(list_filter({_SP}, lambda x: x = '{t}'))::INTEGER" for t in ("the", "der")])
_docs("q_replace_tokens", lambda s: T.replace_tokens(s, ["the", "of"], ["1", "2"]), r"array_to_string(list_transform(regexp_extract_all({s}, '[\x00-\x20]+|[^\x00-\x20]+'), lambda x: CASE x WHEN 'the' THEN '1' WHEN 'of' THEN '2' ELSE x END), '')")
_docs("q_normalize_spaces", T.normalize_spaces, r"trim(regexp_replace({s}, '[\x00-\x20]+', ' ', 'g'))")
_part("q_edit_distance", lambda s: T.edit_distance(s, F.col("p_type")), "levenshtein({s}, p_type)::INTEGER")
_docs("q_stemmer_measure", T.porter_stemmer_measure, "len(regexp_extract_all(array_to_string(list_transform(string_split({s}, ''), lambda c, i: CASE WHEN contains('aeiou', c) THEN 'V' WHEN c <> 'y' OR i = 1 OR contains('aeiou', {s}[i - 1]) THEN 'C' ELSE 'V' END), ''), 'V+C'))::INTEGER")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(T.tokens(F.col("p_name"))))
    return P.dense(rows, "p_partkey", "pos", name="at").select(F.col("at").alias("pos"), F.col("col").alias("s"))


_TOKENS = f"SELECT row_number() OVER (ORDER BY p_partkey, i) - 1 AS pos, w[i] AS s FROM (SELECT p_partkey, {_TOK.replace('{s}', 'p_name')} AS w, unnest(range(1, len({_TOK.replace('{s}', 'p_name')}) + 1)) AS i FROM part)"
_add("q_ngrams", lambda s, d: P.ngrams(_tokens(s, d), 3), f"SELECT * FROM (SELECT pos, s || '_' || lead(s, 1) OVER (ORDER BY pos) || '_' || lead(s, 2) OVER (ORDER BY pos) AS s FROM ({_TOKENS})) WHERE s IS NOT NULL")
_add("q_scatter_count", lambda s, d: P.scatter_count(_names(s, d), F.col("pos") % 3), "SELECT row_number() OVER (ORDER BY pos, k) - 1 AS pos, s FROM (SELECT c_custkey AS pos, c_name AS s, unnest(range(c_custkey % 3)) AS k FROM customer)")


# Positions
def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("s"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("s"))


_SEG = "SELECT c_custkey AS pos, nullif(c_mktsegment, 'BUILDING') AS s FROM customer"
_add("q_sort", lambda s, d: P.sort(_segments(s, d), by_length=True), f"SELECT row_number() OVER (ORDER BY s IS NULL DESC, strlen(s), s, pos) - 1 AS pos, s FROM ({_SEG})")
_add("q_order", lambda s, d: P.argsort(_segments(s, d), ascending=False, nulls_first=False), f"SELECT row_number() OVER (ORDER BY s IS NULL, s DESC, pos) - 1 AS pos, pos AS index FROM ({_SEG})")
_IDX = "SELECT o_orderkey AS pos, o_custkey AS index FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)"


def _indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("index")).join(_names(spark, sf_dir).select(F.col("pos").alias("index")), "index", "left_semi")


_add("q_gather", lambda s, d: P.gather(_names(s, d), _indexes(s, d)), f"SELECT i.pos, c_name AS s FROM ({_IDX}) i JOIN customer ON c_custkey = index")
QUERIES["q_sublist"], ORACLE_SQL["q_sublist"] = lambda s, d: P.sublist(_names(s, d), _indexes(s, d)), ORACLE_SQL["q_gather"]
_add("q_gather_mask", lambda s, d: P.gather_mask(_segments(s, d), F.col("s") == "MACHINERY"), f"SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, s FROM ({_SEG}) WHERE s = 'MACHINERY'")
_add("q_scatter", lambda s, d: P.scatter(_names(s, d), table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("index"), F.col("n_name").alias("s"))), "SELECT c_custkey AS pos, coalesce(n_name, c_name) AS s FROM customer LEFT JOIN nation ON n_nationkey = c_custkey")
_add("q_scalar_scatter", lambda s, d: P.scalar_scatter(_names(s, d), "x", [1, 5, -3]), "SELECT c_custkey AS pos, CASE WHEN c_custkey IN (1, 5) THEN 'x' ELSE c_name END AS s FROM customer")
_add("q_remove_strings", lambda s, d: P.remove_strings(_names(s, d), table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("index"))), "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_name AS s FROM customer WHERE c_custkey NOT IN (SELECT n_nationkey FROM nation)")
_add("q_add_strings", lambda s, d: P.add_strings(_names(s, d), table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("s"))), "SELECT c_custkey AS pos, c_name AS s FROM customer UNION ALL SELECT n_nationkey + (SELECT max(c_custkey) + 1 FROM customer), n_name FROM nation")
_add("q_slice_rows", lambda s, d: P.slice_rows(_names(s, d), 10, None, 7), "SELECT ((c_custkey - 10) // 7)::BIGINT AS pos, c_name AS s FROM customer WHERE c_custkey >= 10 AND (c_custkey - 10) % 7 = 0")


_add("q_slice_rows_back", lambda s, d: P.slice_rows(_names(s, d), None, None, -3), "SELECT ((n - c_custkey) // 3)::BIGINT AS pos, c_name AS s FROM customer, (SELECT max(c_custkey) AS n FROM customer) WHERE (n - c_custkey) % 3 = 0")
_add("q_bytes_total", lambda s, d: P.bytes_total(_segments(s, d)), f"SELECT sum(strlen(s))::BIGINT AS n FROM ({_SEG})")
_add("q_memory", lambda s, d: P.memory(_segments(s, d)), f"SELECT sum(8 + coalesce(ceil((strlen(s) + 8) / 8) * 8, 0))::BIGINT AS n FROM ({_SEG})")
_add("q_nulls", lambda s, d: P.nulls(_segments(s, d)), f"SELECT pos FROM ({_SEG}) WHERE s IS NULL")
_add("q_null_bitmask", lambda s, d: P.null_bitmask(_segments(s, d)), f"SELECT pos // 8 AS byte, sum(CASE WHEN s IS NULL THEN 0 ELSE 1 << (pos % 8)::INT END)::INTEGER AS mask FROM ({_SEG}) GROUP BY ALL")
_add("q_unique_tokens_sorted", lambda s, d: P.unique_tokens(_names(s, d), "0"), "SELECT row_number() OVER (ORDER BY s) - 1 AS pos, s FROM (SELECT DISTINCT unnest(list_filter(string_split(c_name, '0'), lambda x: x <> '')) AS s FROM customer)")
_add("q_from_strings", lambda s, d: P.from_strings(*[_segments(s, d)] * 3), f"SELECT pos + k * (SELECT max(pos) + 1 FROM ({_SEG})) AS pos, s FROM ({_SEG}), range(3) t(k)")


# Sources and sinks: a small table through the driver, as these do by nature.
def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.nullif("n_name", F.lit("CHINA")).alias("s"))


_NAT = "SELECT n_nationkey::BIGINT AS pos, nullif(n_name, 'CHINA') AS s FROM nation"
_add("q_to_host", lambda s, d: columns.to_frame(s, columns.to_host(_nations(s, d))), _NAT)
_add("q_from_offsets", lambda s, d: columns.from_offsets(s, *columns.to_offsets(_nations(s, d))), _NAT)


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{P.folder(spark)}/csv-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(' "x", y')).alias("name"))
    rows.coalesce(1).sortWithinPartitions("n_nationkey").write.option("header", True).option("escape", '"').csv(at)
    return columns.from_csv(spark, at, 1)


_add("q_from_csv", _csv, "SELECT n_nationkey::BIGINT AS pos, n_name || ' \"x\", y' AS s FROM nation")


# Categories
def _cat(spark: SparkSession, sf_dir: str, which: str = "c") -> Category:
    if which == "c":
        return Category.encode(_segments(spark, sf_dir))
    return Category.encode(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("s")))


def _keys(*values: str) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: spark.createDataFrame([(v,) for v in values], "key string")


_RANK = "dense_rank() OVER (ORDER BY s NULLS FIRST) - 1"
_BOTH = f"SELECT pos, s, 0 AS o FROM ({_SEG}) UNION ALL SELECT o_orderkey + (SELECT max(c_custkey) + 1 FROM customer), o_orderpriority, 1 FROM orders"
_add("q_cat_encode", lambda s, d: _cat(s, d).codes, f"SELECT pos, {_RANK} AS code FROM ({_SEG})")
_add("q_cat_keys", lambda s, d: _cat(s, d).keys, f"SELECT row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS code, s AS key FROM (SELECT DISTINCT s FROM ({_SEG}))")
_add("q_cat_decode", lambda s, d: _cat(s, d).decode(), f"SELECT pos, s AS key FROM ({_SEG})")
_add("q_cat_merge", lambda s, d: _cat(s, d).merge(_cat(s, d, "o")).codes, f"WITH b AS ({_BOTH}), k AS (SELECT s, row_number() OVER (ORDER BY min(o), s NULLS FIRST) - 1 AS code FROM b GROUP BY s) SELECT pos, code FROM b JOIN k ON b.s IS NOT DISTINCT FROM k.s")
_add("q_cat_merge_remap", lambda s, d: _cat(s, d).merge_and_remap(_cat(s, d, "o")).codes, f"SELECT pos, {_RANK} AS code FROM ({_BOTH})")
_add("q_cat_add_keys", lambda s, d: _cat(s, d).add_keys(_keys("AAA", "MACHINERY")(s)).codes, f"SELECT pos, {_RANK} + CASE WHEN s IS NULL THEN 0 ELSE 1 END AS code FROM ({_SEG})")
_add("q_cat_remove_keys", lambda s, d: _cat(s, d).remove_keys(_keys("MACHINERY")(s)).codes, f"WITH k AS (SELECT s, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS code FROM (SELECT DISTINCT s FROM ({_SEG}) WHERE s IS DISTINCT FROM 'MACHINERY')) SELECT pos, coalesce(code, -1) AS code FROM ({_SEG}) t LEFT JOIN k ON t.s IS NOT DISTINCT FROM k.s")
_add("q_cat_set_keys", lambda s, d: _cat(s, d).set_keys(_keys("MACHINERY", "ZZZ")(s)).codes, f"SELECT pos, CASE WHEN s = 'MACHINERY' THEN 0 ELSE -1 END::BIGINT AS code FROM ({_SEG})")
_add("q_cat_remove_unused", lambda s, d: _cat(s, d).add_keys(_keys("AAA")(s)).remove_unused_keys().keys, ORACLE_SQL["q_cat_keys"])
_GI = "SELECT n_nationkey::BIGINT AS pos, (n_nationkey % 2)::BIGINT AS code FROM nation"


def _gi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), (F.col("n_nationkey") % 2).cast("long").alias("code"))


_add("q_cat_gather", lambda s, d: _cat(s, d).gather(_gi(s, d)).decode(), f"SELECT pos, key FROM ({_GI}) JOIN ({ORACLE_SQL['q_cat_keys']}) USING (code)")
_add("q_cat_gather_strings", lambda s, d: _cat(s, d).gather_strings(_gi(s, d)), ORACLE_SQL["q_cat_gather"])
_add("q_cat_gather_remap", lambda s, d: _cat(s, d).gather_and_remap(_gi(s, d)).codes, _GI)
_add("q_cat_indexes_for_key", lambda s, d: _cat(s, d).indexes_for_key("MACHINERY"), f"SELECT pos FROM ({_SEG}) WHERE s = 'MACHINERY'")
_add("q_cat_bounds", lambda s, d: s.createDataFrame([_cat(s, d).bounds("H"), _cat(s, d).bounds("MACHINERY")], "lo long, hi long"), f"WITH k AS ({ORACLE_SQL['q_cat_keys']}) SELECT c - 1 AS lo, c AS hi FROM (SELECT count_if(key IS NULL OR key < 'H')::BIGINT AS c FROM k) UNION ALL SELECT code, code FROM k WHERE key = 'MACHINERY'")
_add("q_cat_remove_strings", lambda s, d: _cat(s, d).remove_strings(_keys("MACHINERY")(s).withColumnRenamed("key", "s")).decode(), f"SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, s AS key FROM ({_SEG}) WHERE s IS DISTINCT FROM 'MACHINERY'")
_add("q_cat_add_strings", lambda s, d: _cat(s, d).add_strings(table(s, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("s"))).codes, ORACLE_SQL["q_cat_merge_remap"])
for _n, _t, _k, _c in (("int", "part", "p_partkey", "p_size"), ("long", "lineitem", "l_orderkey * 10 + l_linenumber", "l_suppkey"), ("double", "lineitem", "l_orderkey * 10 + l_linenumber", "l_discount"), ("float", "lineitem", "l_orderkey * 10 + l_linenumber", "l_tax")):
    _kind = {"float": "::FLOAT"}.get(_n, "")

    def _num(s: SparkSession, d: str, t: str = _t, k: str = _k, c: str = _c, n: str = _n) -> DataFrame:
        return Category.encode(table(s, d, t).select(F.expr(k).alias("pos"), F.col(c).cast(n).alias("s"))).codes

    QUERIES[f"q_numcat_decode_{_n}"] = lambda s, d, t=_t, k=_k, c=_c, n=_n: Category.encode(table(s, d, t).select(F.expr(k).alias("pos"), F.col(c).cast(n).alias("s"))).decode()
    ORACLE_SQL[f"q_numcat_decode_{_n}"] = f"SELECT {_k} AS pos, {_c}{_kind} AS key FROM {_t}"
    _add(f"q_numcat_{_n}", _num, f"SELECT {_k} AS pos, dense_rank() OVER (ORDER BY {_c}{_kind} NULLS FIRST) - 1 AS code FROM {_t}")


def _sizes(spark: SparkSession, sf_dir: str, kind: str = "byte") -> Category:
    return Category.encode(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_size").cast(kind).alias("s")))


def _dates(spark: SparkSession, sf_dir: str) -> Category:
    return Category.encode(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderdate").cast("timestamp").alias("s")))


_SIZES = "SELECT row_number() OVER (ORDER BY p_size) - 1 AS code, p_size::TINYINT AS key FROM (SELECT DISTINCT p_size FROM part)"
_add("q_numcat_int8", lambda s, d: _sizes(s, d).codes, "SELECT p_partkey AS pos, dense_rank() OVER (ORDER BY p_size) - 1 AS code FROM part")
_add("q_numcat_datetime", lambda s, d: _dates(s, d).codes, "SELECT o_orderkey AS pos, dense_rank() OVER (ORDER BY o_orderdate) - 1 AS code FROM orders")
_add("q_numcat_gather", lambda s, d: _sizes(s, d).gather_strings(_gi(s, d)), f"SELECT pos, key FROM ({_GI}) JOIN ({_SIZES}) USING (code)")
_add("q_numcat_merge", lambda s, d: _sizes(s, d, "int").merge_and_remap(Category.encode(table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_linenumber").cast("int").alias("s")))).codes, "SELECT pos, dense_rank() OVER (ORDER BY s) - 1 AS code FROM (SELECT p_partkey AS pos, p_size AS s FROM part UNION ALL SELECT l_orderkey * 10 + l_linenumber + (SELECT max(p_partkey) + 1 FROM part), l_linenumber FROM lineitem)")
_add("q_numcat_values", lambda s, d: _sizes(s, d).gather_values(_gi(s, d).select("pos", (F.col("code") + 1).alias("index"))), f"SELECT pos, p_size::TINYINT AS key FROM ({_GI}) JOIN part ON p_partkey = code + 1")
_add("q_cat_merge_all", lambda s, d: Category.merge_all(_cat(s, d), _cat(s, d, "o"), _cat(s, d)).codes, f"SELECT pos, {_RANK} AS code FROM ({_BOTH} UNION ALL SELECT pos + (SELECT max(c_custkey) + 1 FROM customer) + (SELECT max(o_orderkey) + 1 FROM orders), s, 2 FROM ({_SEG}))")
_add("q_cat_sizes", lambda s, d: s.createDataFrame([(_cat(s, d).size(), _cat(s, d).keys_size(), _cat(s, d).value("MACHINERY"), _cat(s, d).value_for_index(2), _sizes(s, d).keys_type(), _cat(s, d).keys_have_null())], "size long, keys long, value long, row long, type string, null boolean"), f"""
WITH k AS ({ORACLE_SQL['q_cat_keys']}) SELECT (SELECT count(*) FROM customer) AS size, (SELECT count(*) FROM k) AS keys, (SELECT code FROM k WHERE key = 'MACHINERY') AS value,
  (SELECT code FROM ({_SEG}) t JOIN k ON t.s IS NOT DISTINCT FROM k.key WHERE pos = 2) AS row, 'tinyint' AS type, (SELECT count_if(key IS NULL) > 0 FROM k) AS null""")


# Columns with nulls and empty texts.
_SPARSE = "CASE WHEN doc_id % 5 = 1 THEN '' WHEN doc_id % 5 > 0 THEN text END"
for _n, _f, _sql in (
    ("lower", S.lower, "lower({s})"), ("upper", S.upper, _U.replace("{x}", "{s}")), ("title", S.title, None), ("len", S.length, "length({s})::INTEGER"), ("strip", lambda s: S.strip(s, ".Ter "), "trim({s}, '.Ter ')"),
    ("replace", lambda s: S.replace(s, "[aeiou]+", "*"), "regexp_replace({s}, '[aeiou]+', '*', 'g')"), ("translate", lambda s: S.translate(s, {"a": None, "e": "E"}), "translate({s}, 'ea', 'E')"), ("find", lambda s: S.find(s, "e"), "(strpos({s}, 'e') - 1)::INTEGER"),
    ("contains", lambda s: S.contains(s, "token", False), "contains({s}, 'token')"), ("count", lambda s: S.count(s, "e[nr]"), "coalesce(len(regexp_extract_all({s}, 'e[nr]')), 0)::INTEGER"), ("token_count", lambda s: T.token_count(s, " "), f"len({_SP})::INTEGER"),
    ("stol", C.stol, "CASE WHEN {s} IS NOT NULL THEN coalesce(try_cast(regexp_extract({s}, '^[+-]?[0-9]+') AS BIGINT), 0) END"), ("isalpha", S.isalpha, r"regexp_full_match({s}, '\p{L}+')"), ("wrap", lambda s: S.wrap(s, 40), None), ("hash", C.hash32, None), ("slice", lambda s: S.slice_(s, 2, 9), "substring({s}, 3, 7)"),
):
    _of = {"title": ORACLE_SQL["q_title"], "wrap": ORACLE_SQL["q_wrap"], "hash": ORACLE_SQL["q_hash"]}.get(_n)
    _add(f"q_{_n}_nulls", lambda s, d, f=_f: table(s, d, "documents").select("doc_id", f(F.expr(_SPARSE)).alias("v")), _of.replace("FROM documents", f"FROM (SELECT doc_id, {_SPARSE} AS text FROM documents)") if _of else f"SELECT doc_id, {_sql.replace('{s}', f'({_SPARSE})')} AS v FROM documents")
