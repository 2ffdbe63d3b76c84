"""Exact removal of repeated byte strings with two-stage suffix sorting.

A byte goes when a string of LENGTH bytes that covers it starts anywhere else.
Each window of LENGTH bytes is assigned to its anchor, the K-byte string in it
with the smallest hash; equal windows have equal anchors. Neighbouring windows with the
same anchor are a piece, and only pieces whose anchor occurs again go on. Pieces
that are equal as a whole are repeated and need no sorting. Of the others one of
each is brought, with its text, to its anchor's task, and the windows of all
pieces there are suffix-sorted together in two stages: suffixes that are smaller
than their successors are sorted directly, all others are induced by one scan of
the buckets; common prefixes of neighbours then tell which windows are repeated.
An anchor with more than HOT different pieces isn't gathered: its pieces' windows
are counted by 128 bits of hash instead, which combines before the shuffle.

Equality of pieces is by 64-bit hashes among those of one anchor, that of windows by
their bytes (hot anchors: by the 128 bits). Defined results: a null text is an empty
one; texts shorter than LENGTH lose nothing; matches never cross texts; rows that
repeat one another in doc_id and text repeat all their strings, so from LENGTH bytes
on they lose everything. Extra columns pass through, whatever their names. LENGTH may
be K to 65,000.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import _text as tx
from quillspark.llm._spark import Hidden, cut, load, text_of

LENGTH, K, HOT, SLICE, BATCH = 200, 32, 20_000, 1 << 19, 1 << 20
_PLACE = tx.U((1 << 30) - 1)


def pieces(d: np.ndarray, o: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """For each piece: anchor's hash, the piece's, text, first window's start in the text, number of windows."""
    w, some = length - k + 1, np.flatnonzero(np.diff(o) >= length)
    empty = np.zeros(0, np.int64)
    if not len(some):
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    h = tx.prefix_hash(d)
    at = np.arange(len(d) - k + 1)
    hk = tx.rolled(h, at, at + k)
    value = np.full(-(-len(hk) // w) * w + w, np.uint64(2**64 - 1))
    value[: len(hk)] = (hk & ~_PLACE) | at.astype(np.uint64)
    table = value.reshape(-1, w)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(table, axis=1).ravel()
    count = o[1:][some] - o[:-1][some] - length + 1
    first = np.repeat(o[:-1][some] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    anchor = (np.minimum(ahead[first], behind[first + w - 1]) & _PLACE).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    n = np.diff(np.concatenate([edge, [len(first)]]))
    lo, p = first[edge], anchor[edge]
    whole = tx.mix(tx.span_hash(d, lo, lo + n - 1 + length) + (p - lo).astype(np.uint64))
    owner = np.searchsorted(o, lo, "right") - 1
    return hk[p], whole, owner, lo - o[owner], n


def sliced(d: np.ndarray, o: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts, long ones in slices that overlap by length - 1: first text, place in it, bytes, offsets."""
    for i, j, x, y in tx.chunks(d, o, SLICE):
        if j - i > 1 or len(x) <= 2 * SLICE:
            yield i, 0, x, y
        else:
            for at in range(0, len(x) - length + 1, SLICE):
                part = x[at : at + SLICE + length - 1]
                yield i, at, part, np.array([0, len(part)])


def smaller(b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; strings end before the places `ends`, their last suffixes aren't."""
    out = np.zeros(len(b), bool)
    if not len(b):
        return out
    differs = np.ones(len(b), bool)
    differs[:-1] = b[1:] != b[:-1]
    differs[ends - 1] = True
    place = np.where(differs, np.arange(len(b)), len(b))
    nxt = np.minimum.accumulate(place[::-1])[::-1]
    up = np.zeros(len(b), bool)
    up[:-1] = b[1:] > b[:-1]
    up[ends - 1] = False
    return up[nxt]


def sort_suffixes(b: np.ndarray, start: np.ndarray, size: np.ndarray, last: np.ndarray, depth: int) -> np.ndarray:
    """Suffix places of several strings, sorted by their first `depth` bytes. String i is b[start:start + size]; its suffixes up to `last` count,
    which must be smaller than its successor or be the string's end."""
    ends = start + size
    small = smaller(b, ends)
    counts = np.zeros(len(b) + 1, bool)
    m = np.minimum(last + 1, size)
    own = np.repeat(start - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
    counts[own] = True
    cut_at = last < size
    small[(start + last)[cut_at]] = True
    # First stage: those smaller than their successors, directly.
    direct = own[small[own]]
    text, end = b.tobytes().decode("latin-1"), np.repeat(ends, m)[small[own]]
    keys = [text[p:q] for p, q in zip(direct.tolist(), np.minimum(direct + depth, end).tolist(), strict=True)]
    direct = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)] if keys else direct
    edges = np.searchsorted(b[direct], np.arange(257))
    # Second stage: one scan of the buckets by first byte; a suffix puts its predecessor, if that is larger than it, at the end of the predecessor's bucket.
    first = np.zeros(len(b), bool)
    first[start] = True
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def hand_on(places: np.ndarray) -> None:
        value = b[places]
        order = np.argsort(value, kind="stable")
        value, places = value[order], places[order]
        for c, p in zip(*np.unique(value, return_index=True), strict=True):
            waiting[c].append(places[p : np.searchsorted(value, c, "right")])

    done = (ends - 1)[~cut_at]
    hand_on(done)
    out = []
    for c in range(256):
        level = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        parts = []
        while len(level):  # those with the same first byte as their successor follow it in this bucket
            parts.append(level)
            before = level[~first[level]] - 1
            level = before[(b[before] == c) & counts[before] & ~small[before]]
        row = np.concatenate([*parts, direct[edges[c] : edges[c + 1]]])
        out.append(row)
        before = row[~first[row]] - 1
        hand_on(before[(b[before] > c) & counts[before] & ~small[before]])
    return np.concatenate(out) if out else own[:0]


def repeated(b: np.ndarray, start: np.ndarray, size: np.ndarray, last: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """The places of windows, among each string's first `windows`, that some other window equals."""
    valid = np.zeros(len(b), bool)
    valid[np.repeat(start - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())] = True
    order = sort_suffixes(b, start, size, last, length)
    order = order[valid[order]]
    # Common prefixes of neighbours, eight bytes at a time, as far as they reach.
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    word = np.ndarray((len(b) + 1,), "<u8", padded, strides=(1,))
    alive = np.arange(len(order) - 1)
    for t in [*range(0, length - 7, 8), length - 8]:
        if not len(alive):
            break
        alive = alive[word[order[alive] + t] == word[order[alive + 1] + t]]
    hit = np.zeros(len(order), bool)
    hit[alive] = hit[alive + 1] = True
    return np.sort(order[hit])


def _anchors(source: DataFrame, length: int) -> DataFrame:
    """(h, whole, key, place): place is the first window's start * 2^16 + windows - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, o = tx.text_buffer(b.column(1))
            keys = np.asarray(b.column(0))
            for i, at, x, y in sliced(d, o, length):
                h, whole, owner, lo, n = pieces(x, y, length)
                yield pa.RecordBatch.from_arrays([pa.array(tx.as_long(h)), pa.array(tx.as_long(whole)), pa.array(keys[i + owner]), pa.array(((lo + at) << 16) + n - 1)], names=["h", "whole", "key", "place"])

    return source.mapInArrow(run, "h long, whole long, key long, place long")


def _bring(joined: DataFrame, length: int) -> DataFrame:
    """(h, key, lo, windows, last, single, b): the bytes of pieces, on to a suffix that is smaller than its successor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, o = tx.text_buffer(b.column("t"))
            lists, rows = b.column("wanted"), []
            flat, offs, key = lists.values, np.asarray(lists.offsets), np.asarray(b.column("key"))
            hs, places, singles = (np.asarray(flat.field(c)) for c in ("h", "place", "single"))
            for r in range(b.num_rows):
                x = d[o[r] : o[r + 1]]
                ups = np.flatnonzero(smaller(x, np.array([len(x)])))
                for q in range(offs[r], offs[r + 1]):
                    lo, n = int(places[q]) >> 16, (int(places[q]) & 65535) + 1
                    at = np.searchsorted(ups, lo + n - 1)
                    e = int(ups[at]) if at < len(ups) else len(x)
                    rows.append((hs[q], key[r], lo, n, e - lo, singles[q], x[lo : e + length].tobytes()))
                if len(rows) > 20_000:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        types = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["h", "key", "lo", "windows", "last", "single", "b"])

    return joined.mapInArrow(run, "h long, key long, lo long, windows long, last long, single boolean, b binary")


def _sorted(brought: DataFrame, length: int) -> DataFrame:
    """(key, lo, hi): runs of bytes covered by repeated windows. An anchor's pieces stay together; several anchors' are sorted at once."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        h, key, lo, windows, last, single, parts = zip(*held, strict=True)
        del h
        size = np.array([len(x) for x in parts])
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        b = np.frombuffer(b"".join(parts), np.uint8)
        found = repeated(b, start, size, np.array(last), np.array(windows), length)
        owner = np.searchsorted(start, found, "right") - 1
        keep = np.array(single)[owner]
        found, owner = found[keep], owner[keep]
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(found) != 1) | (np.diff(owner) != 0)])) if len(found) else found
        first, own = found[edge], owner[edge]
        final = found[np.concatenate([edge[1:], [len(found)]]).astype(np.int64) - 1] if len(found) else found
        at = np.array(lo)[own] - start[own] if len(own) else own
        return pa.RecordBatch.from_arrays([pa.array(np.array(key)[own].astype(np.int64)), pa.array((first + at).astype(np.int64)), pa.array((final + at + length).astype(np.int64))], names=["key", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, at = 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != at and size > BATCH:
                    yield solve(held)
                    held, size = [], 0
                at = row[0]
                held.append(row)
                size += len(row[6])
        if held:
            yield solve(held)

    spread = brought.repartition("h").sortWithinPartitions("h", "key", "lo")
    return spread.mapInArrow(run, "key long, lo long, hi long")


def _counted(joined: DataFrame, length: int) -> DataFrame:
    """(key, lo, hi): the same for anchors with very many pieces, by the hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, o = tx.text_buffer(b.column("t"))
            lists, key = b.column("wanted"), np.asarray(b.column("key"))
            offs, places = np.asarray(lists.offsets), np.asarray(lists.values.field("place"))
            for r in range(b.num_rows):
                x, own = d[o[r] : o[r + 1]], places[offs[r] : offs[r + 1]]
                at = np.concatenate([np.arange(p >> 16, (p >> 16) + (p & 65535) + 1) for p in own]) if len(own) else own
                yield pa.RecordBatch.from_arrays([*(pa.array(tx.as_long(tx.span_hash(x, at, at + length, seed))) for seed in (0, 1)), pa.array(np.full(len(at), key[r])), pa.array(at)], names=["w", "v", "key", "lo"])

    windows = joined.mapInArrow(run, "w long, v long, key long, lo long")
    twice = windows.groupBy("w", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w", "v")
    return windows.join(twice, ["w", "v"]).select("key", "lo", (F.col("lo") + length).alias("hi"))


def repeats(source: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(key, lo, hi): runs of bytes of the texts (key, t) that repeat, which may overlap. Rows with one key count as one."""
    if not K <= length <= 65_000:
        raise ValueError(f"length must be {K} to 65000, not {length}")
    anchors = _anchors(source, length)
    twice = anchors.groupBy("h").agg(F.min(F.struct("key", "place")).alias("a"), F.max(F.struct("key", "place")).alias("z")).filter("a <> z").select("h")
    again = cut(anchors.join(twice, "h").distinct())
    wholes = cut(again.groupBy("h", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("one")))
    same = again.join(wholes.filter("n > 1").select("h", "whole"), ["h", "whole"])
    equal = same.select("key", F.shiftright("place", 16).alias("lo"), (F.shiftright("place", 16) + F.col("place").bitwiseAND(65535) + length).alias("hi"))
    by_anchor = wholes.groupBy("h").agg(F.count(F.lit(1)).alias("pieces"), F.min("n").alias("least")).filter("pieces > 1 AND least = 1").select("h", "pieces")
    wanted = wholes.join(by_anchor, "h").select("h", "one.key", "one.place", (F.col("n") == 1).alias("single"), (F.col("pieces") > hot).alias("hot"))
    lists = cut(wanted.groupBy("key", "hot").agg(F.collect_list(F.struct("h", "place", "single")).alias("wanted")))
    texts = source.dropDuplicates(["key"])
    cold = _sorted(_bring(texts.join(lists.filter("NOT hot").select("key", "wanted"), "key"), length), length)
    found = equal.unionByName(cold)
    if lists.filter("hot").limit(1).count():
        found = found.unionByName(_counted(texts.join(lists.filter("hot").select("key", "wanted"), "key"), length))
    return found


def remove(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """docs (the columns `keep`, or all) with kept (the bytes that are left), n_bytes, n_removed, n_spans and kept_sha256 in place of any columns so named."""
    own = Hidden(docs, ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"], keep)
    t = F.coalesce(text_of(own.of(text)), F.lit(""))
    source = own.df.select(*own.kept, F.xxhash64(own.of(doc_id), t).alias("key"), t.alias("t"))
    lists = repeats(source.select("key", "t"), length, hot).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    # The exchange of the join has brought rows with one key together.
    joined = source.join(lists, "key", "left").select(*own.kept, "t", "runs", (F.count(F.lit(1)).over(W.partitionBy("key")) > 1).alias("again"))
    types = [T.BinaryType(), T.LongType(), T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([*joined.select(*own.kept).schema.fields, *(T.StructField(n, k) for n, k in zip(own.outputs, types, strict=True))])
    names, kept = own.outputs, own.kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, o = tx.text_buffer(b.column("t"))
            lists_, rows, again = b.column("runs"), [], b.column("again").to_pylist()
            offs, null = np.asarray(lists_.offsets), np.asarray(lists_.is_null())
            los, his = (np.asarray(lists_.values.field(c)) for c in ("lo", "hi"))
            for r in range(b.num_rows):
                x = d[o[r] : o[r + 1]]
                edge = np.zeros(len(x) + 1, np.int64)
                if again[r] and len(x) >= length:
                    edge[0] = 1
                elif not null[r]:
                    np.add.at(edge, los[offs[r] : offs[r + 1]], 1)
                    np.add.at(edge, his[offs[r] : offs[r + 1]], -1)
                gone = np.cumsum(edge)[:-1] > 0
                left = x[~gone].tobytes()
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
                rows.append((left, len(x), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
            new = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(c, k) for c, k in zip(new, kinds, strict=True))], names=[*kept, *names])

    return own.back(joined.mapInArrow(run, schema))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes among all documents."""
    return remove(load(spark, sf_dir, "documents"), keep=["doc_id"]).drop("kept")


#: All windows of 200 bytes, by their MD5.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
g AS (SELECT doc_id, n, o, h[2 * o + 1:2 * o + 4398] AS g FROM (SELECT doc_id, n, h, unnest(range(0, n - 199, 2000)) AS o FROM d)),
w AS (SELECT doc_id, o + j AS i, md5(g[2 * j + 1:2 * j + 400]) AS k FROM (SELECT doc_id, o, g, unnest(range(0, least(2000, n - 199 - o))) AS j FROM g)),
c AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM w SEMI JOIN c USING (k)),
b AS (SELECT doc_id, unnest(range(0, n)) AS p, unnest(regexp_extract_all(h, '..')) AS x FROM d),
z AS (SELECT b.doc_id, p, x, coalesce(max(r.i) OVER (PARTITION BY b.doc_id ORDER BY p) >= p - 199, false) AS gone FROM b LEFT JOIN r ON r.doc_id = b.doc_id AND r.i = p),
e AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY p) AS opens FROM z),
a AS (SELECT doc_id, count_if(gone) AS n_removed, count_if(opens) AS n_spans, string_agg(x, '' ORDER BY p) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""
