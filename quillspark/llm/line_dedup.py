"""Line dedup by an exact set-similarity join.

A line (between \\n) with at least one word is the set of its words in lower case
(A-Z), with a class per distinct set. Words are ordered from rare to common over the
corpus, and by hash among equals. Two sets with Jaccard similarity of at least
percent / 100 share a word of their prefixes, which gives candidates. The length
filter, the positional filter and the parities of 64 buckets of words, which differ in
no more places than the sets do, leave few of them, and the whole sets decide. A line
goes when a line that is similar or the same comes earlier, by (doc_id, place in the
text).

Copies of a line are one class, so a line that a third of all documents hold is one
row of the join. A word of HEAVY or more occurrences stands in the join together with
the next words of the prefix, made one longer: sets that share it first share a second
one there too. So no hot word brings all its lines together. Sets that are too
small to be similar to any but their equals don't enter the join.

Defined results: a null text is an empty one and stays as it is; lines without words
always stay; null doc_ids come first. At 90 percent, lines of up to 8 distinct words
match only equal sets, and up to 18 an equal set or one with a word more or less: one
word replaced leaves (k-1)/(k+1) < 0.9. That is what the threshold means; percent is a
parameter. What is left keeps its order, and a text may end up empty, never dropped.
Of rows that repeat a doc_id and text, the one with the smallest hash of all columns
comes first and all lines with words go from the others. Sets are compared by 64-bit
hashes of words within a pair, classes told apart by 128 bits. Columns may have any
names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm import _text as tx
from quillspark.llm._rarity import Rarity, class_of, rarity
from quillspark.llm._spark import Hidden, bloom_of, cut, in_bloom, load, text_of, trimmed
from quillspark.llm._verify import cells, verify
from quillspark.llm.ngram_join import prefix, similar_enough

PERCENT, HEAVY = 90, 1024
ID = ["doc_id", "key"]


def line_sets(d: np.ndarray, o: np.ndarray, rare: Rarity) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word: text and place in it; then the lines' sets from rare to common, as bounds and elements."""
    low = tx.LOWER[d]
    s, e, lo = tx.words(low, o)
    h = tx.span_hash(low, s, e)
    key = (rare(h).astype(np.uint64) << tx.U(56)) | (h >> tx.U(8))
    line = np.searchsorted(np.flatnonzero(d == 10), s) + tx.owners(lo)  # each text begins a line
    own, first, keys = tx.ordered_sets(line, key)
    llo = np.concatenate([[0], np.cumsum(tx.sums(d == 10, o) + 1)])
    text = np.searchsorted(llo, own, "right") - 1
    return text, own - llo[text], first, keys


def least_size(percent: int) -> int:
    """The smallest set that can be similar to one that isn't its equal."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 40


def blocking_keys(first: np.ndarray, key: np.ndarray, percent: int, heavy: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set, join key and place of the first word of each key, for the sets of line_sets. heavy: the class of rarity from which a word needs a second one."""
    n = np.diff(first)
    p = np.where(n >= least_size(percent), prefix(n, percent), 0)
    owner = np.repeat(np.arange(len(n)), p)
    pos = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
    at = first[:-1][owner] + pos
    hot = (key[at] >> tx.U(56)) >= heavy
    out = [(owner[~hot], tx.mix(key[at[~hot]]), pos[~hot])]
    owner, at, pos, k = owner[hot], at[hot], pos[hot], 1
    while len(at):
        some = pos + k <= np.minimum(p, n - 1)[owner]
        owner, at, pos = owner[some], at[some], pos[some]
        out.append((owner, tx.mix(tx.mix(key[at]) + key[at + k]), pos))
        k += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def candidates(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From rows (words, s0, n, bits, pos) by words: pairs (a, b, n, m) of sets with a common key that pass the filters, each once a block. Keys whose rows aren't complete wait for the next batch."""
    held: list[np.ndarray] = []
    rows = 0

    def block(cols: list[np.ndarray]) -> pa.RecordBatch:
        order = np.lexsort((cols[1], cols[2], cols[0]))
        word, s0, n, bits, pos = (x[order] for x in cols)
        fresh = np.ones(len(word), bool)
        fresh[1:] = (word[1:] != word[:-1]) | (s0[1:] != s0[:-1])  # copies of a line
        word, s0, n, bits, pos = (x[fresh] for x in (word, s0, n, bits, pos))
        last = np.searchsorted(word, word, "right") - 1
        i, out = np.arange(len(word)), []
        k = 1
        while len(i := i[i + k <= last[i]]):
            j = i + k
            fits = 100 * n[i] >= percent * n[j]  # larger sets follow
            i, j = i[fits], j[fits]
            total = n[i] + n[j]
            # At the first shared word, all that can still be shared are the words from there on; and the sets differ in at least as many words as their parities do in places.
            ok = (100 + percent) * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= percent * total
            ok &= (100 + percent) * (total - np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64))) >= 2 * percent * total
            out.append(np.stack([i[ok], j[ok]]))
            k += 1
        p, q = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        swap = (n[p] == n[q]) & (s0[p] > s0[q])
        p, q = np.where(swap, q, p), np.where(swap, p, q)
        order = np.lexsort((s0[q], s0[p]))
        p, q = p[order], q[order]
        once = np.ones(len(p), bool)
        once[1:] = (s0[p[1:]] != s0[p[:-1]]) | (s0[q[1:]] != s0[q[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (s0[p[once]], s0[q[once]], n[p[once]], n[q[once]])], names=["a", "b", "n", "m"])

    for b in batches:
        cols = [np.asarray(c) for c in b.columns]
        if rows > 200_000 and len(cols[0]):
            end = int(np.searchsorted(cols[0], held[-1][0][-1], "right"))
            if end < len(cols[0]):
                yield block([np.concatenate([*(h[c] for h in held), cols[c][:end]]) for c in range(5)])
                held, rows, cols = [], 0, [c[end:] for c in cols]
        if len(cols[0]):
            held.append(cols)
            rows += len(cols[0])
    if held:
        yield block([np.concatenate([h[c] for h in held]) for c in range(5)])


def _each(source: DataFrame, rare: Rarity, schema: str, emit, extra=None) -> DataFrame:  # noqa: ANN001
    names = [x.split()[0] for x in schema.split(", ") if " " in x]
    state = source.sparkSession.sparkContext.broadcast((rare, extra))  # 4 MB, and a Bloom filter of at most 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_, extra_ = state.value
        for b in batches:
            d, o = tx.text_buffer(b.column("t"))
            for i, j, x, y in tx.chunks(d, o):
                yield pa.RecordBatch.from_arrays(emit(b.slice(i, j - i), *line_sets(x, y, rare_), extra_), names=names)

    return source.mapInArrow(trimmed(run), schema)


def _lists(first: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)


def matches(source: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, key, line): the lines of (doc_id, key, t) that an earlier one matches; key is a hash of doc_id and text."""
    rare = rarity(source.select("t"))
    heavy = class_of(HEAVY) if percent >= 67 else 256  # below that, two sets may be similar with one shared word

    def each_line(b: pa.RecordBatch, text: np.ndarray, place: np.ndarray, first: np.ndarray, key: np.ndarray, _: object) -> list[pa.Array]:
        s0, s1 = tx.set_hashes(first, key)
        n, own = np.diff(first), pa.array(text)
        bits = np.bitwise_xor.reduceat(tx.U(1) << (key & tx.U(63)), first[:-1]) if len(n) else key
        once = np.zeros(len(n), bool)
        once[np.unique(s0, return_index=True)[1]] = True  # copies in a chunk send their keys once
        owner, word, pos = blocking_keys(first, key, percent, heavy)
        sent = once[owner]
        owner, word, pos = owner[sent], word[sent], pos[sent]
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(len(n) + 1))
        cols = [b.column("doc_id").take(own), b.column("key").take(own), pa.array(place), pa.array(tx.as_long(s0)), pa.array(tx.as_long(s1)), pa.array(n), pa.array(tx.as_long(bits))]
        return [*cols, _lists(bounds, pa.array(tx.as_long(word[order]))), _lists(bounds, pa.array(pos[order].astype(np.int32)))]

    lines = cut(_each(source, rare, "doc_id long, key long, line long, s0 long, s1 long, n long, bits long, words array<long>, pos array<int>", each_line))
    # One exchange brings the sets of a key together.
    entries = lines.filter(F.size("words") > 0).select("s0", "n", "bits", F.inline(F.arrays_zip("words", "pos"))).repartition("words").sortWithinPartitions("words")
    found = entries.select("words", "s0", "n", "bits", "pos").mapInArrow(trimmed(lambda x: candidates(x, percent)), "a long, b long, n long, m long")
    pairs = cut(found.distinct())
    # Their sets come from the texts again, with the first occurrence of each.
    ends = cut(pairs.select(F.col("a").alias("s0"), "n").unionByName(pairs.select(F.col("b").alias("s0"), F.col("m").alias("n"))).distinct())
    met, placed = cells(pairs.select("a", "b"), ends.select(F.col("s0").alias("gid"), "s0", F.lit(0).cast("long").alias("s1"), "n"))
    met, placed = cut(met), cut(placed.drop("s1"))

    def each_set(b: pa.RecordBatch, text: np.ndarray, place: np.ndarray, first: np.ndarray, key: np.ndarray, bloom: np.ndarray) -> list[pa.Array]:
        s0, s1 = map(tx.as_long, tx.set_hashes(first, key))
        some = np.flatnonzero(in_bloom(bloom, s0))
        once = np.zeros(len(s0), bool)
        once[some[np.unique(s0[some], return_index=True)[1]]] = True  # copies in a chunk send their set once
        own, offs = pa.array(text[some]), np.concatenate([[0], np.cumsum(np.where(once, np.diff(first), 0)[some])])
        flat = key[np.repeat(once & in_bloom(bloom, s0), np.diff(first))]
        return [b.column("doc_id").take(own), b.column("key").take(own), pa.array(place[some]), pa.array(s0[some]), pa.array(s1[some]), _lists(offs, pa.array(tx.as_long(flat)))]

    sent = _each(source, rare, "doc_id long, key long, line long, s0 long, s1 long, keys array<long>", each_set, bloom_of(ends, F.col("s0"))).join(ends.select("s0"), "s0")
    sets_ = cut(sent.groupBy("s0", "s1").agg(F.min(F.struct(*ID, "line")).alias("first"), F.max("keys").alias("keys")))
    links = cut(verify(met, placed.join(sets_.select("s0", "s1", "keys"), "s0"), similar_enough(percent)))
    both = links.unionByName(links.select(F.col("b0").alias("a0"), F.col("b1").alias("a1"), F.col("a0").alias("b0"), F.col("a1").alias("b1")))
    near = both.join(sets_.select(F.col("s0").alias("b0"), F.col("s1").alias("b1"), "first"), ["b0", "b1"]).groupBy(F.col("a0").alias("s0"), F.col("a1").alias("s1")).agg(F.min("first").alias("near"))
    firsts = lines.groupBy("s0", "s1").agg(F.min(F.struct(*ID, "line")).alias("first"))
    earliest = firsts.join(near, ["s0", "s1"], "left").select("s0", "s1", F.least("first", "near").alias("e")).hint("shuffle_hash")  # a class is one row, so the table of a partition stays small
    return lines.select(*ID, "line", "s0", "s1").join(earliest, ["s0", "s1"]).filter(F.struct(*ID, "line") > F.col("e")).select(*ID, "line")


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (columns that pass, t, gone, again): the texts without the lines `gone`, or without all that have words where the row repeats another; lines and those removed."""
    for b in batches:
        kept, t, gone, again = b.num_columns - 3, b.column("t"), b.column("gone"), b.column("again")
        has = pc.greater(pc.fill_null(pc.binary_length(t), 0), 0)
        touched = pc.and_(has, pc.or_(pc.is_valid(gone), again))
        n_lines = np.asarray(pc.fill_null(pc.add(pc.count_substring(t, "\n"), pc.cast(has, pa.int32())), 0)).astype(np.int64)
        removed, left = np.zeros(b.num_rows, np.int64), []
        at = np.flatnonzero(np.asarray(touched))
        for i, x, g, r in zip(at.tolist(), *(c.filter(touched).to_pylist() for c in (t, gone, again)), strict=True):
            parts, drop = x.split("\n"), set(g or ())
            some = [p for k, p in enumerate(parts) if k not in drop and not (r and p.strip("\t\n\v\f\r "))]
            removed[i] = len(parts) - len(some)
            left.append("\n".join(some))
        new = pc.replace_with_mask(t, touched, pa.array(left, t.type))
        yield pa.RecordBatch.from_arrays([*b.columns[:kept], new, pa.array(n_lines), pa.array(removed)], names=[*b.schema.names[:kept], "t", "n_lines", "n_removed_lines"])


def _dedup(own: Hidden, text: str, doc_id: str, percent: int) -> DataFrame:
    """The kept columns of own, then t, n_lines and n_removed_lines."""
    t = text_of(own.of(text))
    source = own.df.withColumns({"doc_id": F.col(own.of(doc_id)).cast("long"), "t": t}).withColumns({"key": F.xxhash64("doc_id", F.coalesce("t", F.lit(""))), "id": F.coalesce("doc_id", F.lit(0))})
    gone = matches(source.select(*ID, F.coalesce("t", F.lit("")).alias("t")), percent)
    gone = cut(gone.groupBy(*ID).agg(F.collect_set("line").alias("gone")))  # so that the exchanges before it are gone when texts are sent
    joined = source.alias("d").join(gone.select("key", F.coalesce("doc_id", F.lit(0)).alias("id"), "gone").alias("g"), ["key", "id"], "left")  # keys of null ids differ from those of 0
    # Rows with one doc_id and text: the exchange of the join has brought them together.
    row = F.xxhash64(*(x for c in own.df.columns for x in (F.col(f"d.{c}").isNull(), F.col(f"d.{c}"))))
    number = F.row_number().over(W.partitionBy("key", "id").orderBy(row))
    out = joined.select(*(F.col(f"d.{c}") for c in own.kept), F.col("d.t").alias("t"), F.col("g.gone").alias("gone"), (number > 1).alias("again"))
    schema = out.drop("gone", "again").schema.add("n_lines", "long").add("n_removed_lines", "long")
    return out.mapInArrow(trimmed(_removed), schema)


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """docs with its text less the lines that match earlier ones; n_chars, where there is one, is the new length in characters. Adds n_lines and n_removed_lines, in place of columns so named."""
    own = Hidden(docs, ["n_lines", "n_removed_lines"])
    return own.back(_with_text(own, _dedup(own, text, doc_id, percent), text))


def _with_text(own: Hidden, out: DataFrame, text: str) -> DataFrame:
    """out with the new text, and its length, in the places of the old ones."""
    changed = {own.of(text): F.col("t").cast(own.df.schema[own.of(text)].dataType)}
    if "n_chars" in own.names and text != "n_chars":
        c = own.of("n_chars")
        changed[c] = F.when(F.col("n_removed_lines") > 0, F.char_length("t").cast(own.df.schema[c].dataType)).otherwise(F.col(c))
    return out.withColumns(changed)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those that go, and the SHA-256 of what is left (of the empty text for a null)."""
    out = dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.col("n_removed_lines").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents without their repeated lines, less those of which no word is left though they had some. Null, empty and wordless texts stay; columns may have any names."""
    own = Hidden(docs)
    out = _with_text(own, _dedup(own, "text", "doc_id", PERCENT), "text")
    emptied = (F.col("n_removed_lines") > 0) & ~F.col("t").rlike(r"[^\x20\x09-\x0D]")
    return own.back(out.filter(~F.coalesce(emptied, F.lit(False))))


#: The same prefix filter as SQL, with exact counts of words.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
x AS (SELECT doc_id, i, l[i] AS line, list_sort(list_distinct(regexp_extract_all(translate(l[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS k FROM u),
y AS (SELECT doc_id, i, k, row_number() OVER (ORDER BY doc_id, i) AS r FROM x WHERE len(k) > 0),
s AS (SELECT k, min(r) AS r, len(k) AS n FROM y GROUP BY k),
w AS (SELECT r, n, unnest(k) AS w FROM s),
c AS (SELECT w, count(*) AS c FROM w GROUP BY w),
p AS (SELECT r, n, w FROM w JOIN c USING (w) QUALIFY row_number() OVER (PARTITION BY r ORDER BY c, w) <= n - (90 * n + 99) // 100 + 1),
q AS (SELECT DISTINCT a.r AS a, b.r AS b FROM p a JOIN p b ON a.w = b.w AND a.r < b.r AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
m AS (SELECT b AS r, min(a) AS m FROM q JOIN s e ON a = e.r JOIN s f ON b = f.r WHERE 190 * len(list_intersect(e.k, f.k)) >= 90 * (e.n + f.n) GROUP BY b),
g AS (SELECT doc_id, i FROM y JOIN s ON y.k = s.k LEFT JOIN m ON m.r = s.r WHERE y.r > coalesce(m.m, s.r))
SELECT x.doc_id, CASE WHEN any_value(t) = '' THEN 0 ELSE count(*) END::BIGINT AS n_lines, count(g.i)::BIGINT AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY x.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM x JOIN d ON d.doc_id = x.doc_id LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id"""
