"""N-gram Jaccard join of documents: a grouped prefix join.

A document's set holds its distinct windows of N words. Documents with equal sets
are one class. Sets are ordered from rare to common, where a window is as rare as
its rarest word over the corpus, and by hash among equals; two sets that are similar
enough share an element of their prefixes. Prefix elements are shuffled once, and
those that only one class has in its prefix go no further. Classes with the same
size and the same remaining prefix form a group, and groups meet at shared elements.
A pair of groups stays a candidate when the sizes fit and the elements that both can
still share, in their prefixes from that element on and behind the prefix that ends
first, suffice. Candidate groups are expanded: the whole sets of their members, read
from the texts again, decide.

Only candidate pairs are compared, in cells of bounded size (see `_verify`), which send on
each class's sum of links and a star of each connected part, no list of links. A very
common element stands behind the prefixes by its order; where a corpus makes one hot
nevertheless, the join on elements is a plain sort-merge join, which spills and which
adaptive execution splits.

Sets are compared by 64-bit hashes of windows within a pair, and classes told apart
by 128-bit hashes of whole sets.

Defined results: a null text is an empty one; a document without words has an empty
set and no links; one with fewer than N words has one element, all its words. Copies
are linked with each other. Rows that repeat a doc_id, and rows with a null one, count
as documents of their own; component_id is the smallest doc_id that isn't null (null
if there is none; a document without links has its own). Columns besides doc_id and
text aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _text as tx
from quillspark.llm._rarity import Rarity, rarity
from quillspark.llm._spark import Hidden, bloom_of, cut, in_bloom, load, text_of, trimmed
from quillspark.llm._verify import cells, verify
from quillspark.llm.components import components

N = 3


def sets(d: np.ndarray, o: np.ndarray, rare: Rarity, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of the texts from rare to common: texts that have one, their first places (bounds), elements."""
    x = tx.LOWER[d]
    s, e, lo = tx.words(x, o)
    h = tx.span_hash(x, s, e)
    c = rare(h)
    counts, owner, keys = np.diff(lo), [], []
    for size in range(1, n + 1):
        own = np.flatnonzero((counts == size) if size < n else (counts >= n))
        if not len(own):
            continue
        g, glo = tx.grams(h, lo, size)
        low = c.copy()
        for k in range(1, size):
            low[:-k] = np.minimum(low[:-k], c[k:])
        text = tx.owners(glo)
        first = np.arange(len(g)) - glo[text] + lo[text]
        g = (low[first].astype(np.uint64) << tx.U(56)) | (g >> tx.U(8))
        if size == n:
            owner.append(text)
            keys.append(g)
        else:
            owner.append(own)
            keys.append(g[glo[own]])
    if not owner:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    at = np.concatenate(owner)
    order = np.argsort(at, kind="stable") if len(owner) > 1 else slice(None)
    return tx.ordered_sets(at[order], np.concatenate(keys)[order])


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """Elements of a set of n of which a similar set holds at least one."""
    return n - -(-percent * n // 100) + 1


def _each(texts: DataFrame, rare: Rarity, schema: str, emit) -> DataFrame:  # noqa: ANN001
    """One narrow pass over (doc_id, t): emit(rows of a batch, texts with a set, bounds, elements, hashes) gives the columns of schema."""
    names = [x.split()[0] for x in schema.split(", ")]
    state = texts.sparkSession.sparkContext.broadcast(rare)  # 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, o = tx.text_buffer(b.column("t"))
            for i, j, x, y in tx.chunks(d, o):
                own, first, key = sets(x, y, state.value)
                yield pa.RecordBatch.from_arrays(emit(b.slice(i, j - i), own, first, key, tx.set_hashes(first, key)), names=names)

    return texts.mapInArrow(trimmed(run), schema)


def similar_enough(percent: int):  # noqa: ANN201
    """Whether the overlaps of whole sets make pairs similar."""
    return lambda both, n, m: (100 + percent) * both >= percent * (n + m)


def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, s0, pos) in this order, those whose key two or more different s0 have, once each. Nothing but one row is held from batch to batch."""
    held: tuple[int, ...] | None = None
    known = False  # whether the held row's key is shared, and the row out already
    for b in batches:
        k, s, p = (np.asarray(c) for c in b.columns)
        if held is not None:
            k, s, p = (np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(held, (k, s, p), strict=True))
        if not len(k):
            continue
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        k, s, p = k[fresh], s[fresh], p[fresh]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(k)))
        ok = size > 1
        if known:
            ok[0] = True
        out = np.repeat(ok, size)
        out[0] &= not known
        yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(s[out]), pa.array(p[out])], names=["key", "s0", "pos"])
        held, known = (int(k[-1]), int(s[-1]), int(p[-1])), bool(ok[-1])


def join(texts: DataFrame, percent: int = 70) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For texts (doc_id, t): documents (doc_id, n_shingles, s0, s1), classes (s0, s1, n, rep, size), links (a0, a1, b0, b1, others) between classes: they connect those that are similar, and a class has as many similar documents of other classes as its `others` sum up to. Documents without words have null hashes."""
    rare = rarity(texts.select("t"))

    def each_doc(b: pa.RecordBatch, own: np.ndarray, first: np.ndarray, key: np.ndarray, hashes: tuple) -> list[pa.Array]:
        cols = [np.zeros(b.num_rows, np.int64) for _ in range(4)]
        n = np.diff(first)
        for c, x in zip(cols, (n, *map(tx.as_long, hashes), tx.as_long(key[first[:-1] + prefix(n, percent) - 1])), strict=True):
            c[own] = x
        return [b.column("doc_id"), *map(pa.array, cols)]

    known = cut(_each(texts, rare, "doc_id long, n_shingles long, s0 long, s1 long, last long", each_doc))
    # Keys compare as signed numbers in the JVM; with the first bit turned they keep their order.
    turned = F.col("last").bitwiseXOR(F.lit(-(2**63)))
    classes = cut(known.filter("n_shingles > 0").groupBy("s0", "s1").agg(F.max("n_shingles").alias("n"), F.max(turned).alias("last"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")))

    def each_key(b: pa.RecordBatch, own: np.ndarray, first: np.ndarray, key: np.ndarray, hashes: tuple) -> list[pa.Array]:
        del b, own
        once = np.unique(hashes[0], return_index=True)[1]  # copies in a chunk count once
        p = prefix(np.diff(first), percent)[once]
        pos = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
        at = pos + np.repeat(first[:-1][once], p)
        return [pa.array(tx.as_long(key[at] ^ tx.U(1 << 63))), pa.array(np.repeat(tx.as_long(hashes[0][once]), p)), pa.array(pos.astype(np.int32))]

    entries = _each(texts, rare, "key long, s0 long, pos int", each_key)
    found = entries.repartition("key").sortWithinPartitions("key", "s0").mapInArrow(trimmed(shared_only), "key long, s0 long, pos int")
    prefixes = found.groupBy("s0").agg(F.sort_array(F.collect_list(F.struct("key", "pos"))).alias("keys")).join(classes.select("s0", "s1", "n", "last"), "s0")
    prefixes = cut(prefixes.withColumns({"h": F.xxhash64("keys"), "h2": F.xxhash64(F.lit(1), "keys")}))
    by = ["n", "last", "h", "h2"]
    groups = cut(prefixes.groupBy(*by).agg(F.min("s0").alias("gid"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("members")))
    members = prefixes.select("s0", "s1", *by).join(groups.select(*by, "gid"), by).select("gid", "s0", "s1", "n")
    # Groups meet at a shared element. If it is their first one, they share no more than what each has from it on, nor than
    # the elements that any shares in both prefixes from it on and what lies behind the prefix that ends first.
    rest = F.col("n") - F.floor((F.lit(100 - percent) * F.col("n")) / F.lit(100)) - 1
    e = groups.select("gid", "n", "last", rest.alias("rest"), F.col("keys")[0]["key"].alias("f1"), F.get("keys", F.lit(1))["key"].alias("f2"), F.size("keys").alias("k"), F.posexplode("keys").alias("i", "e"))
    e = e.select("e.key", "gid", "n", "last", "rest", "f1", F.coalesce("f2", "f1").alias("f2"), (F.col("k") - F.col("i")).alias("ahead"), (F.col("n") - F.col("e.pos")).alias("reach"))
    behind = F.when(F.col("a.last") < F.col("b.last"), F.col("a.rest")).when(F.col("a.last") > F.col("b.last"), F.col("b.rest")).otherwise(F.least("a.rest", "b.rest"))
    a, b = e.alias("a"), e.alias("b")
    fits = (F.col("a.key") == F.col("b.key")) & (F.lit(100) * F.col("a.n") >= percent * F.col("b.n"))
    fits &= (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.gid") < F.col("b.gid")))
    fits &= F.lit(100 + percent) * F.least(F.least("a.ahead", "b.ahead") + behind, "a.reach", "b.reach") >= percent * (F.col("a.n") + F.col("b.n"))
    for f in ("f1", "f2"):  # most pairs share one of their first elements; later ones needn't say it again
        fits &= ~((F.col(f"a.{f}") < F.col("a.key")) & ((F.col(f"a.{f}") == F.col("b.f1")) | (F.col(f"a.{f}") == F.col("b.f2"))))
    pairs = a.join(b, fits).select(F.col("a.gid").alias("a"), F.col("b.gid").alias("b"))
    # Members of one group share their remaining prefix; they can be similar if that and what lies behind it suffice.
    inside = groups.filter((F.col("members") > 1) & (F.lit(100 + percent) * F.least(F.size("keys") + rest, F.col("n")) >= F.lit(2 * percent) * F.col("n"))).select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    candidates = cut(pairs.distinct().unionByName(inside))
    met, placed = cells(candidates, cut(members))
    met, placed = cut(met), cut(placed)
    full = _wanted_sets(texts, rare, placed.select("s0", "s1").distinct().join(classes.select("s0", "s1", "rep", "size"), ["s0", "s1"]))
    links = cut(verify(met, placed.join(full, ["s0", "s1"]), similar_enough(percent), summed=True))
    return known.select("doc_id", "n_shingles", *(F.when(F.col("n_shingles") > 0, F.col(c)).alias(c) for c in ("s0", "s1"))), classes.drop("last"), links


def _wanted_sets(texts: DataFrame, rare: Rarity, wanted: DataFrame) -> DataFrame:
    """(s0, s1, keys, size) of the classes of wanted (s0, s1, rep, size). A Bloom filter over their documents keeps most others from being sent."""
    wanted = cut(wanted)
    state = texts.sparkSession.sparkContext.broadcast((bloom_of(wanted, F.xxhash64("rep")), rare))  # at most 32 and 4 MB
    source = texts.select(F.xxhash64("doc_id").alias("h"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, rare_ = state.value
        for b in batches:
            b = b.filter(pa.array(in_bloom(bits, np.asarray(b.column(0)))))
            d, o = tx.text_buffer(b.column(1))
            for _, _, x, y in tx.chunks(d, o):
                own, first, key = sets(x, y, rare_)
                s0, s1 = tx.set_hashes(first, key)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tx.as_long(key)))
                some = pa.array(np.unique(s0, return_index=True)[1] if len(own) else np.zeros(0, np.int64))  # copies in a chunk are sent once
                yield pa.RecordBatch.from_arrays([pa.array(tx.as_long(s0)).take(some), pa.array(tx.as_long(s1)).take(some), lists.take(some)], names=["s0", "s1", "keys"])

    sent = source.mapInArrow(trimmed(run), "s0 long, s1 long, keys array<long>")
    return sent.join(wanted.select("s0", "s1", "size"), ["s0", "s1"]).groupBy("s0", "s1").agg(F.first("keys").alias("keys"), F.first("size").alias("size"))


def _name(s0: str, s1: str):  # noqa: ANN202
    """One value for the two halves of a class's hash."""
    return F.concat(F.lpad(F.hex(s0), 16, "0"), F.lpad(F.hex(s1), 16, "0"))


def class_components(links: DataFrame) -> DataFrame:
    """(node, component): names of linked classes and of their components."""
    return components(links.select(_name("a0", "a1").alias("a"), _name("b0", "b1").alias("b")))


def similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 70) -> DataFrame:
    """Per document: doc_id, n_shingles, n_similar, component_id and class_id (the smallest doc_id with the same set)."""
    own = Hidden(docs)
    texts = own.df.select(F.col(own.of(doc_id)).cast("long").alias("doc_id"), text_of(own.of(text)).alias("t"))
    known, classes, links = join(texts, percent)
    by = classes.select("s0", "s1", "rep", "size")
    near = links.groupBy(F.col("a0").alias("s0"), F.col("a1").alias("s1")).agg(F.sum("others").alias("others"))
    linked = by.select("s0", "s1", "rep", _name("s0", "s1").alias("node")).join(class_components(links), "node")
    least = linked.join(linked.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("s0", "s1", "component_id")
    info = by.join(near, ["s0", "s1"], "left").join(least, ["s0", "s1"], "left")
    info = info.select("s0", "s1", F.col("rep").alias("class_id"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"), F.coalesce("component_id", "rep").alias("component_id"))
    out = known.join(info, ["s0", "s1"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("n_similar", F.lit(0)).alias("n_similar"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return similar(load(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id (nulls last; among equals, the smallest hash of the row); all documents without words are kept.

    Rows are told apart by a 64-bit hash of all their columns, so null and repeated doc_ids count as documents of
    their own; rows that repeat another in all columns are one. Columns may have any names; an empty table gives no rows.
    """
    own = Hidden(docs)
    text, doc_id = own.of("text"), own.of("doc_id")
    worded = F.coalesce(text_of(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    key = F.xxhash64(*(x for c in own.df.columns for x in (F.col(c).isNull(), F.col(c))))  # a null alone doesn't change a hash
    keyed = own.df.withColumn("key", key)
    known, _, links = join(keyed.select(F.col("key").alias("doc_id"), text_of(text).alias("t")))
    rows = known.filter("n_shingles > 0").select(F.col("doc_id").alias("key"), _name("s0", "s1").alias("node")).join(keyed.select("key", F.col(doc_id).alias("id")), "key")
    at = rows.join(class_components(links), "node", "left").groupBy(F.coalesce("component", "node"))
    first = at.agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")).select("first.key")
    one = keyed.filter(worded).join(first, "key").dropDuplicates(["key"])  # rows with one hash are the same in all columns
    return own.back(one.select(*own.kept).unionByName(own.df.filter(~worded).select(*own.kept)))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y, c = a.n AND c = b.n AS same FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 70 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT count(*) FROM l WHERE x = doc_id)::BIGINT AS n_similar, (SELECT min(y) FROM r WHERE x = doc_id) AS component_id,
  least(doc_id, (SELECT min(y) FROM l WHERE x = doc_id AND same)) AS class_id FROM documents LEFT JOIN n USING (doc_id)"""
