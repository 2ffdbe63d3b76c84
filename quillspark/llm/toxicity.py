"""Toxicity by an induced lexicon.

Terms are runs of letters in lower case, and the stems (first STEM bytes) of the
longer ones. Labelled documents give each term a signed association with the
label; the strongest become nodes of a word graph, those above 4 standard deviations
and those below 0 its toxic and clean seeds. Edges weigh the positive pointwise mutual information of two nodes
within WINDOW words, counted over all documents. Random walks restart at the toxic
seeds, at the clean ones and at all nodes alike; how much more the toxic walk is at
a node than the larger of the others gives its polarity in -1 to 1, also where the
labels say little of it. Only support, the co-occurrences over all documents, damps
it: by a half at SUPPORT. A text's score is a logistic function of
the polarities of its terms.

Counts, seeds and the logistic function come from all labelled documents; their ids and
labels are broadcast, so that no text is sent. The one bound, a parameter: the lexicon has at
most NODES terms, so the graph has at most NODES^2 / 2 edges, which the driver holds.

Defined results: a null or empty text has no terms and gets the logistic function
at 0; without labels of both kinds all scores are the share of label 1 (0 without
any label). Rows are scored one by one, extra columns pass, long texts are read
whole; rows of labels that are null are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _text as tx
from quillspark.llm._spark import Hidden, cut, load, text_of
from quillspark.llm.quality_fm import held_out

NODES, WINDOW, STEM, RESTART, SUPPORT = 1024, 40, 6, 0.3, 200
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
FEATURES = 4


def terms(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' hashes, starts, ends and owners; stems' hashes (0 where the word is too short) and ends. The bytes must be lowered."""
    s, e = _runs(d, o)
    owner = np.searchsorted(o, s, "right") - 1
    cut = np.minimum(s + STEM, e)
    while len(cut) and (inside := (cut < e) & ((d[np.minimum(cut, len(d) - 1)] & 0xC0) == 0x80)).any():
        cut = cut + inside  # a stem ends with a whole character
    stem = np.where(cut < e, tx.span_hash(d, s, cut) ^ tx.U(0xA5A5A5A5A5A5A5A5), tx.U(0))
    return tx.span_hash(d, s, e), s, e, owner, stem, cut


def _runs(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    from quillspark.llm.secrets import runs

    return runs(d, o, _LETTER, 1)


def lower(d: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of U+00C0 to U+00DE in lower case."""
    out = tx.LOWER[d]
    if len(d):
        capital = np.zeros(len(d), bool)
        capital[1:] = (d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] <= 0x9E) & (d[1:] != 0x97)
        out[capital] += 0x20
    return out


class Lookup:
    """Finds hashes among at most NODES of them: one table by leading bits, then a binary search of what passes."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.table = np.zeros(1 << 16, bool)
        self.table[(hashes >> tx.U(48)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h of known hashes, and their numbers."""
        maybe = np.flatnonzero(self.table[(h >> tx.U(48)).astype(np.int64)])
        if not len(maybe) or not len(self.sorted):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.sorted, h[maybe]), len(self.sorted) - 1)
        hit = self.sorted[at] == h[maybe]
        return maybe[hit], self.order[at[hit]]


def nodes_of(look: Lookup, d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Node occurrences in the order of words: node, word's place, text; and the number of words."""
    word, _, _, owner, stem, _ = terms(lower(d), o)
    wp, wn = look(word)
    sp, sn = look(stem)
    place, node = np.concatenate([wp, sp]), np.concatenate([wn, sn])
    order = np.argsort(place, kind="stable")
    return node[order], place[order], owner[place[order]] if len(place) else place, len(word)


@dataclass
class Lexicon:
    """The graph's terms with their polarities, and the logistic function."""

    names: list[str]
    hashes: np.ndarray
    polarity: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def features(self, look: Lookup, d: np.ndarray, o: np.ndarray) -> np.ndarray:
        """Per text: positive polarity in all, the strongest, distinct terms above a half, mean polarity."""
        node, _, owner, _ = nodes_of(look, d, o)
        n, p = len(o) - 1, self.polarity[node] if len(node) else np.zeros(0)
        strong = np.zeros(n)
        np.maximum.at(strong, owner, p)
        bad = np.unique(owner[p > 0.5] * np.int64(NODES) + node[p > 0.5]) // NODES
        count = np.maximum(np.bincount(owner, minlength=n), 1)
        return np.stack([np.log1p(np.bincount(owner, np.maximum(p - 0.25, 0), n)), strong, np.log1p(np.bincount(bad.astype(np.int64), minlength=n)), np.bincount(owner, p, n) / count], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.weights + self.bias, -30, 30)))


def seeds(sample: DataFrame) -> list[tuple[str, int, float]]:
    """(term, hash, association) of the lexicon's terms, from rows (t, y, __id). Counts of distinct terms by label, added up by batch first."""

    def distinct(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """A chunk in lower case; its terms' hashes, starts, ends, texts, each once a text, and whether they are stems."""
        low = lower(x)
        word, s, e, owner, stem, end = terms(low, bounds)
        h, s, e, owner = np.concatenate([word, stem]), np.concatenate([s, s]), np.concatenate([e, end]), np.concatenate([owner, owner])
        once = np.unique(tx.mix(h + tx.mix(owner.astype(np.uint64))), return_index=True)[1]
        once = once[h[once] != 0]
        return low, h[once], s[once], e[once], owner[once], once >= len(word)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, o = tx.text_buffer(b.column(0))
            y, key = np.asarray(b.column(1)), np.asarray(b.column(2))
            for i, _, x, bounds in tx.chunks(d, o):
                _, h, _, _, owner, _ = distinct(x, bounds)
                u, first, back = np.unique(h, return_index=True, return_inverse=True)
                bad = np.bincount(back, y[i + owner], len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tx.as_long(u)), pa.array(bad), pa.array(np.bincount(back, minlength=len(u)).astype(np.int64)), pa.array(key[i + owner[first]])], names=["h", "bad", "n", "key"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, o = tx.text_buffer(b.column(0))
            for _, _, x, bounds in tx.chunks(d, o):
                low, h, s, e, _, stem = distinct(x, bounds)
                at = np.flatnonzero(np.isin(tx.as_long(h), wanted))
                names = [low[p:q].tobytes().decode("utf-8", "replace") + "-" * int(k) for p, q, k in zip(s[at], e[at], stem[at], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(tx.as_long(h[at])), pa.array(names, pa.string())], names=["h", "name"])

    key = F.xxhash64("__id").alias("key")
    found = sample.select("t", "y", key).mapInArrow(run, "h long, bad long, n long, key long")
    counts = found.groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.min("key").alias("key")).filter("n >= 4")
    total = sample.agg(F.sum("y"), F.count(F.lit(1))).first()
    one, all_ = total[0] or 0, total[1]
    if not one or one == all_:
        return []
    # The signed root of the log likelihood ratio of term and label.
    def part(seen, expected):  # noqa: ANN001, ANN202
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    share, n, bad = one / all_, F.col("n"), F.col("bad")
    ratio = part(bad, n * share) + part(n - bad, n * (1 - share)) + part(one - bad, (all_ - n) * share) + part(all_ - one - (n - bad), (all_ - n) * (1 - share))
    z = counts.select("key", "h", "n", (F.signum(bad - n * share) * F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))).alias("z"))
    z = cut(z)
    best = z.orderBy(F.desc("z"), "h").limit(NODES // 2)
    clean = z.orderBy("z", "h").limit(NODES // 4)
    common = z.filter(F.col("n") <= 0.2 * all_).orderBy(F.desc("n"), "h").limit(NODES // 4)
    rows = {r.h: r for r in best.unionByName(clean).unionByName(common).collect()}
    # Their names, from one document that has each.
    wanted = np.array(sorted(rows), np.int64)
    names = sample.select("t", key).filter(F.col("key").isin(sorted({r.key for r in rows.values()}))).select("t").mapInArrow(name, "h long, name string")
    of = {r.h: r.name for r in names.groupBy("h").agg(F.min("name").alias("name")).collect()}
    return [(of[h], h, rows[h].z) for h in sorted(rows)]


def cooccurrences(docs: DataFrame, hashes: np.ndarray, text: str = "text") -> np.ndarray:
    """Pairs of nodes within WINDOW words of each other, over all documents. A task sends at most NODES^2 / 2 sums."""
    k = len(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, total = Lookup(hashes), np.zeros(k * k, np.int64)
        for b in batches:
            d, o = tx.text_buffer(b.column(0))
            for _, _, x, y in tx.chunks(d, o):
                node, place, owner, _ = nodes_of(look, x, y)
                place = place + owner * np.int64(WINDOW + 1)  # texts are out of each other's reach
                for step in range(1, 2 * WINDOW + 1):
                    gap = place[step:] - place[:-step]
                    near = np.flatnonzero((gap <= WINDOW) & (gap > 0))
                    if not len(near) and not (gap == 0).any():
                        break
                    p, q = node[near], node[near + step]
                    total += np.bincount(np.minimum(p, q) * np.int64(k) + np.maximum(p, q), minlength=k * k)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    rows = docs.select(docs[text].cast("string").alias("t")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[np.asarray(rows["pair"])] = np.asarray(rows["n"])
    out = out.reshape(k, k)
    return out + out.T


def walk(counts: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Polarity of each node by random walks with restart over the PPMI graph."""
    total, degree = max(counts.sum(), 1), counts.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ppmi = np.nan_to_num(np.maximum(np.log(counts * total / np.outer(degree, degree)), 0), nan=0, posinf=0, neginf=0)
    weight = ppmi.sum(1)
    step = ppmi / np.maximum(weight, 1e-12)[:, None]
    toxic, clean = np.flatnonzero(z > 4), np.flatnonzero(z < 0)
    starts = [np.zeros(len(z)), np.zeros(len(z)), np.ones(len(z))]
    starts[0][toxic], starts[1][clean] = np.abs(z[toxic]), np.abs(z[clean])
    reach = []
    for start in starts:
        start = start / max(start.sum(), 1e-300)
        p = start.copy()
        for _ in range(30):
            p = (1 - RESTART) * (p @ step) + RESTART * start
        reach.append(p)
    other = np.maximum(reach[1], reach[2])  # what the clean seeds or any node reach as well isn't toxic
    return (reach[0] - other) / np.maximum(reach[0] + other, 1e-300) * degree / (degree + SUPPORT)


def logistic(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Means, deviations, weights and bias from rows (y, f0, f1, ...), by Newton's method with a little ridge. Each step is one pass, in which a task sends its sums."""
    n = FEATURES + 1

    def sums(of) -> np.ndarray:  # noqa: ANN001
        """of(features, labels), added up over all rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    got = of(np.stack([np.asarray(b.column(f"f{i}")) for i in range(FEATURES)], axis=1), np.asarray(b.column("y")).astype(float))
                    yield pa.RecordBatch.from_arrays([pa.array([got.tobytes()], pa.binary())], names=["s"])

        return np.sum([np.frombuffer(r.s) for r in rows.mapInArrow(run, "s binary").collect()], axis=0)

    first = sums(lambda x, y: np.concatenate([[len(x)], x.sum(0)]))
    mean = first[1:] / first[0]
    scale = np.sqrt(sums(lambda x, y: ((x - mean) ** 2).sum(0)) / first[0]) + 1e-6
    w = np.zeros(n)
    for _ in range(40):

        def part(x: np.ndarray, y: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            x = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            return np.concatenate([(x.T @ (x * (p * (1 - p))[:, None])).ravel(), x.T @ (y - p)])

        got = sums(part)
        step = np.linalg.solve(got[: n * n].reshape(n, n) + 0.1 * np.eye(n), got[n * n :] - 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Lexicon:
    """The lexicon of the labels and the documents, from all rows of both."""
    known, own = Hidden(labels), Hidden(docs)
    docs = own.df.select(F.col(own.of("doc_id")).alias("doc_id"), text_of(own.of("text")).alias("text"))
    some = known.df.select(F.col(known.of("doc_id")).alias("__id"), F.col(known.of(label)).cast("int").alias("y")).filter("y IS NOT NULL")
    sample = docs.select(docs["doc_id"].alias("__id"), docs["text"].cast("string").alias("t")).join(F.broadcast(some), "__id").select("t", "y", "__id")
    found = seeds(sample)
    hashes, z = np.array([h for _, h, _ in found], np.int64).view(np.uint64), np.array([s for _, _, s in found])
    if not found:
        share = sample.agg(F.avg("y")).first()[0] or 0.0
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Lexicon([], hashes, z, np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), float(np.log(p / (1 - p))))
    polarity = walk(cooccurrences(docs, hashes), z)
    lexicon = Lexicon([n for n, _, _ in found], hashes, polarity, np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0)
    lexicon.mean, lexicon.scale, lexicon.weights, lexicon.bias = logistic(cut(_features(sample, lexicon, ["y"])))
    return lexicon


def _features(source: DataFrame, lexicon: Lexicon, kept: list[str]) -> DataFrame:
    schema = source.select(*kept).schema
    for i in range(FEATURES):
        schema = schema.add(f"f{i}", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(lexicon.hashes)
        for b in batches:
            d, o = tx.text_buffer(b.column("t"))
            parts = [lexicon.features(look, x, y) for _, _, x, y in tx.chunks(d, o)]
            f = np.concatenate(parts) if parts else np.zeros((0, FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(f[:, i]) for i in range(FEATURES))], names=[*kept, *(f"f{i}" for i in range(FEATURES))])

    return source.mapInArrow(run, schema)


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (the columns `keep`, or all) with `score` in place of any column so named. One narrow pass."""
    own_ = Hidden(docs, ["score"], keep)
    source, kept = own_.df.select(*own_.kept, text_of(own_.of(text)).alias("t")), own_.kept
    state = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = state.value
        look = Lookup(own.hashes)
        for b in batches:
            d, o = tx.text_buffer(b.column("t"))
            parts = [own.score(own.features(look, x, y)) for _, _, x, y in tx.chunks(d, o)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*kept, "score"])

    return own_.back(source.mapInArrow(run, source.drop("t").schema.add("score", "double")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from four of five folds, scores all documents."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    lexicon = learn(docs, labels.filter(~held_out(F.col("doc_id"), 5, 0)))
    out = score(docs, lexicon, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
