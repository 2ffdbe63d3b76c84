"""Quality classifier: a factorisation machine.

Features of a text: each word occurrence, hashed to one of 2^BITS buckets, with
the value 1 / words; statistics of its structure; its length. The model adds to
a linear term all pairs of features weighed by inner products of low-rank
vectors, in linear time by 1/2 ((sum v x)^2 - sum v^2 x^2).

It is fitted on the driver to at most ROWS labelled documents (whole texts),
those with the smallest hashes of their doc_id among the rows allowed for
learning; that is the documented bound. Scoring is one narrow pass.

Defined results: a null text is an empty one and gets the score of its
statistics; without labels of both kinds every score is the share of label 1
(0.5 without any). Repeated label rows of a document count as they come, those
with a null label are left out. Rows are scored one by one, extra columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _text as tx
from quillspark.llm import quality_rules
from quillspark.llm._spark import Hidden, load, text_of

BITS, RANK, ROWS, EPOCHS, STEPS, BATCH, RATE = 13, 4, 3000, 12, 400, 128, 0.02
_DIGIT, _PUNCT = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
STATS = 11


def structure(d: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Statistics of each text's structure and its length, one row a text."""
    n, chars, symbols, dup, repeat, lines, upper, letters = (x.astype(float) for x in quality_rules.measure(d, o))
    w, a, k = np.maximum(n, 1), np.maximum(letters, 1), np.maximum(lines, 1)
    return np.stack([np.log1p(n), np.log1p(chars), chars / w / 5, np.minimum(symbols / w, 3), dup / k, repeat / w, upper / a, np.log1p(lines), np.minimum(w / k / 50, 5),
                     np.minimum(tx.sums(_DIGIT[d], o) / w, 3), np.minimum(tx.sums(_PUNCT[d], o) / w, 3)], axis=1)


def buckets(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word, in lower case, and each text's first word (n + 1 bounds)."""
    low = tx.LOWER[d]
    s, e, lo = tx.words(low, o)
    return (tx.span_hash(low, s, e) >> tx.U(64 - BITS)).astype(np.int32), lo


@dataclass
class Machine:
    """The fitted model. linear and vectors: of the buckets, then of the statistics."""

    bias: float
    linear: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, d: np.ndarray, o: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each text."""
        x = np.clip((structure(d, o) - self.mean) / self.scale, -4, 4)
        b, lo = buckets(d, o)
        n, size = np.maximum(np.diff(lo), 1)[:, None].astype(float), 1 << BITS
        table = np.concatenate([self.linear[:size, None], self.vectors[:size], (self.vectors[:size] ** 2)], axis=1).astype(np.float32)
        total = np.zeros((len(o) - 1, table.shape[1]))
        full = np.flatnonzero(np.diff(lo))
        if len(full):
            total[full] = np.add.reduceat(table[b], lo[full], axis=0, dtype=np.float64)
        ws, vs = self.linear[size:], self.vectors[size:]
        inner = total[:, 1 : 1 + RANK] / n + x @ vs
        square = total[:, 1 + RANK :] / n**2 + (x**2) @ (vs**2)
        z = self.bias + total[:, 0] / n[:, 0] + x @ ws + 0.5 * (inner**2 - square).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Fits by Adam on batches of BATCH rows, in STEPS steps at least. rows: buckets of the words, statistics, label."""
    size, rng = 1 << BITS, np.random.default_rng(seed)
    y = np.array([r[2] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Machine(float(np.log(p / (1 - p))), np.zeros(size + STATS), np.zeros((size + STATS, RANK)), np.zeros(STATS), np.ones(STATS))
    stats = np.stack([r[1] for r in rows])
    mean, scale = stats.mean(0), stats.std(0) + 1e-6
    x = np.clip((stats - mean) / scale, -4, 4).astype(np.float32)
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    key, times = np.unique(owner * size + np.concatenate([r[0] for r in rows]).astype(np.int64), return_counts=True)
    first = np.searchsorted(key, np.arange(len(rows) + 1) * size)
    col = (key % size).astype(np.int32)
    n = np.maximum(np.array([len(r[0]) for r in rows], float), 1)[key // size]
    v1, v2 = (times / n).astype(np.float32), (times / n**2).astype(np.float32)  # each occurrence is a feature with the value 1 / words
    theta = np.concatenate([np.zeros((size + STATS, 1)), rng.normal(0, 0.05, (size + STATS, RANK))], axis=1).astype(np.float32)
    bias, m, v, mb, vb = float(np.log(y.mean() / (1 - y.mean()))), np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
    batches, t = -(-len(y) // BATCH), 0
    epochs = max(epochs, -(-STEPS // batches))
    steps = epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            own = order[at : at + BATCH]
            count = first[own + 1] - first[own]
            r = np.repeat(np.arange(len(own)), count)
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[own], count)
            c, w1, w2, xs = col[k], v1[k], v2[k], x[own]
            vec, vs = theta[c, 1:], theta[size:, 1:]
            add = lambda z, r=r, rows_=len(own): np.bincount(r, z, rows_)
            inner = np.stack([add(vec[:, j] * w1) for j in range(RANK)], axis=1) + xs @ vs
            square = add((vec**2).sum(1) * w2) + (xs**2) @ (vs**2).sum(1)
            z = bias + add(theta[c, 0] * w1) + xs @ theta[size:, 0] + 0.5 * ((inner**2).sum(1) - square)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)
            grad = 1e-5 * theta
            gw = g[r] * w1
            grad[:size, 0] += np.bincount(c, gw, size)
            for j in range(RANK):
                grad[:size, 1 + j] += np.bincount(c, gw * inner[r, j] - g[r] * w2 * vec[:, j], size)
            grad[size:, 0] += xs.T @ g
            grad[size:, 1:] += xs.T @ (g[:, None] * inner) - ((xs**2).T @ g)[:, None] * vs
            t += 1
            rate = RATE * min(1, 2 * (1 - t / (steps + 1)))
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
            theta -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return Machine(float(bias), theta[:, 0].astype(float), theta[:, 1:].astype(float), mean, scale)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the crc32 of the doc_id's digits leaves that remainder (a null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)) == fold


def learn(docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS) -> Machine:
    """Fits to the labelled documents with the smallest hashes, at most `rows`."""
    known, own = Hidden(labels), Hidden(docs)
    some = known.df.select(F.col(known.of("doc_id")).alias("__id"), F.col(known.of(label)).cast("int").alias("__y")).filter("__y IS NOT NULL")
    some = some.orderBy(F.xxhash64("__id"), "__id", "__y").limit(rows)
    found = own.df.select(F.col(own.of("doc_id")).alias("__id"), text_of(own.of("text")).alias("__t")).join(F.broadcast(some), "__id").select("__t", "__y", "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, o = tx.text_buffer(b.column(0))
            out = []
            for _, _, x, y in tx.chunks(d, o):
                s, (h, lo) = structure(x, y), buckets(x, y)
                out += [(h[lo[i] : lo[i + 1]].astype(np.int16).tobytes(), s[i].tobytes()) for i in range(len(y) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), b.column(1), b.column(2)], names=["w", "s", "y", "id"])

    got = found.mapInArrow(run, "w binary, s binary, y int, id long").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    return fit([(np.frombuffer(w.as_py(), np.int16), np.frombuffer(s.as_py()), y.as_py()) for w, s, y in zip(got["w"], got["s"], got["y"], strict=True)])


def score(docs: DataFrame, model: Machine, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (the columns `keep`, or all) with `score` in place of any column so named."""
    own = Hidden(docs, ["score"], keep)
    source, kept = own.df.select(*own.kept, text_of(own.of(text)).alias("t")), own.kept
    state = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS * (RANK + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, o = tx.text_buffer(b.column("t"))
            parts = [state.value.score(x, y) for _, _, x, y in tx.chunks(d, o)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*kept, "score"])

    return own.back(source.mapInArrow(run, source.drop("t").schema.add("score", "double")))


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from three of four folds, scores all documents."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = learn(docs, labels.filter(~held_out(F.col("doc_id"), 4, 2)), "quality")
    out = score(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
