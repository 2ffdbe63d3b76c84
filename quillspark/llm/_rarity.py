"""How rare words are over a whole corpus: counts in a table of a fixed size.

Each word adds 1 to the counter that the leading bits of its hash name, over all
documents. The classes of the counters, in quarters of an octave, order words from
rare to common; words that share a counter share a class, so the order is coarser
in a very large corpus and stays the same for everyone, which is all that a prefix
filter needs. A task sends its counters once, compressed; the driver and each worker
hold one byte a counter, 4 MB in all, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm import _text as tx
from quillspark.llm._spark import trimmed

BITS, SLICES = 22, 64


class Rarity:
    """Classes 0 to 255 of words by their counters; a larger class is more common."""

    def __init__(self, counts: np.ndarray):
        self.classes = np.minimum(4 * np.log2(np.maximum(counts, 1)), 255).astype(np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        return self.classes[(h >> tx.U(64 - BITS)).astype(np.int64)]


def class_of(count: int) -> int:
    """The class of words with this count."""
    return int(min(4 * np.log2(max(count, 1)), 255))


def rarity(texts: DataFrame) -> Rarity:
    """The classes of the words of a table with one column of texts, in lower case."""
    per = (1 << BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            d, o = tx.text_buffer(b.column(0))
            for _, _, x, y in tx.chunks(d, o):
                x = tx.LOWER[x]
                s, e, _ = tx.words(x, y)
                if total is None:
                    total = np.zeros(1 << BITS, np.int64)
                np.add.at(total, (tx.span_hash(x, s, e) >> tx.U(64 - BITS)).astype(np.int64), 1)
        if total is not None:
            parts = [(k, total[k * per : (k + 1) * per]) for k in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([pa.compress(_planes(p), codec="zstd", asbytes=True) for _, p in parts], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("slice").to_pylist(), b.column("counts"), strict=True):
                got = _whole(pa.decompress(x.as_py(), per * 8, codec="zstd", asbytes=True))
                held[k] = held[k] + got if k in held else got
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([Rarity(x).classes.tobytes() for x in held.values()], pa.binary())], names=["slice", "classes"])

    sent = texts.mapInArrow(trimmed(count), "slice int, counts binary").repartition("slice")
    out = Rarity(np.zeros(0))
    out.classes = np.zeros(1 << BITS, np.uint8)
    for r in sent.mapInArrow(trimmed(add), "slice int, classes binary").collect():
        out.classes[r.slice * per : (r.slice + 1) * per] = np.frombuffer(r.classes, np.uint8)
    return out


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on: small numbers become long runs of zeros."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _whole(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<i8").ravel()
