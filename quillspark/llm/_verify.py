"""Verifies candidate pairs of groups of sets by the sets' overlaps.

A pair goes to the cell named after the smallest group that either of its two
touches, so the pairs of a cluster meet in one place and a set is sent about once.
A cell with more than ELEMENTS elements is cut into blocks, of which those meet
that have a pair across; so no task holds a large cluster, and only candidate pairs
count, each of them in one place. Inside a cell, tiles of TILE by TILE sets that hold
many pairs are overlapped as a product, at a hundredth of a lookup's time for a pair;
a cluster that grows with the corpus has pairs as its square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import trimmed

ELEMENTS, TILE = 1 << 19, 1024


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """The sizes of the intersections of the first `left` sets with the others (with themselves, if there are no others), as a product of 0-1 tables over the elements that two or more hold."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    _, back, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = times[back] > 1
    owner, back = owner[some], (np.cumsum(times > 1) - 1)[back[some]]
    order = np.argsort(back, kind="stable")
    owner, back = owner[order], back[order]
    right = left if left < m else 0
    width, out, step = int(back[-1]) + 1 if len(back) else 0, np.zeros((left, m - right), np.int32), max(256, (1 << 22) // m)
    for k in range(0, width, step):
        p, q = np.searchsorted(back, [k, k + step])
        table = np.zeros((m, min(step, width - k)), np.float32)
        table[owner[p:q], back[p:q] - k] = 1
        out += (table[:left] @ table[right:].T).astype(np.int32)
    return out


def shared(flat: np.ndarray, offs: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many elements the sets p and q of each pair share; set k is flat[offs[k]:offs[k + 1]], in ascending order. Each element of the smaller set is looked up in the larger."""
    size = np.diff(offs)
    p, q = np.where(size[p] <= size[q], p, q), np.where(size[p] <= size[q], q, p)
    known, rank = np.unique(flat, return_inverse=True)
    both = np.repeat(np.arange(len(size)), size) * np.int64(max(len(known), 1)) + rank
    out, done = np.zeros(len(p), np.int64), np.cumsum(size[p])
    at = 0
    while at < len(p):
        end = max(int(np.searchsorted(done, done[at] - size[p[at]] + ELEMENTS, "right")), at + 1)
        n = size[p[at:end]]
        owner = np.repeat(np.arange(end - at), n)
        mine = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + offs[p[at:end]][owner]
        want = q[at:end][owner] * np.int64(max(len(known), 1)) + rank[mine]
        hit = both[np.minimum(np.searchsorted(both, want), len(both) - 1)] == want
        out[at:end] = np.bincount(owner[hit], minlength=end - at)
        at = end
    return out


def counted(flat: np.ndarray, offs: np.ndarray, in_cell: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many elements the sets p and q of each pair share, p < q. in_cell: each set's cell, in ascending order; both sets of a pair are of one."""
    first = np.searchsorted(in_cell, in_cell)  # the first set of each one's cell
    tiles = -(-max(int((np.arange(len(in_cell)) - first).max(initial=0)) + 1, 1) // TILE)
    tile = (first[p] * np.int64(tiles) + (p - first[p]) // TILE) * tiles + (q - first[q]) // TILE
    order = np.argsort(tile, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(tile[order]) != 0])) if len(p) else order
    out, thin = np.zeros(len(p), np.int64), np.ones(len(p), bool)
    for own in np.split(order, edges[1:]) if len(p) else []:
        (x, px), (y, qy) = (np.unique(k[own], return_inverse=True) for k in (p, q))
        if len(own) > 2 * (len(x) + len(y)):
            both = [flat[offs[k] : offs[k + 1]] for k in (*x, *y)]
            out[own], thin[own] = overlaps(both, len(x))[px, qy], False
    out[thin] = shared(flat, offs, p[thin], q[thin])
    return out


def cells(pairs: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs by cell, members by cell): cell, i, j, a, b and cell, i, j, gid, s0, s1, block (i or j).

    pairs (a, b): groups that may have similar members; a group with itself for pairs inside it. members (gid, s0, s1, n): the sets of each group.
    """
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    label = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
    at = pairs.join(label.select(F.col("x").alias("a"), F.col("m").alias("ma")), "a").join(label.select(F.col("x").alias("b"), F.col("m").alias("mb")), "b").select("a", "b", F.least("ma", "mb").alias("cell"))
    inside = at.select("cell", F.col("a").alias("gid")).unionByName(at.select("cell", F.col("b").alias("gid"))).distinct()
    held = inside.join(members, "gid")
    sizes = held.groupBy("cell").agg(F.ceil(F.sum("n") / F.lit(ELEMENTS)).cast("int").alias("nb"))
    placed = held.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("s0", "s1"), F.greatest("nb", F.lit(1))).cast("int")).select("cell", "gid", "s0", "s1", "block")
    where = placed.select("cell", "gid", "block").distinct()
    met = at.join(where.select("cell", F.col("gid").alias("a"), F.col("block").alias("p")), ["cell", "a"]).join(where.select("cell", F.col("gid").alias("b"), F.col("block").alias("q")), ["cell", "b"])
    met = met.select("cell", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "a", "b").distinct()
    need = met.select("cell", "i", "j", F.col("a").alias("gid")).unionByName(met.select("cell", "i", "j", F.col("b").alias("gid"))).distinct()
    return met, need.join(placed, ["cell", "gid"]).filter("block = i OR block = j").select("cell", "i", "j", "gid", "s0", "s1", "block")


def roots(m: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest of the places 0 to m - 1 that each is connected with by the pairs."""
    out = np.arange(m)
    while True:
        before = out.copy()
        np.minimum.at(out, p, out[q])
        np.minimum.at(out, q, out[p])
        out = out[out]
        if (out == before).all():
            return out


def verify(pairs: DataFrame, rows: DataFrame, good: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], summed: bool = False) -> DataFrame:
    """(a0, a1, b0, b1): pairs of different sets, each once, with good(overlap, n, m). pairs: as from cells(); rows: members by cell with `keys`, their whole sets.

    summed: instead of pairs, rows (a0, a1, b0, b1, others) for each set and block with such pairs: the sizes of the sets
    that it pairs with there, summed (rows has `size`), and one set that pairs connect it with there, so that all
    rows connect the same sets as all pairs. They grow with the sets, not with the pairs.
    """
    none = F.lit(None)
    long = "long"
    weight = F.col("size").cast(long) if summed else F.lit(1).cast(long)
    left = pairs.select("cell", "i", "j", F.lit(1).alias("kind"), F.col("a").alias("gid"), F.col("b").alias("other"), none.cast(long).alias("s0"), none.cast(long).alias("s1"), none.cast("int").alias("block"), none.cast(long).alias("size"), none.cast("array<long>").alias("keys"))
    right = rows.select("cell", "i", "j", F.lit(0).alias("kind"), "gid", none.cast(long).alias("other"), "s0", "s1", "block", weight.alias("size"), "keys")

    def settle(block: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(block).combine_chunks()
        cell, i, j, kind, gid, other, s0, s1, part, size = (np.asarray(pc.fill_null(t.column(c), 0)) for c in ("cell", "i", "j", "kind", "gid", "other", "s0", "s1", "block", "size"))
        number = np.cumsum(np.append(False, (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        asks = kind == 1
        names = np.unique(np.concatenate([gid, other[asks]]))
        name = lambda k, x: k * np.int64(len(names)) + np.searchsorted(names, x)
        own = name(number[~asks], gid[~asks])
        order = np.argsort(own, kind="stable")
        own, in_cell = own[order], number[~asks][order]
        lists = t.column("keys").combine_chunks().filter(pa.array(~asks)).take(pa.array(order))
        flat, offs = np.asarray(lists.values), np.asarray(lists.offsets).astype(np.int64)
        flat, offs = flat[offs[0] : offs[-1]], offs - offs[0]
        s0, s1, part, size, across = (x[~asks][order] for x in (s0, s1, part, size, i != j))
        at = number[asks]
        a, b = name(at, gid[asks]), name(at, other[asks])
        lo, hi = (np.stack([np.searchsorted(own, x, side) for x in (a, b)]) for side in ("left", "right"))
        na, nb = hi - lo
        times = na * nb  # every member of a with every one of b
        k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        wide = np.repeat(np.maximum(nb, 1), times)
        p, q = np.repeat(lo[0], times) + k // wide, np.repeat(lo[1], times) + k % wide
        p, q = np.minimum(p, q), np.maximum(p, q)
        some = (p < q) & ((part[p] != part[q]) | ~across[p])  # two blocks meet for the pairs across
        once = np.unique(p[some] * np.int64(max(len(own), 1)) + q[some])
        p, q = once // max(len(own), 1), once % max(len(own), 1)
        n, both = np.diff(offs), counted(flat, offs, in_cell, p, q)
        ok = good(both, n[p], n[q])
        p, q = p[ok], q[ok]
        if summed:
            others = np.zeros(len(own), np.int64)
            np.add.at(others, p, size[q])
            np.add.at(others, q, size[p])
            a, b = np.flatnonzero(others), roots(len(own), p, q)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (s0[a], s1[a], s0[b[a]], s1[b[a]], others[a])], names=["a0", "a1", "b0", "b1", "others"])
        swap = (s0[p] > s0[q]) | ((s0[p] == s0[q]) & (s1[p] > s1[q]))
        p, q = np.where(swap, q, p), np.where(swap, p, q)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (s0[p], s1[p], s0[q], s1[q])], names=["a0", "a1", "b0", "b1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for t in batches:
            if not t.num_rows:
                continue
            if size > ELEMENTS:  # what came before ends where this batch's first cell that is another one begins
                cell, i, j = (np.asarray(t.column(c)) for c in ("cell", "i", "j"))
                last = tuple(held[-1].column(c)[-1].as_py() for c in ("cell", "i", "j"))
                new = (cell != last[0]) | (i != last[1]) | (j != last[2])
                if new.any():
                    k = int(np.argmax(new))
                    yield settle([*held, t.slice(0, k)])
                    held, size, t = [], 0, t.slice(k)
            held.append(t)
            size += pc.sum(pc.list_value_length(t.column("keys"))).as_py() or 0
        if held:
            yield settle(held)

    spread = left.unionByName(right).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "kind")
    if summed:
        return spread.mapInArrow(trimmed(run), "a0 long, a1 long, b0 long, b1 long, others long")
    return spread.mapInArrow(trimmed(run), "a0 long, a1 long, b0 long, b1 long").distinct()
