"""Secret scans with inferred grammars.

Three rules give the base spans of a text. Their matches are the labelled credentials:
for each kind a prefix tree of a bounded sample of its strings is folded into a
probabilistic automaton. Two states are merged when the frequencies of ending, of each
next character and of each number of characters left, in them and in the states behind
them, agree within Hoeffding's bound. So a fixed prefix stays literal, and a format of a
fixed length becomes a chain of states that counts it. Characters that a state hasn't
seen get a little of the mass of their class. One more automaton is inferred from
ordinary tokens: a sample of occurrences, so what repeats in prose weighs as it does
there, less those that are as likely as credentials.

Every token outside the base spans, from MIN_LENGTH characters or the shortest labelled
credential on, whichever is less, is scored by its log likelihood a character. It becomes
a span of kind `format` when some credential automaton makes it likelier than the
ordinary one does and no more than SLACK less likely than the LOW quantile of labelled
credentials, which is measured on strings that the automaton wasn't fitted to. A kind
without labelled credentials has no automaton: nothing tells its format.

The bound of the fit: at most SAMPLE distinct strings of a kind, of up to LONGEST
characters, and SAMPLE occurrences of ordinary tokens, those with the smallest hashes
over the whole table. All texts are scanned, and base spans have no bound.

Defined results: a null or empty text has no spans; repeated rows and extra columns
change nothing, whatever their names; without any labelled credential there are only
base spans; long texts are scanned whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _text as tx
from quillspark.llm._spark import Hidden, cut, load, text_of

KINDS = ["assign", "access", "hex", "format"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
SAMPLE, LONGEST, MIN_LENGTH, ALPHA, LOW, SLACK = 1500, 512, 16, 0.05, 0.05, 0.5
_HEX, _TOKEN = np.zeros(256, bool), np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
_CLASSES = ["abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_.=-"]
_CLASS = {c: k for k, cs in enumerate(_CLASSES) for c in cs}


def runs(d: np.ndarray, o: np.ndarray, kind: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs, inside a text, of at least `least` bytes of a kind."""
    if not len(d):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = kind[d]
    before, after = np.zeros(len(d), bool), np.zeros(len(d), bool)
    before[1:], after[:-1] = w[:-1], w[1:]
    full = o[1:] > o[:-1]
    before[o[:-1][full]] = False
    after[o[1:][full] - 1] = False
    s, e = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    long = e - s >= least
    return s[long], e[long]


def base_spans(text: str, hexes: list[tuple[int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, the credential) of the base rules; hexes: the hex runs, in code points."""
    out, low = [], text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(s, 2, e, text[s:e]) for s, e in hexes]
    return sorted(out)


def scan(d: np.ndarray, o: np.ndarray, least: int = MIN_LENGTH) -> Iterator[tuple[list[tuple[int, int, int, str]], list[tuple[int, int, str]]]]:
    """For each text its base spans and the other tokens of `least` or more characters that overlap none."""
    hs, he = runs(d, o, _HEX, 24)
    ts, te = runs(d, o, _TOKEN, least)
    hlo, tlo = np.searchsorted(hs, o), np.searchsorted(ts, o)
    c = np.zeros(len(d) + 1, np.int64)
    np.cumsum((d & 0xC0) != 0x80, out=c[1:])
    chs, che, cts, cte = c[hs], c[he], c[ts], c[te]
    for i in range(len(o) - 1):
        text, at = d[o[i] : o[i + 1]].tobytes().decode("utf-8", "replace"), c[o[i]]
        found = base_spans(text, [(int(chs[k] - at), int(che[k] - at)) for k in range(hlo[i], hlo[i + 1])])
        rest = [(int(cts[k] - at), int(cte[k] - at)) for k in range(tlo[i], tlo[i + 1])]
        if found:
            ends = list(accumulate((y for _, _, y, _ in found), max))  # bases are in the order of their starts
            firsts = [x for x, _, _, _ in found]
            rest = [(s, e) for s, e in rest if not (k := bisect_left(firsts, e)) or ends[k - 1] <= s]
        yield found, [(s, e, text[s:e]) for s, e in rest]


class Automaton:
    """A probabilistic automaton inferred from strings."""

    def __init__(self, strings: list[str]):
        self.count, self.final, self.arcs, self.weight, self.left = [0], [0], [{}], [{}], [Counter()]
        for x in strings:
            at = 0
            self.count[0] += 1
            self.left[0][len(x)] += 1
            for i, c in enumerate(x):
                if c not in self.arcs[at]:
                    self.arcs[at][c] = len(self.count)
                    self.weight[at][c] = 0
                    self.count.append(0), self.final.append(0), self.arcs.append({}), self.weight.append({}), self.left.append(Counter())
                self.weight[at][c] += 1
                at = self.arcs[at][c]
                self.count[at] += 1
                self.left[at][len(x) - i - 1] += 1
            self.final[at] += 1
        self._merge()
        self.states = sorted(self._reachable())
        self.steps = {n: self._state(n) for n in self.states}
        del self.count, self.final, self.arcs, self.weight, self.left

    def _state(self, n: int) -> tuple[dict[str, tuple[float, int]], list[tuple[float, int]], float]:
        """Of a state: logarithm of the probability, and next state, of each character that it has seen; the same for others of each class; the logarithm of ending."""
        arcs, weight, total = self.arcs[n], self.weight[n], self.count[n]
        usual = max(weight, key=lambda c: (weight[c], c), default=None)
        others = []
        for k, letters in enumerate(_CLASSES):
            own = {c: w for c, w in weight.items() if _CLASS.get(c) == k}
            share = (sum(own.values()) + 0.05) / (total + 0.6) / len(letters)
            to = max(own, key=lambda c: (own[c], c)) if own else usual
            others.append((2 * share / (total + 2), n if to is None else arcs[to]))
        seen = {c: (math.log(w / (total + 2) + others[_CLASS.get(c, 5)][0]), arcs[c]) for c, w in weight.items()}
        end = (self.final[n] + 2 * (self.final[n] + 0.05) / (total + 0.6)) / (total + 2)
        return seen, [(math.log(p), m) for p, m in others], math.log(end)

    def _reachable(self) -> set[int]:
        seen, todo = {0}, [0]
        while todo:
            for m in self.arcs[todo.pop()].values():
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    def _agree(self, a: int, b: int) -> bool:
        """Whether two states, and those after them, agree within Hoeffding's bound."""
        todo, root = [(a, b)], math.sqrt(0.5 * math.log(2 / ALPHA))
        while todo:
            a, b = todo.pop()
            n, m = self.count[a], self.count[b]
            if not n or not m:
                continue
            bound = root * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound >= 1:
                continue  # too few strings to tell; so it is below them
            gap = x = y = 0
            for k in sorted(self.left[a].keys() | self.left[b].keys()):
                x, y = x + self.left[a][k], y + self.left[b][k]
                gap = max(gap, abs(x / n - y / m))
            if gap > bound:
                return False
            for c in self.arcs[a].keys() | self.arcs[b].keys():
                if abs(self.weight[a].get(c, 0) / n - self.weight[b].get(c, 0) / m) > bound:
                    return False
                if c in self.arcs[a] and c in self.arcs[b]:
                    todo.append((self.arcs[a][c], self.arcs[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree under b to the states from a on."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.final[a] += self.final[b]
            self.left[a].update(self.left[b])
            for c, m in self.arcs[b].items():
                self.weight[a][c] = self.weight[a].get(c, 0) + self.weight[b][c]
                if c in self.arcs[a]:
                    todo.append((self.arcs[a][c], m))
                else:
                    self.arcs[a][c] = m

    def _merge(self) -> None:
        red, sure = [0], {0}
        while True:
            blue = [(-self.count[m], r, c, m) for r in red for c, m in self.arcs[r].items() if m not in sure]
            if not blue:
                return
            _, parent, symbol, b = min(blue)
            for r in reversed(red):  # what was told apart last is nearest in length
                if self._agree(r, b):
                    self.arcs[parent][symbol] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
                sure.add(b)

    def score(self, x: str) -> float:
        """Log likelihood of the string, a character."""
        at, total, steps = 0, 0.0, self.steps
        for c in x:
            seen, others, _ = steps[at]
            p, at = seen.get(c) or others[_CLASS.get(c, 5)]
            total += p
        return (total + steps[at][2]) / max(len(x), 1)


def low_quantile(x: list[float]) -> float:
    """The LOW quantile."""
    return sorted(x)[int(LOW * (len(x) - 1))]


def usual_score(strings: list[str]) -> float:
    """The LOW quantile of strings' scores under the automaton of the other half of them (of all, where there are few)."""
    if len(strings) < 20:
        a = Automaton(strings)
        return low_quantile([a.score(x) for x in strings])
    halves = strings[::2], strings[1::2]
    return low_quantile([a.score(x) for a, own in zip(map(Automaton, halves), reversed(halves), strict=True) for x in own])


class Grammar:
    """The credential automata with their least scores, and the ordinary one."""

    def __init__(self, samples: dict[str, list[str]], length: int = MIN_LENGTH):
        self.length = length
        labelled = [[x for x in samples.get(k, []) if len(x) <= LONGEST] for k in KINDS[:3]]
        self.automata = [(Automaton(own), usual_score(own) - SLACK) for own in labelled if own]
        ordinary = [x for x in samples.get("other", []) if len(x) <= LONGEST and not any(a.score(x) >= least + SLACK / 2 for a, least in self.automata)]
        self.ordinary = Automaton(ordinary)
        self.kept: dict[str, bool] = {}

    def secret(self, token: str) -> bool:
        """Whether the token is taken for a credential."""
        got = self.kept.get(token)
        if got is None:
            if len(self.kept) >= 200_000:
                self.kept.clear()
            best = max((s for a, least in self.automata if (s := a.score(token)) >= least), default=None)
            got = self.kept[token] = best is not None and best > self.ordinary.score(token)
        return got


def _smallest(texts: DataFrame, sample: int, least: int | None) -> DataFrame:
    """(kind, token, h, shortest): each task's `sample` smallest hashes of a kind at most. Without least, of the labelled kinds, with the shortest token of each; with it, of the occurrences of other tokens of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict[int, str]] = {}
        shortest: dict[str, int] = {}

        def add(kind: str, token: str, h: int) -> None:
            own = best.setdefault(kind, {})
            own[h >> 1] = token
            shortest[kind] = min(shortest.get(kind, len(token)), len(token))
            if len(own) > 8 * sample:
                best[kind] = dict(sorted(own.items())[:sample])

        for b in batches:
            d, o = tx.text_buffer(b.column(0))
            for _, _, x, y in tx.chunks(d, o):
                for k, (found, rest) in enumerate(scan(x, y, least or MIN_LENGTH)):
                    if least is None:
                        for _, kind, _, token in found:
                            add(KINDS[kind], token, xxhash.xxh3_64_intdigest(token))
                    elif rest:
                        own = xxhash.xxh3_64_intdigest(x[y[k] : y[k + 1]].tobytes())  # copies of a text count once
                        for s, _, token in rest:
                            add("other", token, xxhash.xxh3_64_intdigest(f"{own}:{s}"))
        rows = [(k, t, h, shortest[k]) for k, own in best.items() for h, t in sorted(own.items())[:sample]]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["kind", "token", "h", "shortest"])

    found = texts.mapInArrow(run, "kind string, token string, h long, shortest long")
    return cut(found.groupBy("kind", "token", "h").agg(F.min("shortest").alias("shortest")))


def learn(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Grammar:
    """The grammar of the table's own credentials."""
    samples: dict[str, list[str]] = {}

    def take(found: DataFrame, kind: str) -> None:
        got = found.filter(F.col("kind") == kind).orderBy("h", "token").limit(sample).collect()
        if got:
            samples[kind] = [r.token for r in got]

    own = Hidden(docs)
    texts = own.df.select(text_of(own.of(text)).alias("t"))
    labelled = _smallest(texts, sample, None)
    for k in KINDS[:3]:
        take(labelled, k)
    length = min(MIN_LENGTH, labelled.agg(F.min("shortest")).first()[0] or MIN_LENGTH)
    take(_smallest(texts, sample, length), "other")
    return Grammar(samples, length)


def find(docs: DataFrame, grammar: Grammar, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (the columns `keep`, or all) with n_assign, n_access, n_hex, n_format, base_sha256 and spans in place of any columns so named. One narrow pass."""
    names = ["n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"]
    own = Hidden(docs, names, keep)
    source, kept = own.df.select(*own.kept, text_of(own.of(text)).alias("t")), own.kept
    schema = source.drop("t").schema
    for n in names:
        schema = schema.add(n, "long" if n[0] == "n" else "string")
    state = docs.sparkSession.sparkContext.broadcast(grammar)  # bounded by the samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = state.value
        for b in batches:
            d, o = tx.text_buffer(b.column("t"))
            rows = []
            for _, _, x, y in tx.chunks(d, o):
                for found, rest in scan(x, y, g.length):
                    base = [(s, k, e) for s, k, e, _ in found]
                    more = [(s, 3, e) for s, e, token in rest if g.automata and g.secret(token)]
                    write = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
                    rows.append((*(sum(k == i for _, k, _ in base) for i in range(3)), len(more), hashlib.sha256(write(base).encode()).hexdigest(), write(base + more)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(c, pa.int64() if n[0] == "n" else pa.string()) for n, c in zip(names, cols, strict=True))], names=[*kept, *names])

    return own.back(source.mapInArrow(run, schema))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns the formats of the documents' credentials, then scans every document."""
    docs = load(spark, sf_dir, "documents")
    return find(docs, learn(docs), keep=["doc_id"])
