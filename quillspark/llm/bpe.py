"""BPE encoding and decoding with a public vocabulary file.

A word's symbols form a doubly linked list; a priority queue holds its mergeable
pairs by rank and place. The lowest pair is merged, its neighbours' new pairs are
pushed, and entries whose symbols have changed since are skipped when popped.
Decoding joins the vocabulary's strings with one space, as the tokenizers
library does for a file without a decoder.

Digests are one narrow pass over chunks of about CHUNK characters. A chunk's words are
cut by classes of characters and told apart exactly; the different ones of up to LONG
bytes are merged together, in rounds that merge each word's lowest pair, and longer
ones by the queue. A text's ids and strings are those of its words, by their numbers.
Texts with a special token's string, and those of over 8 CHUNKs, go by themselves, word
by word.

Defined results: a null text is an empty one, with 0 tokens and an empty decoded
text. Special tokens' strings in a text become those tokens. Rows are
independent, so repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._spark import Hidden, load, text_of, trimmed
from quillspark.llm._unicode import LOWER, Classes

CHUNK, LONG = 1 << 21, 64
#: Kinds of characters, a factor that spreads keys, and what stands for no pair and no rank.
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_SPREAD, _NONE, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(2**64 - 1), 2**31 - 1
_LOWER = LOWER | {0x3A3: 0x3C3}  # a capital sigma isn't final for the library


def default_file() -> str:
    """The path of the public word BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """A printable letter for each byte: itself where it is printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


class Codec:
    """Encodes as the file says: NFC, white space to one space, lower case, a pattern's matches as words, byte letters, merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern, classes = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"), Classes()
        self.pattern, self.odd, self.exact = regex.compile(pattern), classes.odd, regex.compile(classes.exact(pattern))
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.letters = _byte_letters()
        self._tables(classes)

    def _tables(self, classes: Classes) -> None:
        """What words() and word() go by, as arrays."""
        self.kinds = np.full(0x110000, _OTHER, np.uint8)
        self.kinds[_codes("".join(regex.findall(r"\p{White_Space}", "".join(map(chr, range(0x10000))))))] = _SPACE
        for kind, name in ((_LETTER, "L"), (_NUMBER, "N")):
            self.kinds[list(classes.members[name])] = kind
        letters = [[self.vocab.get(c + end, -1) for c in self.letters] for end in ("", self.suffix)]
        self.bytes = np.array(letters, np.int32)
        keys = np.array([(a << 32) | b for a, b in self.merges], np.uint64)
        ranks, new = (np.array(x, np.int32) for x in zip(*self.merges.values(), strict=True))
        bits = max(int(len(keys) * 8 - 1).bit_length(), 4)
        self.shift, self.slots = np.uint64(64 - bits), np.full(1 << bits, -1, np.int32)  # open addressing, at most an eighth full
        at, left, self.steps = ((keys * _SPREAD) >> self.shift).astype(np.int64), np.arange(len(keys)), 0
        while len(left):
            self.steps += 1
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = free
            left = left[self.slots[at[left]] != left]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
        self.pairs, self.ranks, self.new = np.append(keys, _NONE), np.append(ranks, np.int32(_LAST)), np.append(new, np.int32(0))
        top = max(self.strings) + 1
        self.numbers = pa.array([f"{i} " for i in range(top)], pa.large_binary())
        self.names = pa.array([(self.strings[i] + " ").encode() if i in self.strings else b"" for i in range(top)], pa.large_binary())

    def _merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place in ranks and new of the merge of each pair of symbols; the last one where there is none."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = ((key * _SPREAD) >> self.shift).astype(np.int64)
        out = self.slots[at]
        wrong = np.flatnonzero((out >= 0) & (self.pairs[out] != key))
        for k in range(1, self.steps + 1):
            if not len(wrong):
                return out
            out[wrong] = self.slots[(at[wrong] + k) & (len(self.slots) - 1)]
            wrong = wrong[(out[wrong] >= 0) & (self.pairs[out[wrong]] != key[wrong])]
        out[wrong] = -1
        return out

    def together(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words data[offs[k]:offs[k + 1]], of at least one byte, and n + 1 bounds among them: as word() gives them, for all at once."""
        size = np.diff(offs)
        ids, count = [], np.zeros(len(size), np.int64)
        owners = []
        for k in np.flatnonzero(size > LONG).tolist():
            own = self.word(data[offs[k] : offs[k + 1]].tobytes().decode())
            ids.append(np.array(own, np.int64))
            owners.append(np.full(len(own), k))
        width = 1
        while width <= LONG:  # words of about one length share a table
            some = np.flatnonzero((size <= width) & (size > (width // 2)))
            for part in np.array_split(some, -(-len(some) * width // (1 << 20)) or 1):
                if len(part):
                    got, n = self._rounds(data, offs[part], size[part], width)
                    ids.append(got)
                    owners.append(np.repeat(part, n))
            width *= 2
        if not ids:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        owner = np.concatenate(owners)
        count = np.bincount(owner, minlength=len(size))
        return np.concatenate(ids)[np.argsort(owner, kind="stable")], np.concatenate([[0], np.cumsum(count)])

    def _rounds(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of at most `width` bytes, one after another, and how many each has. A round merges each word's lowest pair, the first of equal ones."""
        m = len(start)
        place = np.arange(width)
        inside = place < size[:, None]
        at = np.minimum(start[:, None] + place, len(data) - 1)
        sym = np.where(inside, self.bytes[(place == size[:, None] - 1).astype(np.int64), data[at]], np.int32(-1))
        if (sym[inside] < 0).any():
            raise KeyError("a byte that the vocabulary lacks")
        n, done, counts, live = size.copy(), np.full((m, width), -1, np.int32), size.copy(), np.arange(m)
        merge = np.full((m, width), -1, np.int32)  # of the symbol at a place with the next one
        if width > 1:
            both = inside[:, 1:]
            merge[:, :-1][both] = self._merge_of(sym[:, :-1][both], sym[:, 1:][both])
        while len(live):
            rank = self.ranks[merge]
            low = rank.argmin(axis=1)
            row = np.arange(len(live))
            more = rank[row, low] < _LAST
            if not more.all():
                out = ~more
                done[live[out]], counts[live[out]] = sym[out], n[out]
                live, sym, merge, n, low = live[more], sym[more], merge[more], n[more], low[more]
                row = np.arange(len(live))
                if not len(live):
                    break
            sym[row, low] = self.new[merge[row, low]]
            # What is behind the pair's second symbol moves up by one.
            src = np.minimum(place + (place > low[:, None]), width - 1)
            sym, merge = np.take_along_axis(sym, src, 1), np.take_along_axis(merge, src, 1)
            n -= 1
            sym[row, n], merge[row, n] = -1, -1
            merge[row, n - 1] = -1
            for i in (low - 1, low):
                ok = (i >= 0) & (i + 1 < n)
                r, c = row[ok], i[ok]
                merge[r, c] = self._merge_of(sym[r, c], sym[r, c + 1])
        return done[np.arange(width) < counts[:, None]], counts

    def word(self, word: str) -> list[int]:
        """The ids of one word."""
        letters, data = self.letters, word.encode("utf-8")
        chars = [letters[b] for b in data]
        chars[-1] += self.suffix
        sym = [self.vocab[c] for c in chars]
        n, merges = len(sym), self.merges
        if n == 1:
            return sym
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        right[-1] = -1
        queue = [(m[0], i, m[1], sym[i], sym[i + 1]) for i in range(n - 1) if (m := merges.get((sym[i], sym[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, new, a, b = heapq.heappop(queue)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # stale: one of the two was merged since
            sym[i], sym[j] = new, -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if m := merges.get((new, sym[k])):
                    heapq.heappush(queue, (m[0], i, m[1], new, sym[k]))
            h = left[i]
            if h >= 0 and (m := merges.get((sym[h], new))):
                heapq.heappush(queue, (m[0], h, m[1], sym[h], new))
        return [s for s in sym if s >= 0]

    def words(self, text: str) -> Iterator[str | int]:
        """The text's words in order, and the ids of special tokens."""
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                yield self.special[part]
            elif part:
                pattern = self.pattern
                low = self.normal(part)
                if not part.isascii():
                    pattern = pattern if self.odd.isdisjoint(low) else self.exact
                yield from pattern.findall(low)

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return [i for w in self.words(text) for i in ([w] if isinstance(w, int) else self.word(w))]

    def decode(self, ids: Iterable[int]) -> str:
        """The ids' vocabulary strings, one space between them; unknown ids are left out."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)

    def normal(self, text: str) -> str:
        """The text as words are cut from it, but for its white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            for a, b in _LOWER.items():  # most texts hold none; translate() would go by each character
                if chr(a) in text:
                    text = text.replace(chr(a), chr(b))
        return text.lower()

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and the SHA-256 of the ids and of the decoded text."""
        ids = self.encode(text)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """digest() of each text."""
        out: list = [None] * len(texts)
        held: list[int] = []
        size = 0
        for i, x in enumerate(texts):
            if len(x) > 8 * CHUNK or (self.cut and self.cut.search(x)):
                out[i] = self.digest(x)
                continue
            held.append(i)
            size += len(x)
            if size > CHUNK:
                self._chunk(texts, held, out)
                held, size = [], 0
        self._chunk(texts, held, out)
        return out

    def _chunk(self, texts: list[str], held: list[int], out: list) -> None:
        """Sets out for the texts `held`, none of which has a special token's string."""
        parts = [self.normal(texts[i]) for i in held]
        lengths = np.array([len(x) for x in parts], np.int64)
        codes = _codes("\n".join(parts) + "\n")  # no word goes on from text to text
        ends = np.cumsum(lengths + 1)
        begin = self._starts(codes)
        seen = self.kinds[codes] != _SPACE
        codes, begin = codes[seen], begin[seen]
        before = np.concatenate([[0], np.cumsum(seen)])[ends]  # characters of words up to each text's end
        data, width = _utf8(codes)
        first = np.flatnonzero(begin)
        at = np.concatenate([[0], np.cumsum(width)])
        tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(at[first], at[-1]).astype(np.int64)), pa.py_buffer(data)])
        coded = tokens.dictionary_encode()
        known, number = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        offs = np.frombuffer(known.buffers()[1], np.int64)[known.offset : known.offset + len(known) + 1]
        flat = np.frombuffer(known.buffers()[2], np.uint8) if len(known) else np.zeros(0, np.uint8)
        ids, bounds = self.together(flat, offs)
        last = np.searchsorted(first, before)  # words up to each text's end
        count = np.concatenate([[0], np.cumsum(np.diff(bounds)[number])])[last]
        digests = []
        for strings in (self.numbers, self.names):
            got = strings.take(pa.array(ids))
            where = np.frombuffer(got.buffers()[1], np.int64)[got.offset :][bounds] if len(got) else np.zeros(len(bounds), np.int64)
            each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(known), [None, pa.py_buffer(np.ascontiguousarray(where)), got.buffers()[2]]) if len(got) else got
            all_ = each.take(pa.array(number))
            to = np.frombuffer(all_.buffers()[1], np.int64)[last].tolist() if len(all_) else [0] * len(held)
            view = memoryview(all_.buffers()[2]) if len(all_) else memoryview(b"")
            start, own = 0, []
            for end in to:
                own.append(hashlib.sha256(view[start : max(end - 1, start)]).hexdigest())  # without the last space
                start = end
            digests.append(own)
        for i, n, x, y in zip(held, np.diff(count, prepend=0).tolist(), *digests, strict=True):
            out[i] = (n, x, y)

    def _starts(self, codes: np.ndarray) -> np.ndarray:
        """Whether a word begins at each character: as the pattern's matches do, runs of letters or of other characters, each number, and the short forms after an apostrophe at a run's start."""
        kind = self.kinds[codes]
        begin = np.ones(len(codes), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        begin &= kind != _SPACE
        quote = np.flatnonzero(begin & (codes == 39))
        next_ = [codes[np.minimum(quote + k, len(codes) - 1)] for k in (1, 2)]
        size = np.zeros(len(quote), np.int64)
        for short in ("s", "t", "re", "ve", "m", "ll", "d"):
            hit = size == 0
            for k, c in enumerate(short):
                hit &= next_[k] == ord(c)
            size[hit] = len(short)
        quote, size = quote[size > 0], size[size > 0]
        begin[quote + 1] = False
        rest = quote + 1 + size  # letters go on there, or another kind begins anyway
        begin[rest] |= kind[rest] == _LETTER
        return begin


def _codes(text: str) -> np.ndarray:
    """The code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _utf8(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the code points, and how many each has."""
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    data = np.frombuffer(codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    return data, width


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This worker's codec for the file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the array of ids of its text; a column that has this name already is replaced."""
    path, own = path or default_file(), Hidden(docs, [out])
    full, kept = own.df.select(*own.kept, text_of(own.of(text)).alias("t")), own.kept
    schema = T.StructType([*full.schema.fields[:-1], T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = [c.encode(x.as_py() or "") for x in b.column("t")]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(ids, pa.list_(pa.int32()))], names=[*kept, out])

    return own.back(full.mapInArrow(trimmed(run), schema))


def decode(tokens: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """tokens with the text that its arrays of ids stand for; null where the array is."""
    path, own = path or default_file(), Hidden(tokens, [out])
    full, kept = own.df.select(*own.kept, F.col(own.of(ids)).alias("ids")), own.kept
    schema = T.StructType([*full.schema.fields[:-1], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [None if x is None else c.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(texts, pa.string())], names=[*kept, out])

    return own.back(full.mapInArrow(trimmed(run), schema))


def digests(docs: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (the columns `keep`, or all) with n_tokens, ids_sha256 and decoded_sha256 in place of any columns so named."""
    path, names = path or default_file(), ["n_tokens", "ids_sha256", "decoded_sha256"]
    own = Hidden(docs, names, keep)
    source, kept = own.df.select(*own.kept, text_of(own.of(text)).alias("t")), own.kept
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.StringType(), T.StringType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            got = c.digests([x or "" for x in b.column("t").to_pylist()])
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *cols], names=[*kept, *names])

    return own.back(source.mapInArrow(trimmed(run), schema))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document."""
    return digests(load(spark, sf_dir, "documents"), keep=["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: doc_id and the digests of each document that is left, one row a row. Null and empty texts have 0 tokens; an empty table gives no rows; other columns aren't read."""
    return digests(docs, keep=["doc_id"])
