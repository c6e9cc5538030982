"""Language-model scores from a probabilistic suffix tree over words.

A text is read as its lower-cased (A-Z) words and one end. The root's distribution is that of the base score, where
words rarer than ``FREQUENT`` of all tokens share what their class (by the last three bytes) has; each class has one more
word, for all unseen ones. Every other node is a context of up to ``DEPTH`` words that occurs at least twice in the training texts.
A context is kept if it passes a divergence test against its parent, the nearest kept shorter context: leaving
out each occurrence in turn, its next-symbol distribution must be likelier than its parent's by ``GAIN`` nats in all.
A kept context's distribution is smoothed with its parent's, which weighs as ``WEIGHT`` symbols. The longest kept suffix of
what has been read gives a symbol's probability. The vocabulary is closed: each distribution sums to one over the known
words, the end, and one unseen word for each class.

Nothing bounds the number of contexts, words or symbols: the tree is as large as the texts make it. It is never in one
place. Texts are read in chunks; each chunk asks for its distinct places (context and next word), with their counts, where the
context's last word is at home; that partition holds all longer contexts too, decides which are kept,
and answers with one number for each place; the chunk adds them up. The places of a last word of more than half a partition's places are
spread by the class of the word before it, and those of a pair of two such words by the class of the one before that. What follows such words and pairs is counted over
all partitions before, so that how many there are decides no score. Equal places of a chunk are asked for once, so that no repeated passage loads one partition.

Broadcast are at most ``1 / FREQUENT`` words. Null and empty texts consist of the end alone. Repeated rows are learned and scored each.
A row without doc_id is learned from. An empty training part leaves uniform distributions; an empty table gives no rows. Very long
texts are read whole; a chunk grows to hold one. Extra columns are dropped. Words, contexts and
places are told apart by hashes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import id_text, settle
from .words import SPACED, Words, mix, words

#: Words of a context at most; classes of rare words; share of all tokens from which a word is frequent.
DEPTH, CLASSES, FREQUENT = 3, 128, 1e-6
#: Nats that a context must gain over its parent in all; the parent's weight in smoothing, in symbols.
GAIN, WEIGHT = 2.0, 4.0
#: Places in a partition of the tree and in a chunk of texts, about.
PLACES, CHUNK = 1_000_000, 1_000_000
END_WORD = 0x0E4D0E4D
#: Symbols in 32 bits: frequent words by rank, the end, what is before a text, and from RARE on the class and a hash of a rare word.
END, BEFORE, RARE = 0x7FFFFFFE, 0x7FFFFFFF, 0x80000000
_U = np.uint64
_KEPT_ROWS = 3_000_000


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def distinct(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of what comes with them."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], *(np.add.reduceat(s[order], at) if len(at) else s for s in sums)


class Tally:
    """Counts of 64-bit keys; memory follows the distinct keys."""

    def __init__(self):
        self.keys, self.counts, self.loose = [np.zeros(0, _U)], [np.zeros(0, np.int64)], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys = np.sort(keys)
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            keys, counts = keys[at], np.diff(np.append(at, len(keys)))
        self.keys.append(keys)
        self.counts.append(counts)
        self.loose += len(keys)
        if self.loose > _KEPT_ROWS:
            self.total()
            self.loose = len(self.keys[0]) // 2

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = distinct(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts = [keys], [counts]
        return keys, counts

    def rows(self) -> Iterator[pa.RecordBatch]:
        keys, counts = self.total()
        for i in range(0, len(keys), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 200_000].view(np.int64)), pa.array(counts[i : i + 200_000])], names=["key", "n"])


def word_keys(w: Words) -> np.ndarray:
    """Words have their class in the low bits of the key; that costs 7 of 64 bits of the hash."""
    return (w.hash & ~_U(CLASSES - 1)) | (w.ending % _U(CLASSES))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally, texts = Tally(), 0
    for batch in batches:
        batch = batch.filter(pa.array([not is_held_out(i) for i in batch.column(0).to_pylist()], pa.bool_()))
        texts += batch.num_rows
        for w in words(batch.column(1), SPACED):
            tally.add(word_keys(w))
    if texts:
        tally.add(np.array([END_WORD], _U), np.array([texts]))
    yield from tally.rows()


def _sum_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of a key's rows are in one partition; each task has sent one at most."""
    tally = Tally()
    for batch in batches:
        tally.add(batch.column(0).to_numpy().view(_U), batch.column(1).to_numpy())
    yield from tally.rows()


@dataclass
class Root:
    """The root's distribution, and where contexts are at home."""

    total: int  # training tokens, and distinct ones
    types: int
    ends: int
    keys: np.ndarray  # frequent words, ascending, their ranks, and their counts by rank
    rank: np.ndarray
    counts: np.ndarray
    rare: np.ndarray  # probability of each rare word of a class
    parts: int  # partitions of the tree

    @classmethod
    def of(cls, vocabulary: DataFrame) -> Root:
        of_class = F.col("key").bitwiseAND(CLASSES - 1)
        total, types = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        least = max(1, int(FREQUENT * total))
        often = vocabulary.where(F.col("n") >= least).toArrow()
        keys, n = often.column("key").to_numpy().view(_U), often.column("n").to_numpy()
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        end = keys == _U(END_WORD)
        sums, kinds = np.full(CLASSES, 1 / CLASSES), np.ones(CLASSES)
        for r in vocabulary.where((F.col("n") < least) & (F.col("key") != END_WORD)).groupBy(of_class.alias("c")).agg(F.sum(F.col("n") + 1).alias("n"), F.count("*").alias("k")).collect():
            sums[r["c"]] += r["n"]
            kinds[r["c"]] += r["k"]
        ends, keys, n = int(n[end].sum()), keys[~end], n[~end]
        by_rank = np.lexsort((keys, -n))
        rank = np.empty(len(keys), np.uint32)
        rank[by_rank] = np.arange(len(keys))
        return cls(int(total), types, ends, keys, rank, n[by_rank], sums / kinds / (total + types + 1), max(1, -(-total // PLACES)))

    def __post_init__(self):
        self.norm = float(self.total + self.types + 1)
        self.logs = np.log10(self.counts + 1.0)
        crowd = self.total / (2 * self.parts)
        self.crowded = np.where(self.counts > crowd, self.counts, 0) / max(crowd, 1)

    def symbols(self, keys: np.ndarray) -> np.ndarray:
        """Of words' keys."""
        out = (RARE | (keys % _U(CLASSES)) << _U(24) | (keys >> _U(20)) & _U(0xFFFFFF)).astype(np.uint32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out = np.where(self.keys[at] == keys, self.rank[at], out)
        return out

    def p(self, symbols: np.ndarray) -> np.ndarray:
        out = self.rare[(symbols >> 24) & (CLASSES - 1)]
        known = symbols < len(self.keys)
        out[known] = (self.counts[symbols[known]] + 1) / self.norm
        out[symbols == END] = (self.ends + 1) / self.norm
        return out

    def home(self, keys: np.ndarray) -> np.ndarray:
        """The partition of each key, ascending with the keys."""
        return ((keys >> _U(40)) * _U(self.parts) >> _U(24)).astype(np.int64)

    def contexts(self, last: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
        """The shortest contexts: the last word's key. ``one``, ``two`` and ``three`` are the symbols before a place."""
        return mix(last)

    def homes(self, contexts: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
        """Where places are at home: their shortest context's key, or that with a class of what is before it. No distribution depends on it."""
        out = contexts.copy()
        if not self.crowded.any():
            return out
        load = lambda s: np.where(s < len(self.keys), self.crowded[np.minimum(s, len(self.keys) - 1)], 0)
        at = np.flatnonzero(load(one))
        first, second = load(one[at]), load(two[at])
        kind = mix(two[at].astype(_U) + _U(1))
        classes = kind % np.ceil(first).astype(_U)
        pair = second > 0
        spread = np.ceil(np.minimum(first[pair], second[pair])).astype(_U)
        classes[pair] = mix(kind[pair]) + mix(three[at[pair]].astype(_U) + _U(7)) % spread
        out[at] = mix(out[at] + mix(classes + _U(1)))
        return out


@dataclass
class Common:
    """What all partitions know of contexts that several of them hold: crowded words (by rank), and pairs of them."""

    words: int
    kept: np.ndarray
    pairs: np.ndarray  # ascending
    seen: np.ndarray
    pair_kept: np.ndarray

    def at(self, pairs: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pairs, pairs)


class Line:
    """The places of a block of texts."""

    def __init__(self, root: Root, w: Words):
        self.n = np.diff(w.bounds) + 1
        self.owner = np.repeat(np.arange(w.texts), self.n)
        self.begin = np.cumsum(self.n) - self.n
        nth = np.arange(len(self.owner)) - self.begin[self.owner]
        self.keys, self.symbols = np.full(len(self.owner), END_WORD, _U), np.full(len(self.owner), END, np.uint32)
        real = np.flatnonzero(nth < self.n[self.owner] - 1)
        self.keys[real] = word_keys(w)
        self.symbols[real] = root.symbols(self.keys[real])
        self.at = at = np.flatnonzero(nth >= 1)
        back = lambda d: np.where(nth[at] >= d, self.symbols[np.maximum(at - d, 0)], np.uint32(BEFORE))
        self.one, self.two, self.three = self.symbols[at - 1], back(2), back(3)
        self.home = root.homes(root.contexts(self.keys[at - 1], self.one, self.two, self.three), self.one, self.two, self.three)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in few bytes: by planes of bytes, compressed."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    return head + pa.compress(planes, "zstd", asbytes=True)


def unpack(body: bytes) -> list[np.ndarray]:
    kinds = [struct.unpack_from("<2sq", body, 1 + 10 * i) for i in range(body[0])]
    sizes = [n * np.dtype(k.decode()).itemsize for k, n in kinds]
    planes, at, out = np.frombuffer(pa.decompress(body[1 + 10 * len(kinds) :], sum(sizes), "zstd", asbytes=True), np.uint8), 0, []
    for (kind, n), size in zip(kinds, sizes, strict=True):
        out.append(planes[at : at + size].reshape(size // n, n).T.copy().view(kind.decode()).ravel() if n else np.zeros(0, kind.decode()))
        at += size
    return out


class Chunk:
    """Texts that ask together."""

    def __init__(self, root: Root):
        self.root, self.texts, self.size = root, 0, 0
        self.places: list[tuple[np.ndarray, ...]] = []
        self.rare: list[tuple[np.ndarray, ...]] = []
        self.docs: list[tuple[np.ndarray, ...]] = []

    def add(self, w: Words, ids: list, held: np.ndarray) -> None:
        root, line = self.root, Line(self.root, w)
        owner, begin, n, keys, symbols, at = line.owner, line.begin, line.n, line.keys, line.symbols, line.at
        known = symbols < len(root.keys)
        total = lambda values, at: np.bincount(owner[at], values, w.texts)
        self.docs.append((
            np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), held.astype(np.uint8), n.astype(np.int64),
            np.bincount(owner[known], minlength=w.texts).astype(np.int64), total(root.logs[symbols[known]], known), np.log10(root.p(symbols[begin])),
        ))
        rare = np.flatnonzero(symbols >= RARE)
        self.rare.append((keys[rare], (owner[rare] + self.texts).astype(np.uint32)))
        who = np.where(line.one < np.count_nonzero(root.crowded), line.one + 1, 0).astype(np.uint32)
        self.places.append((line.home, line.two, line.three, symbols[at], (owner[at] + self.texts).astype(np.uint32), who))
        self.texts += w.texts
        self.size += len(owner)

    def rows(self, chunk: int) -> pa.RecordBatch:
        """What is asked for, by partition; and, beyond the partitions, what the chunk needs to add up the answers."""
        doc = [np.concatenate(c) for c in zip(*self.docs, strict=True)]
        train = 1 - doc[2].astype(np.int64)
        context, two, three, symbol, text, who = (np.concatenate(c) for c in zip(*self.places, strict=True))
        exact = mix(mix(context + two) + (three.astype(_U) << _U(32) | symbol))
        order = np.argsort(context >> _U(40) << _U(40) | (two.astype(_U) & _U(0xFFFFFF)) << _U(16) | exact >> _U(48))
        context, two, three, symbol, text, who = (x[order] for x in (context, two, three, symbol, text, who))
        first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (two[1:] != two[:-1]) | (three[1:] != three[:-1]) | (symbol[1:] != symbol[:-1])])) if len(order) else order
        often = np.add.reduceat(train[text], first).astype(np.uint32) if len(first) else np.zeros(0, np.uint32)
        asked, who = (context[first], two[first], three[first], symbol[first], often), who[first]
        word, word_text = (np.concatenate(c) for c in zip(*self.rare, strict=True))
        order = np.argsort(word)
        word, word_text = word[order], word_text[order]
        word_first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else order
        word_often = np.add.reduceat(train[word_text], word_first).astype(np.uint32) if len(word_first) else np.zeros(0, np.uint32)
        words_asked = word[word_first], word_often
        edges = lambda keys: np.searchsorted(self.root.home(keys), np.arange(self.root.parts + 1))
        a, b = edges(asked[0]), edges(words_asked[0])
        parts, bodies = [], []
        for p in np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)).tolist():
            mine = [x[a[p] : a[p + 1]] for x in asked]
            runs = np.flatnonzero(np.concatenate([[True], mine[0][1:] != mine[0][:-1]])) if len(mine[0]) else np.zeros(0, np.int64)
            parts.append(p)
            own = mine[0][runs]  # a partition has few contexts, so that 40 bits tell them apart
            bodies.append(pack((own >> _U(32)).astype(np.uint8), own.astype(np.uint32), np.diff(np.append(runs, len(mine[0]))).astype(np.uint32), who[a[p] : a[p + 1]][runs], *mine[1:], *(x[b[p] : b[p + 1]] for x in words_asked)))
        size = lambda first, n: np.diff(np.append(first, n)).astype(np.uint32)
        parts.append(self.root.parts + chunk % self.root.parts)
        bodies.append(pack(*doc, text, size(first, len(text)), word_text, size(word_first, len(word_text))))
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([chunk] * len(parts), pa.int64()), pa.array(bodies, pa.binary())], names=["part", "chunk", "body"])


def _ask(root: Root, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, held = TaskContext.get().partitionId() << 32, Chunk(root)
    for batch in batches:
        ids = batch.column(0).to_pylist()
        out = np.array([is_held_out(i) for i in ids], bool)
        for w in words(batch.column(1), SPACED):
            held.add(w, ids[w.first : w.first + w.texts], out[w.first : w.first + w.texts])
            if held.size >= CHUNK:
                yield held.rows(number)
                number, held = number + 1, Chunk(root)
    if held.texts:
        yield held.rows(number)


class Groups:
    """Rows by a 64-bit key, for sums over equal keys. Sorting keys with the rows' numbers in their low bits is several times faster than an argsort."""

    def __init__(self, keys: np.ndarray):
        bits = _U(max(1, int(len(keys)).bit_length()))
        held = np.sort(mix(keys) >> bits << bits | np.arange(len(keys), dtype=_U))
        self.order = (held & ((_U(1) << bits) - _U(1))).astype(np.int64)
        held >>= bits
        self.first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.sizes = np.diff(np.append(self.first, len(keys)))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each row the sum over its group."""
        out = np.empty(len(values), values.dtype)
        if len(values):
            out[self.order] = np.repeat(np.add.reduceat(values[self.order], self.first), self.sizes)
        return out


def _count_common(root: Root, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of places after a crowded word: (word, next symbol), and (word, word before, next symbol) of two crowded ones, by partition, with their training counts."""
    crowd = np.count_nonzero(root.crowded)
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        key, part, often = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((part, key))
        key, part, often = key[order], part[order], often[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        key, part, often = key[first], part[first], np.add.reduceat(often, first)
        ids = key >> _U(32)
        word = np.where(ids < crowd, ids, (ids - _U(crowd)) // _U(crowd))
        bucket = (mix(word << _U(32) | key & _U(0xFFFFFFFF)) % _U(root.parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        bodies = [pack(key[x], part[x].astype(np.uint32), often[x].astype(np.uint32)) for x in np.split(order, starts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(bodies, pa.binary())], names=["bucket", "body"])

    for batch in batches:
        train = np.array([not is_held_out(i) for i in batch.column(0).to_pylist()], np.int64)
        for w in words(batch.column(1), SPACED):
            line = Line(root, w)
            x = np.flatnonzero(line.one < crowd)
            if not len(x):
                continue
            one, two, symbol = line.one[x].astype(_U), line.two[x].astype(_U), line.symbols[line.at[x]].astype(_U)
            part, often = root.home(line.home[x]), train[w.first + line.owner[line.at[x]]]
            both = np.flatnonzero(two < crowd)
            pair = _U(crowd) + one[both] * _U(crowd) + two[both]
            held.append((np.concatenate([one << _U(32) | symbol, pair << _U(32) | symbol[both]]), np.concatenate([part, part[both]]), np.concatenate([often, often[both]])))
            n += len(held[-1][0])
            if n > 2 * CHUNK:
                yield from flush()
                held.clear()
                n = 0
    if held:
        yield from flush()


def _sum_common(key: tuple, group: pa.Table) -> pa.Table:
    """All of a next symbol's counts after a word are here: distinct keys, their counts in all, and the partitions that ask for each."""
    keys, part, often = (np.concatenate(x) for x in zip(*(unpack(b.as_py()) for b in group.column("body")), strict=True))
    order = np.lexsort((part, keys))
    keys, part, often = keys[order], part[order], often[order].astype(np.int64)
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    first = np.flatnonzero(new)
    total = np.add.reduceat(often, first)
    apart = np.flatnonzero(new | np.concatenate([[True], part[1:] != part[:-1]]))
    parts = np.diff(np.append(np.searchsorted(apart, first), len(apart)))
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "body": pa.array([pack(keys[first], total, parts.astype(np.uint32), part[apart])], pa.binary())})


def _gains(root: Root, common: Common | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each crowded word, or with ``common`` each pair of them, how often it was seen and how many nats it gains over its parent."""
    crowd = np.count_nonzero(root.crowded)
    for batch in batches:
        for body in batch.column("body"):
            keys, mine, _, _ = unpack(body.as_py())
            ids, symbol = (keys >> _U(32)).astype(np.int64), keys.astype(np.uint32)
            p, gain = root.p(symbol), np.zeros(len(keys))
            single = ids < crowd
            seen = root.counts[ids[single]]
            if common is None:
                without = (np.maximum(mine[single] - 1, 0) + WEIGHT * p[single]) / (seen - 1 + WEIGHT)
                gain[single] = mine[single] * np.log(without / p[single])
            else:
                x = np.flatnonzero(~single)
                word = (ids[x] - crowd) // crowd
                count = mine[np.searchsorted(keys, word.astype(_U) << _U(32) | symbol[x].astype(_U))]
                parent = np.where(common.kept[word], (count + WEIGHT * p[x]) / (root.counts[word] + WEIGHT), p[x])
                without = (np.maximum(mine[x] - 1, 0) + WEIGHT * parent) / (np.maximum(common.seen[common.at(ids[x])] - 1, 0) + WEIGHT)
                gain[x] = mine[x] * np.log(without / parent)
            found, at = np.unique(ids, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(at, mine, len(found)).astype(np.int64)), pa.array(np.bincount(at, gain, len(found)))], names=["id", "seen", "gain"])


def _common(root: Root, counted: DataFrame) -> Common:
    crowd = int(np.count_nonzero(root.crowded))
    sums = lambda c: counted.mapInArrow(lambda it: _gains(root, c, it), "id long, seen long, gain double").groupBy("id").agg(F.sum("seen").alias("seen"), F.sum("gain").alias("gain")).orderBy("id").toArrow()
    once = sums(None)
    ids, seen, gain = (once.column(c).to_numpy() for c in ("id", "seen", "gain"))
    kept = np.zeros(crowd, bool)
    kept[ids[ids < crowd]] = gain[ids < crowd] >= GAIN
    pair = ids >= crowd
    out = Common(crowd, kept, ids[pair], seen[pair], np.zeros(int(pair.sum()), bool))
    twice = sums(out)
    out.pair_kept = twice.column("gain").to_numpy()[twice.column("id").to_numpy() >= crowd] >= GAIN
    return out


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each partition the counts of those keys that others ask for, too."""
    for batch in batches:
        for body in batch.column("body"):
            keys, total, parts, part = unpack(body.as_py())
            several = np.repeat(parts > 1, parts)
            keys, total, part = np.repeat(keys, parts)[several], np.repeat(total, parts)[several], part[several].astype(np.int64)
            order = np.lexsort((keys, part))
            keys, total, part = keys[order], total[order], part[order]
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            bodies = [pack(k, t) for k, t in zip(np.split(keys, starts[1:]), np.split(total.astype(np.uint32), starts[1:]), strict=True)] if len(starts) else []
            yield pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int64()), pa.array([-1] * len(starts), pa.int64()), pa.array(bodies, pa.binary())], names=["part", "chunk", "body"])


def chances(
    root: Root, context: np.ndarray, two: np.ndarray, three: np.ndarray, symbol: np.ndarray, often: np.ndarray,
    who: np.ndarray | None = None, common: Common | None = None, keys: np.ndarray | None = None, totals: np.ndarray | None = None,
) -> np.ndarray:
    """The probability of each place's symbol, from all places of the contexts and how often training texts have them.

    A place may come several times. From the shortest context on, each passes the test or leaves its parent's distribution standing.
    ``who`` is a crowded last word's rank and one, else 0; other partitions hold places of its context, too: ``keys`` and ``totals`` are counts over all.
    """
    p, n = root.p(symbol), often.astype(np.float64)
    rows, key = np.arange(len(p)), context
    if common:
        key = np.where(who > 0, mix(who.astype(_U) + _U(0x5EED)), context)
    for depth in range(DEPTH):
        if depth:
            key = mix(key + (two, three)[depth - 1][rows].astype(_U) * _U(0x9E3779B97F4A7C15) + _U(depth))
        by_context = Groups(key)
        seen = by_context.sums(n[rows])
        wide = np.zeros(len(rows), bool)
        ids = np.zeros(len(rows), np.int64)
        if common and depth < 2:
            wide = who[rows] > 0
            ids = who[rows].astype(np.int64) - 1
            if depth:
                wide &= two[rows] < common.words
                ids = common.words + ids * common.words + two[rows]
            seen[wide] = common.seen[common.at(ids[wide])] if depth else root.counts[ids[wide]]
        alive = seen >= 2
        if not alive.all():
            rows, key, wide, ids = rows[alive], key[alive], wide[alive], ids[alive]
            by_context, seen = Groups(key), seen[alive]
        mine = Groups(key + mix(symbol[rows].astype(_U) + _U(11))).sums(n[rows])
        if wide.any() and len(keys):
            x = np.flatnonzero(wide)
            wanted = ids[x].astype(_U) << _U(32) | symbol[rows[x]].astype(_U)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found = keys[at] == wanted
            mine[x[found]] = totals[at[found]]
        parent, times = p[rows], n[rows]
        without = (np.maximum(mine - 1, 0) + WEIGHT * parent) / (seen - 1 + WEIGHT)
        kept = by_context.sums(times * np.log(without / parent)) >= GAIN
        if wide.any():
            kept[wide] = common.pair_kept[common.at(ids[wide])] if depth else common.kept[ids[wide]]
        p[rows[kept]] = ((mine + WEIGHT * parent) / (seen + WEIGHT))[kept]
    return p


def _answer(root: Root, common: Common | None, key: tuple, group: pa.Table) -> pa.Table:
    """One number for each place that was asked for: log10 of its probability, to eleven bits; and the counts of rare words."""
    part = key[0].as_py()
    kind = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("body", pa.binary())])
    if part >= root.parts:
        return pa.table({"chunk": group.column("chunk"), "part": pa.array([-1] * group.num_rows, pa.int64()), "body": group.column("body")}, kind)
    wide = group.column("chunk").to_numpy() < 0
    told = [unpack(b.as_py()) for b in group.filter(pa.array(wide)).column("body")]
    group = group.filter(pa.array(~wide))
    keys, totals = np.concatenate([np.zeros(0, _U), *(t[0] for t in told)]), np.concatenate([np.zeros(0, np.uint32), *(t[1] for t in told)])
    order = np.argsort(keys)
    keys, totals = keys[order], totals[order]
    asked = [unpack(b.as_py()) for b in group.column("body")]
    ends = lambda i: np.cumsum([0, *(len(x[i]) for x in asked)])
    a, b = ends(6), ends(8)
    join = lambda i: np.concatenate([x[i] for x in asked])
    counts = Groups(join(8)).sums(join(9).astype(np.int64))
    context, who = np.repeat(join(0).astype(_U) << _U(32) | join(1), join(2)), np.repeat(join(3), join(2))
    places = context, join(4), join(5), join(6), join(7), who
    asked.clear()
    logs = np.empty(len(who), np.float16)
    # A share of the contexts at a time, as a place needs many times its own memory here; all of a crowded word's are in one share.
    shares = max(1, len(who) * 4 // PLACES)
    share = (np.where(who > 0, mix(who.astype(_U)), context) % _U(shares)).astype(np.uint32)
    for i in range(shares):
        at = np.flatnonzero(share == i)
        logs[at] = np.log10(chances(root, *(x[at] for x in places), common, keys, totals))
    out = [pack(logs[a[i] : a[i + 1]], counts[b[i] : b[i + 1]]) for i in range(group.num_rows)]
    return pa.table({"chunk": group.column("chunk"), "part": pa.array([part] * len(out), pa.int64()), "body": pa.array(out, pa.binary())}, kind)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _gather(root: Root, group: pa.Table) -> pa.Table:
    group = group.sort_by("part")
    doc_id, missing, held, n, known, base, score, text, size, word_text, word_size = unpack(group.column("body")[0].as_py())
    answers = [unpack(b.as_py()) for b in group.column("body")[1:]]
    join = lambda i, kind: np.concatenate([np.zeros(0, kind), *(a[i] for a in answers)])
    score = score + np.bincount(text, np.repeat(join(0, np.float16).astype(np.float64), size), len(n))
    counts = np.repeat(join(1, np.int64), word_size)
    base = base + np.bincount(word_text, np.log10(counts + 1.0), len(n)) + (np.log10(root.ends + 1.0) - n * np.log10(root.norm))
    known = known + np.bincount(word_text, counts > 0, len(n)).astype(np.int64) + (root.ends > 0)
    return pa.table({
        "doc_id": pa.array(doc_id, pa.int64(), mask=missing.astype(bool)), "held_out": held.astype(bool), "n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), root.total), "base_score": base, "score": score,
    })


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    docs = id_text(docs)
    root = Root.of(settle(docs.mapInArrow(_count_words, "key long, n long").repartition("key").mapInArrow(_sum_keys, "key long, n long"), "vocabulary"))
    asked = docs.mapInArrow(lambda it: _ask(root, it), "part long, chunk long, body binary")
    common, files = None, max(1, root.parts // 8)  # written tables have few files, as Hadoop's local file system starts a chmod for each
    if root.crowded.any():
        counted = docs.mapInArrow(lambda it: _count_common(root, it), "bucket long, body binary").repartition(files, "bucket")
        counted = settle(counted.groupBy("bucket").applyInArrow(_sum_common, "bucket long, body binary"), "common")
        common = _common(root, counted)
        asked = asked.unionByName(counted.mapInArrow(_spread, "part long, chunk long, body binary"))
    answers = asked.repartition(2 * root.parts, "part").groupBy("part").applyInArrow(lambda key, t: _answer(root, common, key, t), "chunk long, part long, body binary")
    return settle(answers.repartition(files, "chunk").groupBy("chunk").applyInArrow(lambda t: _gather(root, t), SCORED), "scored")
