"""Benchmark decontamination by winnowed fingerprints that are extended to whole runs.

Both sides keep the least hash of every ``SPAN - GRAM + 1`` consecutive ``GRAM``-word grams, so
that every shared run of ``SPAN`` words has a fingerprint in common at the same place. Equal
fingerprints are joined, and each hit is extended word by word in both directions; a
run of at least ``SPAN`` words (or a whole shorter item) counts. Nothing is lost and nothing
else is found, up to collisions of 64-bit word hashes.

Items are broadcast in blocks of at most ``ITEM_BYTES`` of text. The first block's hits are found while the documents pass by. Each
further block reads the texts alone and writes only hits, under a digest of their text, which are joined back at the end:
no text is written again, however many blocks there are.

A null text has no words. An item without words, and an empty item table, match nothing. Repeated rows are each
judged; repeated item ids count once, and of items with equal texts each is listed. Very long texts are taken whole. Further columns stay as they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .scratch import bound_batches, free_names, id_text, settle
from .words import ALNUM, Words, grams, words

SPAN, GRAM = 10, 5
ITEM_BYTES = 16_000_000
#: Pairs of equal fingerprints that are extended at a time, about.
PAIRS = 1_000_000
#: Bytes of hits of further blocks up to which they are broadcast, and the parts into which rows of one text are split beyond that.
HIT_BYTES, SALTS = 64_000_000, 16

FOUND = (LongType(), ArrayType(LongType()), ArrayType(StringType()))


def selected(hashes: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Places of the grams that winnowing keeps; ``whole`` marks where a window of SPAN words lies in one text."""
    width = SPAN - GRAM + 1
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, place = hashes[:n].copy(), np.arange(n)
    for i in range(1, width):
        lower = hashes[i : i + n] <= least  # of equal ones the last
        least[lower] = hashes[i : i + n][lower]
        place[lower] = np.flatnonzero(lower) + i
    return np.unique(place[whole[:n]])


class Index:
    """Fingerprints of one block of items."""

    def __init__(self, items: list[tuple[str, str]]):
        self.ids = sorted({i for i, _ in items})
        rank = {i: r for r, i in enumerate(self.ids)}
        body, lows, short, at = [], [], defaultdict(list), 0
        prints, owners, places = [], [], []
        table = pa.array([t for _, t in items], pa.string())
        for w in words(table, ALNUM):
            for i in range(w.texts):
                h = w.of(i)
                if not len(h):
                    continue
                item = rank[items[w.first + i][0]]
                if len(h) < SPAN:
                    short[len(h)].append((int(grams(h, len(h))[0]), item))
                    continue
                g = grams(h, GRAM)
                keep = selected(g, np.ones(len(g), bool))
                prints.append(g[keep])
                owners.append(np.full(len(keep), len(lows)))
                places.append(keep + at)
                lows.append((at, at + len(h), item))
                body.append(h.copy())
                at += len(h)
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        prints = join(prints, np.uint64)
        order = np.argsort(prints, kind="stable")
        self.body, self.prints, self.owners, self.places = join(body, np.uint64), prints[order], join(owners, np.int64)[order], join(places, np.int64)[order]
        self.low, self.high, self.item = np.array(lows, np.int64).reshape(-1, 3).T
        self.short = {}
        for n, rows in short.items():
            rows.sort()
            self.short[n] = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows])

    @staticmethod
    def _pairs(keys: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (place in wanted, place in keys) of equal values, about PAIRS at a time; keys are sorted."""
        lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        some = np.flatnonzero(hi > lo)
        for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(hi[some] - lo[some]) // PAIRS)) + 1):
            n = hi[part] - lo[part]
            yield np.repeat(part, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[part], n)

    def _extended(self, w: Words, text: np.ndarray, p: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end, item) of the shared runs around fingerprints at places ``p``.

        All are extended together, word by word, up to the next fingerprint of the same item on the same diagonal. A run goes on less than
        SPAN words without one, so that there are few rounds and each shared word is compared at most twice.
        """
        q, owner = self.places[hit], self.owners[hit]
        order = np.lexsort((p, p - q, owner, text[p]))
        p, q, owner = p[order], q[order], owner[order]
        row = text[p]
        beside = (row[1:] == row[:-1]) & (owner[1:] == owner[:-1]) & (p[1:] - q[1:] == p[:-1] - q[:-1])
        gap = np.where(beside, p[1:] - p[:-1], np.iinfo(np.int64).max)
        right = np.minimum(w.bounds[row + 1] - p, self.high[owner] - q)
        right[:-1] = np.minimum(right[:-1], gap)
        left = np.minimum(p - w.bounds[row], q - self.low[owner])
        left[1:] = np.minimum(left[1:], gap)

        def reach(most: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
            far = np.zeros(len(a), np.int64)
            on = np.flatnonzero(most > 0)
            while len(on):
                on = on[w.hash[a[on] + step * far[on]] == self.body[b[on] + step * far[on]]]
                far[on] += 1
                on = on[far[on] < most[on]]
            return far

        ahead, back = reach(right, p, q, 1), reach(left, p - 1, q - 1, -1)
        joined = ahead[:-1] == gap
        starts = np.flatnonzero(np.concatenate([[True], ~joined]))
        ends = np.append(starts[1:], len(p)) - 1
        first, end = p[starts] - back[starts], p[ends] + ahead[ends]
        long = end - first >= SPAN
        return first[long], end[long], self.item[owner[starts[long]]]

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hit spans of ``w``, apart and in order, as places in ``w.hash``; and sorted text * len(ids) + item."""
        text = np.repeat(np.arange(w.texts), np.diff(w.bounds))
        none = np.zeros(0, np.int64)
        first, end, pairs = none, none, none

        def add(a: np.ndarray, z: np.ndarray, item: np.ndarray) -> None:
            nonlocal first, end, pairs
            if len(a):
                pairs = np.unique(np.concatenate([pairs, text[a] * len(self.ids) + item]))
                first, end = merged(np.concatenate([first, a]), np.concatenate([end, z]), w.bounds)

        for size, (keys, items) in self.short.items():
            for at, hit in self._pairs(keys, grams(w.hash, size)):
                inside = text[at] == text[at + size - 1]
                add(at[inside], at[inside] + size, items[hit[inside]])
        if len(text) >= SPAN and len(self.prints):
            g = grams(w.hash, GRAM)
            keep = selected(g, text[: len(text) - SPAN + 1] == text[SPAN - 1 :])
            for at, hit in self._pairs(self.prints, g[keep]):
                if len(at):
                    add(*self._extended(w, text, keep[at], hit))
        return first, end, pairs

    def found(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Columns of word counts, spans and item ids of a text column."""
        bounds, parts = [np.zeros(1, np.int64)], []
        for w in words(texts, ALNUM):
            base = bounds[-1][-1]
            bounds.append(base + w.bounds[1:])
            first, end, pairs = self.hits(w)
            parts.append((first + base, end + base, pairs + w.first * len(self.ids)))
        bounds = np.concatenate(bounds)
        first, end, pairs = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 3
        return pa.array(np.diff(bounds)), *_columns(bounds, first, end, pairs, self.ids)


def merged(first: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans of one text as one, in order; texts are ``bounds`` of places."""
    order = np.argsort(first, kind="stable")
    first, far = first[order], np.maximum.accumulate(end[order])
    text = np.searchsorted(bounds, first, "right")
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] > far[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(new)
    return first[starts], far[np.append(starts[1:], len(first)) - 1] if len(first) else far


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)


def _columns(bounds: np.ndarray, first: np.ndarray, end: np.ndarray, pairs: np.ndarray, ids: list[str]) -> tuple[pa.Array, pa.Array]:
    """Spans and item ids of each text, from spans in order and sorted text * len(ids) + item."""
    n = len(bounds) - 1
    text = np.searchsorted(bounds, first, "right") - 1
    spans = np.stack([first - bounds[text], end - bounds[text]], 1).ravel()
    owner, item = np.divmod(pairs, max(1, len(ids)))
    return _lists(2 * np.bincount(text, minlength=n), pa.array(spans, pa.int64())), _lists(np.bincount(owner, minlength=n), pa.array(ids, pa.string()).take(pa.array(item)))


def _scan(index: Index, found_names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = index.found(b.column(b.schema.names.index("text")))
        yield pa.RecordBatch.from_arrays([*b.columns, *found], names=[*b.schema.names, *found_names])


def _only_hits(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest, spans and items of the texts that have any."""
    for b in batches:
        _, spans, items = index.found(b.column(0))
        rows = pa.RecordBatch.from_arrays([b.column(1), spans, items], names=["digest", "spans", "items"])
        yield rows.filter(pc.greater(pc.list_value_length(items), 0))


def _united(found_names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last two columns, spans and items of further blocks, are taken into the three before."""
    for b in batches:
        *columns, n_words, spans, items, more_spans, more_items = b.columns
        bounds = np.append(0, np.cumsum(n_words.to_numpy(zero_copy_only=False)))
        row = lambda c: np.repeat(np.arange(len(c)), pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False))
        place = [c.flatten().to_numpy(zero_copy_only=False) + bounds[row(c)] for c in (spans, more_spans)]
        first, end = merged(*(np.concatenate([x[i::2] for x in place]) for i in (0, 1)), bounds)
        held = pa.concat_arrays([items.flatten(), more_items.flatten()]).dictionary_encode()
        ids = held.dictionary.to_pylist()
        rank = np.empty(len(ids), np.int64)
        rank[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
        pairs = np.unique(np.concatenate([row(items), row(more_items)]) * len(ids) + rank[held.indices.to_numpy(zero_copy_only=False)])
        yield pa.RecordBatch.from_arrays([*columns, n_words, *_columns(bounds, first, end, pairs, sorted(ids))], names=[*b.schema.names[: len(columns)], *found_names])


def annotate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` with three more columns at its end: the number of words; first, end, first, end, ... of hit words, apart and in order; ids of items, sorted as strings.

    They are named _words, _spans and _items, with underscores after that where ``docs`` has such names. With more than one block of items,
    ``docs`` is read once for each, so it should come from a table.
    """
    bound_batches(docs.sparkSession)
    known = items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    names = free_names(docs, "_words", "_spans", "_items")
    schema = StructType([*docs.schema, *map(StructField, names, FOUND)])
    index = lambda b: Index([(r["i"], r["t"]) for r in known.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()])
    out = docs.mapInArrow(lambda it, index=index(0): _scan(index, names, it), schema)
    return out if blocks == 1 else _with_further(docs, out, schema, names, map(index, range(1, blocks)))


def _with_further(docs: DataFrame, out: DataFrame, schema: StructType, names: list[str], further: Iterator[Index]) -> DataFrame:
    """``out``, annotated with the first block, with the hits of further ones. Equal texts share their hits."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    texts = docs.where("text IS NOT NULL").select("text", digest.alias("digest"))
    kind = "digest string, spans array<bigint>, items array<string>"
    parts = [settle(texts.mapInArrow(lambda it, index=index: _only_hits(index, it), kind).distinct(), "hits") for index in further]
    both = reduce(DataFrame.unionByName, parts).groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    hits = settle(both, "hits")
    size = hits.agg(F.sum(F.size("spans") * 8 + F.octet_length(F.array_join("items", ",")) + 100)).first()[0] or 0
    key, salt, more_spans, more_items = free_names(out, "_digest", "_salt", "_more_spans", "_more_items")
    hits = hits.toDF(key, more_spans, more_items)
    out = out.withColumn(key, digest)
    if size <= HIT_BYTES:
        met = out.join(F.broadcast(hits), key, "left")
    else:  # rows of one text meet its hits in several tasks
        hits = hits.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = out.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(hits, [key, salt], "left")
    return met.select(*out.drop(key).columns, more_spans, more_items).mapInArrow(lambda it: _united(names, it), schema)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    signed = F.transform("_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    return annotate(id_text(docs), items).select(
        "doc_id", F.col("_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any hit."""
    found = annotate(docs, items)
    return found.where(F.size(found.columns[-1]) == 0).select(*docs.columns)
