"""Jaccard self-join of n-gram sets with prefix trees.

1. One pass over the texts gives each document its set's size and digest, and signatures: the
   set is cut into so many parts by value that two linked sets must agree in several whole parts.
2. Documents with enough signatures in common with others form candidate clusters (components of star edges, one
   edge for each member, never all pairs). Equal sets are one class from there on.
3. Each cluster's sets, rarest n-gram first, are stored in a trie. All sets walk it level by
   level together, so that partial overlaps with a shared prefix are counted once, and a subtree is left
   when the n-grams that remain on either side cannot reach the threshold.
   A cluster beyond ``TILE`` n-grams is cut into bands of sizes, of which only neighbours can hold linked sets, and each band into
   tiles; a tile is a trie that the tiles of its own band and of the next walk.

Linked means 100 * |A and B| >= PERCENT * |A or B|. The join is exact up to collisions of 64-bit
hashes: no candidate is dropped and nothing is capped. A null text, or one without words, has
an empty set and no links; a text of fewer than K words has one n-gram, of all its words.
doc_id is the key; rows that repeat entirely are equal documents. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected
from .scratch import BROADCAST_ROWS, id_text, settle, small
from .words import SPACED, mix, shingles, words

K, PERCENT = 4, 85
#: N-grams in one trie, about.
TILE = 400_000
#: Signatures that a task holds before it sends one row for each.
HELD = 1_000_000
#: Empty parts that make a signature together, so that sets of like sizes do not meet by one.
EMPTY = 3
_U = np.uint64


@lru_cache(maxsize=1)
def size_groups() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower bounds of groups of set sizes, the parts that sets of each are cut into, and how many of them may be empty.

    Linked sets are in the same or in neighbouring groups. Two linked sets of which the smaller is in
    group g differ in fewer values than the group has parts, by more than the empty parts allowed.
    """
    lows, parts, spare = [1], [], []
    while lows[-1] < 1 << 40:
        nxt = lows[-1] * 100 // PERCENT + 1
        a = nxt - 1
        differ = (a + a * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)
        extra = differ // 8 + min(differ, EMPTY - 1)
        parts.append(differ + 1 + extra)
        spare.append(extra)
        lows.append(nxt)
    return np.array(lows), np.array(parts), np.array(spare)


def signed_parts(values: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Signatures of one set (sorted distinct values) for its own size group and for the one below, each with how many of them any linked set has, too."""
    lows, parts, spare = size_groups()
    own = int(np.searchsorted(lows, len(values), "right")) - 1
    mixed = mix(values + _U(0x9E3779B97F4A7C15))
    out = []
    for g in (own, own - 1):
        if g < 0 or g == own - 1 and len(values) * PERCENT > (int(lows[own]) - 1) * 100:
            out.append((np.zeros(0, _U), 1))  # too large for any set of the group below
            continue
        m = int(parts[g])
        part = ((values >> _U(32)) * _U(m)) >> _U(32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        tag = mix(part[starts] * _U(1 << 20) + _U(g * 2))
        found = mix(np.add.reduceat(mixed, starts) + tag)
        beyond = m - len(starts) - int(spare[g])
        if beyond > 0:  # where no filled part agrees, more than the spare ones agree as empty: the first few of those are among these
            few = min(EMPTY, int(spare[g]) + 1)
            empty = np.setdiff1d(np.arange(m, dtype=_U), part[starts], assume_unique=True)[: beyond + few - 1]
            each = mix(empty * _U(1 << 20) + _U(g * 2 + 1))
            found = np.concatenate([found, mix(each[list(combinations(range(len(each)), few))].sum(1, dtype=_U))])
        out.append((found, max(1, 1 - beyond)))
    return out


def signatures(values: np.ndarray) -> np.ndarray:
    return np.concatenate([found for found, _ in signed_parts(values)])


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their least id, and for each id beyond that an edge to it."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    at = np.flatnonzero(new)
    base = np.repeat(ids[at], np.diff(np.append(at, len(keys))))
    apart = base != ids
    if apart.any():
        pairs = np.unique(np.stack([ids[apart], base[apart]]), axis=1)
    else:
        pairs = np.zeros((2, 0), np.int64)
    return keys[at], ids[at], pairs[0], pairs[1]


_ROWS = "kind int, key long, doc long, size long, d1 long, d2 long"
#: Documents; signatures for a set's own size group and for the one below, whose size is how many of them a linked set has at least; edges.
_DOC, _OWN, _BELOW, _EDGE = 0, 1, 2, 3


def _rows(kind, key, doc, size=None, d1=None, d2=None) -> pa.RecordBatch:
    n = len(key)
    blank = pa.nulls(n, pa.int64())
    wide = lambda x: blank if x is None else pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.int32(kind), n)), *map(wide, (key, doc, size, d1, d2))], names=["kind", "key", "doc", "size", "d1", "d2"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and the signatures of each distinct set under the least of its documents here."""
    held: dict[bytes, tuple[int, list[tuple[np.ndarray, int]]]] = {}
    n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        flat = [(kind, doc, need, keys) for doc, found in held.values() for kind, (keys, need) in zip((_OWN, _BELOW), found, strict=True)]
        sizes = [len(keys) for *_, keys in flat]
        kind, doc, need = (np.repeat(np.array(x), sizes) for x in list(zip(*flat, strict=True))[:3])
        key = np.concatenate([keys for *_, keys in flat]).view(np.int64)
        for i in range(0, len(key), 100_000):
            at = slice(i, i + 100_000)
            yield _rows(kind[at].astype(np.int32), key[at], doc[at], need[at])

    for batch in batches:
        ids = batch.column(0).to_pylist()
        found, sizes, digests = [], [], []
        for w in words(batch.column(1), SPACED):
            for i, values in shingles(w, K):
                found.append(ids[i])
                sizes.append(len(values))
                digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                if len(values) and ids[i] is not None:
                    if digests[-1] in held:
                        held[digests[-1]] = min(held[digests[-1]][0], ids[i]), held[digests[-1]][1]
                    else:
                        held[digests[-1]] = ids[i], signed_parts(values)
                        n += sum(len(keys) for keys, _ in held[digests[-1]][1])
            if n > HELD:
                yield from flush()
                held.clear()
                n = 0
        d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield _rows(_DOC, d[:, 0] ^ np.arange(len(d)), found, sizes, d[:, 0], d[:, 1])
    if held:
        yield from flush()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document rows as they are; of signatures, of which all rows are here, those that several documents have."""
    held = []
    for batch in batches:
        sign = batch.column(0).to_numpy() != _DOC
        rest = batch.filter(pa.array(~sign))
        if rest.num_rows:
            yield rest
        held.append([batch.column(c).to_numpy(zero_copy_only=False)[sign].astype(np.int32 if c in (0, 3) else np.int64) for c in range(4)])
    if not held:
        return
    kind, key, doc, need = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
    order = order[np.lexsort((doc[order], key[order]))]
    kind, key, doc, need = kind[order], key[order], doc[order], need[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])[: len(key)]  # a row that comes twice is one document
    kind, key, doc, need = kind[new], key[new], doc[new], need[new]
    same = key[1:] == key[:-1]
    several = (np.concatenate([[False], same]) | np.concatenate([same, [False]]))[: len(key)]
    kind, key, doc, need = kind[several], key[several], doc[several], need[several]
    for i in range(0, len(key), 100_000):
        at = slice(i, i + 100_000)
        yield _rows(kind[at], key[at], doc[at], need[at])


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures with their least document here, and star edges to it; edges as they are."""
    keys, docs, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for batch in batches:
        edge = batch.column(0).to_numpy() == _EDGE
        rest = batch.filter(pa.array(edge))
        if rest.num_rows:
            yield rest
        keys.append(batch.column(1).to_numpy()[~edge])
        docs.append(batch.column(2).to_numpy()[~edge])
        n += len(keys[-1])
        if n > 4 * HELD:  # one row for each signature is enough to go on with
            key, doc, a, b = _least(np.concatenate(keys), np.concatenate(docs))
            keys, docs, n = [key], [doc], 0
            yield _rows(_EDGE, a, b)
    if n:
        key, doc, a, b = _least(np.concatenate(keys), np.concatenate(docs))
        for i in range(0, len(key), 100_000):
            yield _rows(_OWN, key[i : i + 100_000], doc[i : i + 100_000])
        yield _rows(_EDGE, a, b)


def _edges(signed: DataFrame, known: DataFrame) -> DataFrame:
    """Star edges (a, b) of classes that may have links.

    A document that shares fewer signatures with other classes, in a size group, than any linked set would share, has no link there.
    Sets that have only some common passage in common are nearly all gone so, however many there are.
    """
    copies = settle(known.where("doc <> rep").select("doc").distinct(), "copies")
    apart = signed.where(f"kind <> {_DOC}").join(small(copies), "doc", "left_anti").select(*signed.columns)
    met = settle(apart.repartition("key").mapInArrow(_shared, _ROWS), "met")
    able = met.groupBy("doc", "kind").agg(F.count("*").alias("n"), F.max("size").alias("need")).where("n >= need").select("doc", "kind")
    left = met.join(able, ["doc", "kind"], "left_semi").select(*met.columns)
    return left.mapInArrow(_starred, _ROWS).repartition("key").mapInArrow(_starred, _ROWS).where(f"kind = {_EDGE}").selectExpr("key AS a", "doc AS b").distinct()


def _need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least intersection of two linked sets of these sizes."""
    return -((-PERCENT * (a + b)) // (100 + PERCENT))


def _ranked(values: np.ndarray, owner: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, int]:
    """Each set's values as ascending ranks, rarest in its cluster first; and the number of ranks. Clusters share none."""
    order = np.lexsort((values, cluster[owner]))
    c, v = cluster[owner][order], values[order]
    new = np.ones(len(v), bool)
    new[1:] = (c[1:] != c[:-1]) | (v[1:] != v[:-1])
    group = np.cumsum(new) - 1
    count = np.bincount(group)
    rank_of = np.empty(len(count), np.int64)
    rank_of[np.lexsort((np.arange(len(count)), count, c[new]))] = np.arange(len(count))
    rank = np.empty(len(values), np.int64)
    rank[order] = rank_of[group]
    return rank[np.lexsort((rank, owner))], len(count)


class Trie:
    """Sets as a prefix tree, kept by levels; below each node lie neighbouring sets.

    ``order`` has the sets sorted by their ranks. ``level`` is walked from the clusters'
    roots on: for each node its first set, the end of its sets, and its value.
    """

    def __init__(self, rank: np.ndarray, bounds: np.ndarray, cluster: np.ndarray, stored: np.ndarray):
        big = rank.astype(">u4").tobytes()
        keys = [(int(cluster[i]), big[4 * bounds[i] : 4 * bounds[i + 1]], int(i)) for i in stored]
        self.order = np.array([k[2] for k in sorted(keys)], np.int64)
        self.rank, self.start, self.size = rank, bounds[self.order], np.diff(bounds)[self.order]
        roots = cluster[self.order]
        self.first = np.flatnonzero(np.concatenate([[True], roots[1:] != roots[:-1]]))
        self.end = np.append(self.first[1:], len(roots))
        self.root = {int(roots[a]): i for i, a in enumerate(self.first)}
        self.most = self._levels()

    def _levels(self) -> list[tuple[np.ndarray, ...]]:
        """For each depth: nodes' first set, end, value, least and greatest size; and where the children of each node of the depth before begin."""
        levels, first, end = [], self.first, self.end
        depth = 0
        while len(first):
            n = end - first
            at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            parent = np.repeat(np.arange(len(first)), n)
            longer = self.size[at] > depth  # a set that ends at its parent has been met there
            at, parent = at[longer], parent[longer]
            value = self.rank[self.start[at] + depth]
            new = np.ones(len(at), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (value[1:] != value[:-1])
            starts = np.flatnonzero(new)
            children = np.searchsorted(parent[starts], np.arange(len(first) + 1))
            if not len(starts):
                levels.append((at, at, value, at, at, children))
                break
            sizes = self.size[at]
            f, e = at[starts], at[np.append(starts[1:], len(at)) - 1] + 1
            levels.append((f, e, value[starts], np.minimum.reduceat(sizes, starts), np.maximum.reduceat(sizes, starts), children))
            first, end, depth = f, e, depth + 1
        return levels


def trie_links(values: np.ndarray, bounds: np.ndarray, cluster: np.ndarray, left: np.ndarray, right: np.ndarray, room: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs of distinct sets, one of ``left`` and one of ``right``, in one cluster.

    Set i is values[bounds[i]:bounds[i + 1]], not empty. ``left`` and ``right`` are masks that
    are equal (each pair comes once) or apart. ``room`` bounds the pairs of walker and node held at a time, about.
    """
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    none = np.zeros(0, np.int64)
    if not (left.any() and right.any()):
        return none, none
    rank, ranks = _ranked(values, owner, cluster)
    trie = Trie(rank, bounds, cluster, np.flatnonzero(right))
    keyed = owner * ranks + rank  # ascending
    alike = bool((left == right).all())
    place = np.full(len(sizes), -1)
    place[trie.order] = np.arange(len(trie.order))
    walkers = np.flatnonzero(left)
    root = np.array([trie.root.get(int(c), -1) for c in cluster[walkers]])
    walkers, root = walkers[root >= 0], root[root >= 0]
    width = np.diff(trie.most[0][5])[root]
    cuts = np.cumsum(width) // room
    found_a, found_b = [none], [none]

    def accept(w: np.ndarray, s: np.ndarray, overlap: np.ndarray) -> None:
        good = (overlap >= _need(sizes[w], trie.size[s])) & (trie.order[s] != w)
        found_a.append(w[good])
        found_b.append(trie.order[s[good]])

    def tails(w: np.ndarray, s: np.ndarray, overlap: np.ndarray, depth: int) -> None:
        """Count what is left of single sets at once."""
        n = trie.size[s] - depth
        for part in np.split(np.arange(len(w)), np.flatnonzero(np.diff(np.cumsum(n) // room)) + 1):
            m = n[part]
            at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(trie.start[s[part]] + depth, m)
            wanted = np.repeat(w[part], m) * ranks + rank[at]
            hit = keyed[np.minimum(np.searchsorted(keyed, wanted), len(keyed) - 1)] == wanted
            sums = np.concatenate([[0], np.cumsum(hit)])
            ends = np.cumsum(m)
            accept(w[part], s[part], overlap[part] + sums[ends] - sums[ends - m])

    for chunk in np.split(np.arange(len(walkers)), np.flatnonzero(np.diff(cuts)) + 1):
        w, node, overlap = walkers[chunk], root[chunk], np.zeros(len(chunk), np.int64)
        for depth, (first, end, value, least, most, children) in enumerate(trie.most, 1):
            n = children[node + 1] - children[node]
            kid = np.repeat(children[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w, overlap = np.repeat(w, n), np.repeat(overlap, n)
            if alike:
                later = end[kid] - 1 > place[w]
                w, overlap, kid = w[later], overlap[later], kid[later]
            if not len(w):
                break
            wanted = w * ranks + value[kid]
            at = np.searchsorted(keyed, wanted, "right")
            overlap = overlap + (keyed[at - 1] == wanted) * (at > 0)
            rest = bounds[w + 1] - np.maximum(at, bounds[w])
            size = np.clip(rest + depth, least[kid], most[kid])
            able = overlap + np.minimum(rest, size - depth) >= _need(sizes[w], size)
            w, overlap, kid = w[able], overlap[able], kid[able]
            single = end[kid] - first[kid] == 1
            whole = single & (most[kid] == depth)
            accept(w[whole], first[kid[whole]], overlap[whole])
            late = single & ~whole & (depth * 5 >= most[kid])
            if late.any():
                tails(w[late], first[kid[late]], overlap[late], depth)
            shared = ~single & (least[kid] == depth)  # the first of several ends here
            accept(w[shared], first[kid[shared]], overlap[shared])
            on = ~whole & ~late
            w, overlap, node = w[on], overlap[on], kid[on]
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    if alike:
        keep = place[b] > place[a]
        a, b = a[keep], b[keep]
    return a, b


def _roots(n: int, a: np.ndarray, b: np.ndarray, name: np.ndarray) -> np.ndarray:
    """For each of n nodes the least name in its component."""
    low = name.copy()
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        where = np.searchsorted(name, low)  # names ascend
        low = low[where]
        if (low == before).all():
            return low


def _joined(group: pa.Table) -> pa.Table:
    names = group.column("rep").to_numpy()
    side = group.column("side").to_numpy()
    order = np.lexsort((side, names))
    order = order[np.concatenate([[True], names[order][1:] != names[order][:-1]])]  # a document that comes twice counts once
    names, side = names[order], side[order]
    held = group.column("items").take(pa.array(order)).to_pylist()
    values = np.frombuffer(b"".join(held), np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(x) // 8 for x in held])])
    clusters, cluster = np.unique(group.column("cluster").to_numpy()[order], return_inverse=True)
    copies = group.column("copies").to_numpy()[order]
    a, b = trie_links(values, bounds, cluster, side != 2, side != 1)
    links = np.bincount(a, copies[b], len(names)) + np.bincount(b, copies[a], len(names))
    root = _roots(len(names), a, b, names)
    return pa.table({"rep": names, "cluster": clusters[cluster], "root": root, "links": links.astype(np.int64)})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = [b""] * batch.num_rows
        for w in words(batch.column(0), SPACED):
            for i, values in shingles(w, K):
                items[i] = values.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(items, pa.binary())], names=[*batch.schema.names[1:], "items"])


#: Documents of a class from which it is broadcast, if they are a thousandth of all, too.
OFTEN = 1000


def _classed(mine: DataFrame, classes: DataFrame, often: int) -> DataFrame:
    """Each document with its class. Classes of ``often`` documents or more, at most a thousand, are broadcast, so that none meets in one task."""
    keys = ["d1", "d2"]
    classes = settle(classes, "sets")
    hot = F.broadcast(classes.where(F.col("copies") >= often))
    rest = mine.join(hot.select(*keys), keys, "left_anti").join(classes.where(F.col("copies") < often), keys, "left")
    return mine.join(hot, keys).unionByName(rest)


def _band(size: str) -> Column:
    """The group of a set's size: linked sets are in one group or in neighbouring ones."""
    lows = F.array(*[F.lit(int(x)) for x in size_groups()[0]])
    return (F.size(F.filter(lows, lambda low: low <= F.col(size))) - 1).cast("long")


def _bands(members: DataFrame) -> DataFrame:
    """Of clusters beyond TILE n-grams, for each band its tiles, and those of the band above and of the one below."""
    large = small(settle(members.groupBy("cluster").agg(F.sum("size").alias("load")).where(F.col("load") > TILE).select("cluster"), "large"))
    bands = members.join(large, "cluster").groupBy("cluster", _band("size").alias("band")).agg((F.floor(F.sum("size") / TILE) + 1).cast("long").alias("tiles"))
    order = Window.partitionBy("cluster").orderBy("band").rangeBetween
    return settle(bands.select("*", F.coalesce(F.sum("tiles").over(order(1, 1)), F.lit(0)).alias("above"), F.coalesce(F.sum("tiles").over(order(-1, -1)), F.lit(0)).alias("below")), "bands")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of ``docs``.

    component_id is the least doc_id that links reach, the document itself included; n_links
    counts the linked documents, copies of its own set included.
    """
    docs = id_text(docs)
    signed = settle(docs.mapInArrow(_signed, _ROWS).repartition("key").mapInArrow(_shared, _ROWS), "signed")
    mine = signed.where(f"kind = {_DOC}").selectExpr("doc", "size", "d1", "d2")
    classes = mine.where("size > 0 AND doc IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc").alias("rep"), F.countDistinct("doc").alias("copies"))
    often = max(OFTEN, mine.count() // 1000)
    known = settle(_classed(mine, classes, often).select("doc", "size", "rep", "copies"), "classes")
    clusters = connected(_edges(signed, known)).selectExpr("node AS rep", "component AS cluster")
    members = settle(known.where("doc = rep").select("rep", "size", "copies").distinct().join(clusters, "rep"), "members")
    plan = _bands(members)
    cut = plan.limit(1).count() > 0
    whole = members.join(small(plan.select("cluster").distinct()), "cluster", "left_anti") if cut else members
    batches = int(2 * (whole.agg(F.sum("size")).first()[0] or 0) // TILE + 1)
    wanted = members.withColumn("band", _band("size")).join(small(plan), ["cluster", "band"], "left").select("rep", "cluster", "copies", "band", "tiles", "above", "below")
    wanted = F.broadcast(wanted) if members.count() <= BROADCAST_ROWS else wanted
    sets = docs.join(wanted, docs["doc_id"] == wanted["rep"]).select("text", *wanted.columns)
    sets = sets.mapInArrow(_sets, "rep long, cluster long, copies long, band long, tiles long, above long, below long, items binary")
    met_in = F.expr(f"""CASE WHEN tiles IS NULL THEN array(named_struct('unit', pmod(xxhash64(cluster), {batches}L), 'side', 0)) ELSE concat(
        transform(sequence(0L, tiles - 1), q -> named_struct('unit', xxhash64(cluster, band, least(p, q), band, greatest(p, q)), 'side', CASE WHEN p = q THEN 0 WHEN p < q THEN 1 ELSE 2 END)),
        transform(slice(sequence(0L, above), 1, int(above)), q -> named_struct('unit', xxhash64(cluster, band, p, band + 1, q), 'side', 1)),
        transform(slice(sequence(0L, below), 1, int(below)), q -> named_struct('unit', xxhash64(cluster, band - 1, q, band, p), 'side', 2))) END""")
    tiled = sets.withColumn("p", F.expr("pmod(xxhash64(rep), tiles)")).select(F.explode(met_in).alias("at"), "rep", "cluster", "copies", "items").select("at.unit", "rep", "cluster", "copies", "items", "at.side")
    met = settle(tiled.groupBy("unit").applyInArrow(_joined, "rep long, cluster long, root long, links long"), "links")
    linked = met.groupBy("rep").agg(F.min("root").alias("root"), F.sum("links").alias("links"))
    if cut:
        across = connected(met.selectExpr("rep AS a", "root AS b")).selectExpr("node AS rep", "component")
        linked = linked.join(across, "rep", "left").selectExpr("rep", "coalesce(component, root) AS root", "links")
    crowded = known.where(F.col("copies") >= often)  # again, no large class meets in one task
    few = F.broadcast(linked.join(F.broadcast(crowded.select("rep").distinct()), "rep", "left_semi"))
    rest = known.where(F.coalesce(F.col("copies") < often, F.lit(True)))
    return crowded.join(few, "rep", "left").unionByName(rest.join(linked, "rep", "left")).selectExpr("doc AS doc_id", "size AS n_shingles", "coalesce(root, rep, doc) AS component_id", "coalesce(links, 0) + coalesce(copies, 1) - 1 AS n_links")


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one with the least doc_id. Rows without doc_id stay."""
    gone = settle(join(docs).where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
