"""The latest state of a tiered table as one DataFrame.

    cold     = candidate segments, key predicates pushed into the scan
    newest   = row_number over the key by descending seq, among segments that overlap in keys; the others as they are
    masked   = newest without deletes, anti-joined with hot keys and tombstones of the change index
    result   = hot rows + masked, then every predicate

Updates, deletes and captured batches add small pieces instead of rewriting what is hot: a hot row or an entry of the change index
counts unless a delta piece holds a later change of its key.

The deduplication precedes the drop of deletes: a cold tombstone must beat older cold versions.
Join strategies are left to the optimizer, as hot keys may be few or many.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog, Segment, Snapshot
from ..model import DELETE, DELETED, OP, SEQ
from .prune import Filter, candidates, filters_of, keys_apart, overall, overlapping

#: Ordered keys of hot rows that the driver looks at to choose segments.
MOST_ORDERED = 10_000


@dataclass
class Report:
    """How a scan was answered."""

    strategy: str
    path: str = ""
    considered: int = 0
    opened: int = 0
    files: list[str] = field(default_factory=list)
    deduplicated: bool = False
    overlapping: int = 0

    @property
    def pruned(self) -> int:
        return self.considered - self.opened


def strategy_of(snapshot: Snapshot, filters: list[Filter], order_by: list[tuple[str, bool]], limit: int | None) -> str:
    if {f.column for f in filters if f.op == "="} >= set(snapshot.pk):
        return "exact_primary_key"
    if order_by and limit is not None:
        return "ordered_progressive"
    return "unordered_hot_first" if limit is not None else "general_merge"


class Reader:
    """Reads the pieces of one snapshot."""

    def __init__(self, catalog: Catalog, snapshot: Snapshot):
        self.catalog, self.snapshot, self.spark = catalog, snapshot, catalog.spark

    def _files(self, groups: dict[int, list[str]], meta: T.StructType) -> DataFrame:
        """Files by schema version, each column found by its id: renamed ones under their new name, later ones as null."""
        now, parts = self.snapshot.columns(), []
        for version, names in sorted(groups.items()):
            then = {i: (n, t) for i, n, t in self.snapshot.columns(version)}
            physical = T.StructType([*(T.StructField(n, t) for n, t in then.values()), *meta])
            df = self.spark.read.schema(physical).parquet(*[self.catalog.store.full(n) for n in names])
            parts.append(df.select(*[(F.col(then[i][0]) if i in then else F.lit(None)).cast(t).alias(n) for i, n, t in now], *meta.names))
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*self.snapshot.schema(), *meta]))
        return reduce(DataFrame.unionByName, parts)

    def _superseded(self, rows: DataFrame) -> DataFrame:
        """Rows without those that a later change of their key, in a delta piece, has replaced or deleted."""
        if not self.snapshot.deltas:
            return rows
        pk = self.snapshot.pk
        later = self._index(self.snapshot.deltas).select(*[F.col(k).alias(f"_d_{k}") for k in pk], F.col(SEQ).alias("_d_seq"))
        same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_d_{k}") for k in pk])
        return rows.join(later, same & (F.col(SEQ) < F.col("_d_seq")), "left_anti")

    def hot(self) -> DataFrame:
        """The latest row of each hot key."""
        groups = defaultdict(list)
        for piece in self.snapshot.hot:
            groups[piece["schema_version"]].append(piece["path"])
        return self._superseded(self._files(groups, T.StructType([T.StructField(SEQ, T.LongType())])))

    def cold(self, segments: list[Segment]) -> DataFrame:
        """Every stored version in these segments."""
        groups = defaultdict(list)
        for s in segments:
            groups[s.schema_version].append(s.path)
        return self._files(groups, T.StructType([T.StructField(SEQ, T.LongType()), T.StructField(OP, T.ShortType()), T.StructField(DELETED, T.BooleanType())]))

    def index(self) -> DataFrame:
        """The change index: key, seq, op of the latest change of each key that is not flushed."""
        return self._superseded(self._index(self.snapshot.index))

    def _index(self, pieces: list[str]) -> DataFrame:
        kinds = {n: t for _, n, t in self.snapshot.columns()}
        schema = T.StructType([*(T.StructField(k, kinds[k]) for k in self.snapshot.pk), T.StructField(SEQ, T.LongType()), T.StructField(OP, T.ShortType())])
        if not pieces:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.catalog.store.full(p) for p in pieces])

    def merged(self, segments: list[Segment], filters: list[Filter], report: Report | None = None, keep_seq: bool = False) -> DataFrame:
        """Hot rows and the cold winners of ``segments``; filters on key columns are applied to both sides first."""
        pk, names = self.snapshot.pk, self.snapshot.schema().names + ([SEQ] if keep_seq else [])
        safe = [f.expression() for f in filters if f.column in pk]
        where = lambda df: reduce(DataFrame.where, safe, df)
        hot = where(self.hot())
        if not segments:
            return hot.select(*names)
        alone, shared = overlapping(segments)
        cold = where(self.cold(alone)) if alone else None
        if shared:
            newest = Window.partitionBy(*pk).orderBy(F.col(SEQ).desc())
            last = where(self.cold(shared)).withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")
            cold = last if cold is None else cold.unionByName(last)
        if report is not None:
            report.deduplicated, report.overlapping = bool(shared), len(shared)
        mask = hot.select(*pk).unionByName(where(self.index()).where(F.col(OP) == DELETE).select(*pk))
        return hot.select(*names).unionByName(cold.where(~F.col(DELETED)).join(mask, pk, "left_anti").select(*names))


def _ordering(order_by: list[tuple[str, bool]], pk: list[str]) -> list[Column]:
    """NULLs come last upwards and first downwards; the key breaks ties."""
    out = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_first() for c, up in order_by]
    return out + [F.col(k).asc_nulls_last() for k in pk if k not in {c for c, _ in order_by}]


def _competitive(reader: Reader, segments: list[Segment], filters: list[Filter], column: str, up: bool, limit: int) -> list[Segment]:
    """Segments that may hold one of the first ``limit`` rows. Ties and unknown bounds are kept."""
    snapshot = reader.snapshot
    if limit > MOST_ORDERED or not keys_apart(segments):
        return segments
    at = snapshot.id_of(column)
    low = lambda s: s.bounds.get(at, (None, None, 0))
    hot = reduce(DataFrame.where, [f.expression() for f in filters], reader.hot())
    if column in snapshot.pk or not any(s.deletes for s in segments):
        hot_keys = [r[0] for r in hot.orderBy(*_ordering([(column, up)], [])).select(column).limit(limit).collect()]
    else:
        return segments
    edge = None
    if len(hot_keys) == limit and hot_keys[-1] is not None:
        edge = hot_keys[-1]
    unfiltered = not filters and all(low(s)[0] is not None and low(s)[1] is not None and not low(s)[2] for s in segments)
    if unfiltered:  # the nearest segments alone may fill the limit, whatever masks take from them
        lost, seen = reader.hot().count() + reader.index().count(), 0
        for s in sorted(segments, key=lambda s: low(s)[1], reverse=False) if up else sorted(segments, key=lambda s: low(s)[0], reverse=True):
            seen += s.rows - s.deletes
            if seen >= limit + lost:
                reach = low(s)[1] if up else low(s)[0]
                edge = reach if edge is None else (min(edge, reach) if up else max(edge, reach))
                break
    if edge is None:
        return segments
    return [s for s in segments if low(s)[2] or low(s)[0] is None or low(s)[1] is None or (low(s)[0] <= edge if up else low(s)[1] >= edge)]


def scan(catalog: Catalog, snapshot: Snapshot, filters=None, where: str | None = None, columns: list[str] | None = None, order_by=None, limit: int | None = None, late: bool = False, rule: Column | None = None) -> tuple[DataFrame, Report]:
    """The merged rows that pass ``rule``, ``filters`` and ``where``, in order and up to ``limit`` if asked for.

    ``rule`` is row security: a filter of its own ahead of the others, so that no text in ``where`` can widen it.
    ``order_by`` has (column, ascending) pairs. ``late`` picks the rows on narrow columns first and
    fetches the others for those alone.
    """
    filters, order_by = filters_of(filters), list(order_by or [])
    reader, report = Reader(catalog, snapshot), Report(strategy_of(snapshot, filters, order_by, limit))
    tests = ([] if rule is None else [rule]) + [f.expression() for f in filters] + ([F.expr(where)] if where else [])
    passing = lambda df: reduce(DataFrame.where, tests, df)
    report.considered = len(snapshot.active)
    segments = candidates(snapshot, filters)
    report.path = "merge_stream" if segments else "hot_native"

    def done(df: DataFrame, opened: list[Segment], keep: list[str] | None = None) -> tuple[DataFrame, Report]:
        report.opened, report.files = len(opened), [s.path for s in opened]
        if order_by:
            df = df.orderBy(*_ordering(order_by, snapshot.pk))
        if limit is not None:
            df = df.limit(limit)
        return df.select(*(columns or snapshot.schema().names)), report

    hot = passing(reader.hot())
    if report.strategy == "exact_primary_key" and segments:
        key = reduce(DataFrame.where, [f.expression() for f in filters if f.column in snapshot.pk], reader.hot())
        gone = reduce(DataFrame.where, [f.expression() for f in filters if f.column in snapshot.pk], reader.index()).where(F.col(OP) == DELETE)
        if key.limit(1).count() or gone.limit(1).count():
            report.path = "hot_native"
            return done(hot, [])
    elif report.strategy == "unordered_hot_first" and segments:
        if hot.limit(limit).count() >= limit:
            report.path = "unordered_hot_first"
            return done(hot, [])
    elif report.strategy == "ordered_progressive" and segments:
        column, up = order_by[0]
        near = _competitive(reader, segments, filters, column, up, limit) if not where and rule is None else segments
        report.path = "ordered_merge_native" if near else "hot_native"
        if late:
            narrow = list(dict.fromkeys([*snapshot.pk, *(c for c, _ in order_by)]))
            top = passing(reader.merged(near, filters, report, keep_seq=True)).select(*narrow, SEQ).orderBy(*_ordering(order_by, snapshot.pk)).limit(limit).select(*snapshot.pk, SEQ)
            wide = reader.merged(near, filters, keep_seq=True).join(F.broadcast(top) if limit <= MOST_ORDERED else top, [*snapshot.pk, SEQ], "left_semi")
            return done(wide, near)
        return done(passing(reader.merged(near, filters, report)), near)
    return done(passing(reader.merged(segments, filters, report)), segments)


def cold_proven_empty(snapshot: Snapshot, filters) -> bool:
    """Whether bounds alone show that no cold row passes."""
    return not candidates(snapshot, filters_of(filters))


def cold_best(snapshot: Snapshot, column: str, up: bool):
    """The best bound of cold rows in an order; None if it isn't known."""
    held = overall(snapshot.active, snapshot.id_of(column))
    return held if held is None else held[0 if up else 1]
