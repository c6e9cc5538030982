"""The change feed: stored versions from cold segments, then latest states from the change index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, Segment, Snapshot
from ..model import DELETE, DELETED, OP, SEQ, TierError, need_scope
from ..plans.merge import Reader

COLUMNS = ("seq", "op", "pk", "deleted", "row_image", "source")


class RetentionGap(TierError):
    """The cursor lies before what is still kept."""

    def __init__(self, oldest: int):
        super().__init__(f"changes before seq {oldest} are no longer available")
        self.oldest_available = oldest


def _halves(reader: Reader, after: int, scope: str | None, rows: int | None) -> tuple[DataFrame, DataFrame]:
    """Cold and hot changes after a cursor; with ``rows``, those up to the end of a page of so many at least, from the segments that it needs."""
    snapshot = reader.snapshot
    names = snapshot.schema().names
    mine = F.lit(True) if scope is None else F.col(snapshot.options.scope_column).cast("string") == scope
    key = F.to_json(F.struct(*snapshot.pk)).alias("pk")
    segments = [s for s in snapshot.active if s.max_seq > after]
    edge = _edge(segments, after, rows) if rows is not None and scope is None else None
    segments = sorted((s for s in segments if edge is None or s.min_seq <= edge), key=lambda s: (s.min_seq, s.max_seq, s.path))
    inside = F.col("seq") > after if edge is None else F.col("seq").between(after + 1, edge)
    image = F.when(~F.col(DELETED), F.to_json(F.struct(*names))).alias("row_image")
    cold = reader.cold(segments).where(mine).select(F.col(SEQ).alias("seq"), F.col(OP).alias("op"), key, F.col(DELETED).alias("deleted"), image, F.lit("cold").alias("source"))
    hot = reader.index().where(mine).select(F.col(SEQ).alias("seq"), F.col(OP).alias("op"), key, (F.col(OP) == DELETE).alias("deleted"), F.lit(None).cast("string").alias("row_image"), F.lit("hot").alias("source"))
    return cold.where(inside), hot.where(inside)


def _edge(segments: list[Segment], after: int, rows: int) -> int | None:
    """A seq below which segments alone fill a page of ``rows`` after a cursor; None if they don't."""
    seen = 0
    for s in sorted(segments, key=lambda s: s.max_seq):
        seen += s.rows if s.min_seq > after else 0
        if seen >= rows:
            return s.max_seq
    return None


def oldest(reader: Reader) -> int | None:
    """The least seq that is kept."""
    cold = [s.min_seq for s in reader.snapshot.active]
    hot = reader.index().agg(F.min(SEQ)).first()[0] if reader.snapshot.index else None
    return min([*cold, *([] if hot is None else [hot])], default=None)


def changes_since(catalog: Catalog, snapshot: Snapshot, since_seq: int = 0, limit_rows: int = 1000, last_rows: int | None = None, scope: str | None = None) -> DataFrame:
    """Up to ``limit_rows`` changes after a cursor in rising seq; or the newest ``last_rows``, if there is no cursor."""
    if since_seq < 0:
        raise TierError("since_seq must not be negative")
    if limit_rows <= 0:
        raise TierError("limit_rows must be positive")
    if last_rows is not None and not 0 < last_rows <= limit_rows:
        raise TierError("last_rows must be positive and at most limit_rows")
    if snapshot.kind == "user":
        scope = need_scope(scope)
        if snapshot.options.scope_column not in snapshot.pk:
            raise TierError("a change feed by scope needs the scope column in the key")
    else:
        scope = None
    reader = Reader(catalog, snapshot)
    if since_seq > 0:
        least = oldest(reader)
        if least is not None and since_seq < least - 1:
            raise RetentionGap(least)
    newest = last_rows is not None and since_seq == 0
    cold, hot = _halves(reader, since_seq, scope, None if newest else limit_rows)
    both = cold.unionByName(hot)
    if newest:
        return both.orderBy(F.col("seq").desc(), "pk").limit(last_rows).orderBy("seq", "pk")
    return both.orderBy("seq", "pk").limit(limit_rows)
