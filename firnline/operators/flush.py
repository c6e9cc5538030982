"""Flush: the oldest changed rows become immutable Parquet segments.

Order that every failure leaves intact: files are durable, then listed as active, then hot rows
and change-index rows are dropped, all three in one catalog version. A row never leaves the
hot store before its cold copy can be read.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import ATTEMPTS, DELTA, Catalog, Conflict, Segment, Snapshot, freeze
from ..model import DELETE, DELETED, FORCE_TOMBSTONES_ONLY, OP, ORDERABLE, SEQ, VERSION, RowLimit
from ..plans.merge import Reader

FOLDER = 100  # segments in a folder
#: How long a running job may be silent before another caller may take over.
LEASE = dt.timedelta(minutes=30)
#: Ranges that a search for a rank counts at once, and values of one range that are looked at themselves.
RANGES, FEW = 1024, 10_000

#: Delta pieces, and hot pieces, beyond which a change writes the hot side anew as one piece.
MOST_DELTAS, MOST_PIECES = 16, 64
#: Bytes up to which the hot side is written anew at once, as that costs no more than a delta and reads stay plain.
SMALL = 32 << 20

#: Test hook: functions to call at named points of a flush.
FAILPOINTS: dict[str, object] = {}


def _point(name: str) -> None:
    hook = FAILPOINTS.get(name)
    if hook:
        hook()


def _count(index: DataFrame) -> tuple[int, int]:
    """Rows, and tombstones among them."""
    return tuple(index.agg(F.count("*"), F.count(F.when(F.col(OP) == DELETE, 1))).first())


def nth(rows: DataFrame, n: int) -> int | None:
    """The n-th smallest seq, by counts of ranges that are narrowed down: no sort, and at most FEW values reach the driver."""
    low, high, total = rows.agg(F.min(SEQ), F.max(SEQ), F.count("*")).first()
    if total < n:
        return None
    inside = rows
    while total > FEW and low < high:
        step = (high - low) // RANGES + 1
        counts = dict(inside.groupBy(F.expr(f"({SEQ} - {low}) div {step}").alias("r")).agg(F.count("*").alias("k")).collect())
        for r in sorted(counts):
            if counts[r] >= n:
                break
            n -= counts[r]
        low, high, total = low + r * step, min(high, low + (r + 1) * step - 1), counts[r]
        inside = rows.where(F.col(SEQ).between(low, high))
    return low if low == high else sorted(r[0] for r in inside.select(SEQ).collect())[n - 1]


def select(reader: Reader, force: bool, now: dt.datetime | None) -> tuple[DataFrame, int, int, bool]:
    """Change-index rows to flush, how many they are, tombstones among them, and whether they are all."""
    index, policy = reader.index(), reader.snapshot.options.policy
    total, gone = _count(index)
    if force:
        if 0 < gone <= FORCE_TOMBSTONES_ONLY:
            return index.where(F.col(OP) == DELETE), gone, gone, gone == total
        return index, total, gone, True
    if isinstance(policy, RowLimit):
        rows, pool = policy.rows_to_flush(total), index
    else:
        pool = index.where(F.col(SEQ) < policy.cut(now or dt.datetime.now(dt.UTC)))
        rows = policy.rows_to_flush(pool.count())
    if not rows:
        return index.limit(0), 0, 0, False
    picked = pool.where(F.col(SEQ) <= nth(pool, rows))
    return picked, *_count(picked), False


def rows_of(reader: Reader, picked: DataFrame) -> DataFrame:
    """What a segment stores: images of live rows; of deleted ones the key alone."""
    snapshot = reader.snapshot
    names = snapshot.schema().names
    joined = picked.join(reader.hot().drop(SEQ), snapshot.pk, "left")
    gone = F.col(OP) == DELETE
    return joined.select(*[F.col(n) if n in snapshot.pk else F.when(~gone, F.col(n)).alias(n) for n in names], SEQ, F.col(OP).cast("short").alias(OP), gone.alias(DELETED), F.lit(snapshot.schema_version).alias(VERSION))


def bounded(snapshot: Snapshot) -> list[tuple[int, str]]:
    """Columns whose bounds a segment keeps."""
    return [(i, n) for i, n, t in snapshot.columns() if isinstance(t, ORDERABLE)]


def describe(catalog: Catalog, snapshot: Snapshot, paths: list[str], batch: int) -> list[Segment]:
    """Counts and bounds of new files, by one pass of Spark over just these."""
    df = catalog.spark.read.parquet(*[catalog.store.full(p) for p in paths])
    columns, pk = bounded(snapshot), snapshot.pk
    whole = all(isinstance(t, (*ORDERABLE, T.StringType)) for _, n, t in snapshot.columns() if n in pk)
    measures = [F.min(F.struct(*pk)).alias("first"), F.max(F.struct(*pk)).alias("last"),F.count("*").alias("rows"), F.sum(F.col(DELETED).cast("long")).alias("deletes"), F.min(SEQ).alias("lo"), F.max(SEQ).alias("hi"), F.first("_metadata.file_size").alias("bytes")]
    for i, n in columns:
        measures += [F.min(n).alias(f"a{i}"), F.max(n).alias(f"z{i}"), F.sum(F.col(n).isNull().cast("long")).alias(f"n{i}")]
    known = {}
    for r in df.select("*", "_metadata").groupBy(F.col("_metadata.file_name").alias("f")).agg(*measures).collect():
        known[r["f"]] = r
    out = []
    for p in paths:
        r = known.get(p.rsplit("/", 1)[1])
        if r is None:  # a file without rows
            catalog.store.delete(p)
            continue
        bounds = {i: (r[f"a{i}"], r[f"z{i}"], r[f"n{i}"]) for i, _ in columns}
        out.append(Segment(p, r["rows"], r["deletes"], r["bytes"], r["lo"], r["hi"], snapshot.schema_version, batch, bounds, created_at=dt.datetime.now(dt.UTC).isoformat(), keys=(tuple(r["first"]), tuple(r["last"])) if whole else None))
    return out


def write(catalog: Catalog, snapshot: Snapshot, rows: DataFrame, n: int, batch: int) -> list[Segment]:
    """Write sorted segments to a staging folder, move them to their final names, and check the count."""
    options = snapshot.options
    by = [options.order_column, *snapshot.pk] if options.order_column else snapshot.pk
    per_file = max(1, options.policy.max_rows_per_file)
    files = max(1, -(-n // per_file))
    staging = f"cold/_staging/{uuid.uuid4().hex}"
    writer = rows.repartitionByRange(files, *by).sortWithinPartitions(*by).write.option("maxRecordsPerFile", per_file).option("compression", options.compression)
    for c in dict.fromkeys([*snapshot.pk, *options.bloom_columns]):  # the key always, for lookups
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(per_file))
    writer.parquet(catalog.store.full(staging))
    _point("staged")
    start = len(snapshot.segments)
    paths = []
    for k, name in enumerate(x for x in catalog.store.names(staging) if x.startswith("part-")):
        number = start + k + 1
        final = f"cold/{(number - 1) // FOLDER + 1:03d}/segment-{number:04d}-{uuid.uuid4().hex[:8]}.parquet"
        catalog.store.move(f"{staging}/{name}", final)
        paths.append(final)
    catalog.store.delete(staging)
    _point("published")
    segments = describe(catalog, snapshot, paths, batch)
    if sum(s.rows for s in segments) != n:
        raise RuntimeError(f"wrote {sum(s.rows for s in segments)} rows of {n}")
    return [s for s in segments if s.rows]


def cold_may_hold(snapshot: Snapshot, keys: DataFrame) -> DataFrame:
    """The keys that bounds do not rule out of every segment; a tombstone of any other need not be kept."""
    first = snapshot.id_of(snapshot.pk[0])
    spans = [s.bounds.get(first, (None, None, 0))[:2] for s in snapshot.active]
    if any(a is None for a, _ in spans):
        return keys
    if not spans:
        return keys.limit(0)
    low, high = min(a for a, _ in spans), max(b for _, b in spans)
    inside = F.col(snapshot.pk[0]).between(low, high)
    if len(spans) <= 200:
        inside = reduce(lambda x, y: x | y, [F.col(snapshot.pk[0]).between(a, b) for a, b in spans])
    return keys.where(inside)


def keep(catalog: Catalog, draft: dict, hot: DataFrame | None, index: DataFrame | None, schema_version: int) -> None:
    """Write whole new hot and change-index pieces and name them in ``draft``."""
    mark = uuid.uuid4().hex[:12]
    if hot is not None:
        hot.write.parquet(catalog.store.full(f"hot/{mark}"))
        draft["hot"] = [{"path": f"hot/{mark}", "schema_version": schema_version}]
    if index is not None:
        index.write.parquet(catalog.store.full(f"index/{mark}"))
        draft["index"] = [f"index/{mark}"]


def add(catalog: Catalog, draft: dict, hot: DataFrame | None, index: DataFrame, schema_version: int, delta: bool) -> None:
    """Add a hot and a change-index piece to those in ``draft``; ``delta`` if their keys may be in older ones.

    What a change writes grows with the change, not with what is hot. Only when very many pieces have gathered are they written as one.
    """
    held = Snapshot(draft)
    if delta and sum(catalog.store.total(p) for p in [*(h["path"] for h in held.hot), *held.index]) <= SMALL:
        reader, keys = Reader(catalog, held), index.select(*held.pk)
        rest = reader.hot().join(keys, held.pk, "left_anti")
        keep(catalog, draft, rest if hot is None else rest.unionByName(hot), reader.index().join(keys, held.pk, "left_anti").unionByName(index), schema_version)
        return
    mark = uuid.uuid4().hex[:12]
    if hot is not None:
        hot.write.parquet(catalog.store.full(f"hot/{mark}"))
        draft["hot"].append({"path": f"hot/{mark}", "schema_version": schema_version})
    piece = f"{DELTA}{mark}" if delta else f"index/{mark}"
    index.write.parquet(catalog.store.full(piece))
    draft["index"].append(piece)
    now = Snapshot(draft)
    if len(now.deltas) > MOST_DELTAS or len(now.hot) > MOST_PIECES:
        reader = Reader(catalog, now)
        keep(catalog, draft, reader.hot(), reader.index(), schema_version)


def busy(job: dict, now: dt.datetime | None = None) -> bool:
    """Whether a job is running under a lease that holds; one whose lease has ended may be taken over."""
    return job["status"] == "running" and dt.datetime.fromisoformat(job["lease_until"]) > (now or dt.datetime.now(dt.UTC))


def claim(catalog: Catalog, rows: int) -> dict | None:
    """The flush job that this caller runs: the oldest pending one or a new one. None while another holds a lease. Jobs without one have failed."""

    def change(held: Snapshot, draft: dict) -> dict | None:
        now = dt.datetime.now(dt.UTC)
        mine = [j for j in draft["jobs"] if j["type"] == "flush"]
        if any(busy(j, now) for j in mine):
            return None
        for j in mine:
            if j["status"] == "running":
                j.update(status="failed", error="its lease ended", finished_at=now.isoformat())
        job = next((j for j in mine if j["status"] == "pending"), None)
        if job is None:
            job = {"id": uuid.uuid4().hex, "type": "flush", "created_at": now.isoformat(), "error": None}
            draft["jobs"].append(job)
        job.update(status="running", rows=rows, token=uuid.uuid4().hex, lease_until=(now + LEASE).isoformat())
        return dict(job)

    return catalog.update(change)


def _mine(draft: dict, job: dict) -> dict:
    """The job's entry, if it is still this caller's."""
    held = next((j for j in draft["jobs"] if j["id"] == job["id"]), None)
    if held is None or held["status"] != "running" or held["token"] != job["token"]:
        raise Lost(f"flush job {job['id']} was cancelled or taken over")
    return held


class Lost(RuntimeError):
    """A job that this caller ran is not its own any more."""


def finish(catalog: Catalog, job: dict, status: str, error: str | None, rows: int | None = None) -> None:
    def change(held: Snapshot, draft: dict) -> bool:
        _mine(draft, job).update(status=status, error=error, finished_at=dt.datetime.now(dt.UTC).isoformat(), **({} if rows is None else {"rows": rows}))
        return True

    catalog.update(change)


def _without(catalog: Catalog, snapshot: Snapshot, flushed: DataFrame) -> tuple[list, list]:
    """Hot and change-index pieces of a snapshot without the flushed (key, seq) pairs, written anew."""
    reader, draft, key = Reader(catalog, snapshot), snapshot.draft(), [*snapshot.pk, SEQ]
    keep(catalog, draft, reader.hot().join(flushed, key, "left_anti"), reader.index().join(flushed, key, "left_anti"), snapshot.schema_version)
    return draft["hot"], draft["index"]


def _activate(catalog: Catalog, snapshot: Snapshot, job: dict, segments: list[Segment], batch: int, flushed: DataFrame, rows: int, everything: bool) -> None:
    """Segments become active and flushed pairs leave the hot side, in one version, whatever has changed since ``snapshot``.

    Only the very (key, seq) pairs that were flushed leave: a later change has a higher seq. Pieces that were appended since can't
    hold any, so that as long as changes only append, another attempt costs one small file.
    """
    left: tuple[list, list] | None = ([], []) if everything else None
    for _ in range(ATTEMPTS):
        held = catalog.load()
        draft = held.draft()
        _mine(draft, job).update(status="completed", error=None, rows=rows, finished_at=dt.datetime.now(dt.UTC).isoformat())
        appended = held.hot[: len(snapshot.hot)] == snapshot.hot and held.index[: len(snapshot.index)] == snapshot.index and held.schema_version == snapshot.schema_version
        if appended:
            left = left or _without(catalog, snapshot, flushed)
            draft["hot"], draft["index"] = left[0] + held.hot[len(snapshot.hot) :], left[1] + held.index[len(snapshot.index) :]
        else:
            draft["hot"], draft["index"] = _without(catalog, held, flushed)
        draft["segments"] += [s.to_json() for s in segments]
        draft["next_batch"] = max(batch + 1, held.held["next_batch"])
        try:
            catalog.publish(draft, held.version)
            return
        except Conflict:
            continue
    raise Conflict(f"{ATTEMPTS} attempts were overtaken")


def flush(catalog: Catalog, force: bool = False, now: dt.datetime | None = None) -> dict:
    """One flush pass under a job of the catalog; a waiting job is taken up. Changes may go on meanwhile."""
    snapshot = catalog.load()
    jobs = [j for j in snapshot.held["jobs"] if j["type"] == "flush"]
    if any(map(busy, jobs)):
        return {"ok": False, "status": "busy", "rows": 0}
    picked, n, gone, everything = select(Reader(catalog, snapshot), force, now)
    if not n and not any(j["status"] == "pending" for j in jobs):
        return {"ok": True, "status": "nothing_to_flush", "job_id": None, "rows": 0, "segments": 0}
    job = claim(catalog, n)
    if job is None:
        return {"ok": False, "status": "busy", "rows": 0}
    try:
        if not n:
            finish(catalog, job, "completed", None, 0)
            return {"ok": True, "status": "nothing_to_flush", "job_id": job["id"], "rows": 0, "segments": 0}
        batch, reader = snapshot.held["next_batch"], Reader(catalog, snapshot)
        count, live = n - gone, picked.where(F.col(OP) != DELETE)
        if gone:
            needed = cold_may_hold(snapshot, picked.where(F.col(OP) == DELETE))
            count, live = count + needed.count(), live.unionByName(needed)
        segments = write(catalog, snapshot, rows_of(reader, live), count, batch) if count else []
        _point("before_activate")
        _activate(catalog, snapshot, job, segments, batch, picked.select(*snapshot.pk, SEQ), n, everything and reader.hot().count() == n - gone)
    except Exception as e:
        try:
            finish(catalog, job, "failed", str(e)[:500])
        except Lost:
            pass
        raise
    return {"ok": True, "status": "completed", "job_id": job["id"], "rows": n, "segments": len(segments)}


def flush_due(snapshot: Snapshot, pending: int) -> bool:
    """Whether the policy of a table would flush now; of use to a scheduler."""
    policy = snapshot.options.policy
    return snapshot.options.auto_flush and isinstance(policy, RowLimit) and policy.rows_to_flush(pending) > 0




def frozen_bounds(segment: Segment) -> dict:
    """A segment's bounds as JSON."""
    return {str(k): [freeze(a), freeze(b), n] for k, (a, b, n) in segment.bounds.items()}
