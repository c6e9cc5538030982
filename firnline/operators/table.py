"""A tiered table: registration, changes, reads, flush and schema evolution."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import ATTEMPTS, Catalog, Conflict, Snapshot
from ..model import DELETE, INSERT, OP, ORDERABLE, SEQ, UPDATE, Options, SequenceIds, TierError, check_type, need_scope
from ..plans import merge
from ..plans.prune import Filter, filters_of
from . import care, feed
from . import flush as flushing

_IDS = SequenceIds()


def validate(schema: T.StructType, pk: list[str], kind: str, options: Options) -> None:
    """Refuse what cannot be managed."""
    names = schema.names
    if not pk:
        raise TierError("a tiered table needs a primary key")
    for c in pk:
        if c not in names:
            raise TierError(f"primary key column {c!r} is missing")
    for f in schema:
        check_type(f.name, f.dataType)
        if f.name.startswith("_"):
            raise TierError(f"column names beginning with _ are reserved: {f.name!r}")
    if kind not in ("shared", "user"):
        raise TierError(f"unknown table kind {kind!r}")
    if kind == "user" and options.scope_column not in names:
        raise TierError("a user table needs a scope column")
    order = options.order_column
    if order is not None and (order not in names or not isinstance(schema[order].dataType, ORDERABLE)):
        raise TierError(f"{order!r} can't order segments")


class TieredTable:
    """A handle on the newest snapshot; each call resolves one version."""

    def __init__(self, spark: SparkSession, root: str, scope: str | None = None, rule: str | None = None):
        self.spark, self.catalog, self.scope, self.rule = spark, Catalog(spark, root), scope, rule
        self.report: merge.Report | None = None

    # registration

    @classmethod
    def manage(cls, spark: SparkSession, root: str, name: str, schema: T.StructType, pk: list[str], options: Options, kind: str = "shared", rows: DataFrame | None = None) -> TieredTable:
        """Register an empty table, or one whose rows are ``rows``: unique, non-null keys, backfilled as inserts, oldest key first."""
        validate(schema, pk, kind, options)
        table = cls(spark, root)
        if table.catalog.versions():
            raise TierError(f"{name} is already managed")
        if rows is not None:
            nulls = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in pk])
            if rows.where(nulls).limit(1).count() or rows.groupBy(*pk).count().where("count > 1").limit(1).count():
                raise TierError("primary key columns hold nulls or repeated values")
        table.catalog.create(name, schema, pk, kind, options)
        if rows is not None:
            table._apply(rows, INSERT, None, check=False)
        return table

    def in_scope(self, scope: str | None) -> TieredTable:
        """The same table with an active scope."""
        return TieredTable(self.spark, self.catalog.store.root, scope, self.rule)

    def guarded(self, rule: str) -> TieredTable:
        """The same table under a row rule, in SQL, beside those it is under already.

        Rows that don't pass, hot or cold, are neither read nor changed, and none is written. A rule is parsed as an expression of its
        own and tested after the merge, ahead of any filter. The change feed, which keeps images of older versions, is refused.
        """
        both = rule if self.rule is None else f"({self.rule}) AND ({rule})"
        F.expr(rule)  # must be a whole expression by itself
        return TieredTable(self.spark, self.catalog.store.root, self.scope, both)

    def alter(self, **changes) -> None:
        """Change options: policy, compression, bloom_columns, auto_flush."""
        unknown = set(changes) - {"policy", "compression", "bloom_columns", "auto_flush"}
        if unknown:
            raise TierError(f"can't alter {sorted(unknown)}")

        def change(held: Snapshot, draft: dict) -> bool:
            draft["options"] = Options(**{**held.options.__dict__, **changes}).to_json()
            return True

        self.catalog.update(change)

    def unmanage(self, to: str | None = None, drop_cold: bool = False) -> int:
        """Detach: with ``to`` the latest rows are written there and their number returned; cold files go only then."""
        if drop_cold and to is None:
            raise TierError("cold files can be dropped only after rehydration")
        held = self.catalog.load()
        n = 0
        if to is not None:
            df, _ = merge.scan(self.catalog, held)
            df.write.parquet(to)
            n = self.spark.read.schema(df.schema).parquet(to).count()
        draft = held.draft()
        draft["active"] = False
        for j in draft["jobs"]:
            if j["status"] in ("pending", "running"):
                j["status"] = "cancelled"
        if drop_cold:
            draft["segments"] = []
        self.catalog.publish(draft, held.version)
        if drop_cold:
            self.catalog.store.delete("cold")
        return n

    def drop(self) -> None:
        """Delete the table with all its files: jobs are cancelled and readers turned away first, the catalog goes last."""

        def change(held: Snapshot, draft: dict) -> bool:
            draft["active"] = False
            for j in draft["jobs"]:
                if j["status"] in ("pending", "running"):
                    j["status"] = "cancelled"
            return True

        self.catalog.update(change)
        for folder in ("hot", "index", "_changes", "cold", "quarantine", "manifest", "catalog"):
            self.catalog.store.delete(folder)

    # reads

    @property
    def snapshot(self) -> Snapshot:
        held = self.catalog.load()
        if not held.held["active"]:
            raise TierError(f"{held.name} is not managed any more")
        return held

    def _mine(self, held: Snapshot) -> Column:
        """Whether a row is of the active scope."""
        return F.col(held.options.scope_column).cast("string").eqNullSafe(F.lit(self.scope.strip()))

    def _allowed(self) -> Column | None:
        """Whether a row passes the row rule; an unknown answer is no."""
        return None if self.rule is None else F.coalesce(F.expr(self.rule), F.lit(False))

    def _scoped(self, held: Snapshot, df: DataFrame) -> DataFrame:
        """Rows of the active scope that pass the row rule; without a scope, a user table reads as empty."""
        if self.rule is not None:
            df = df.where(self._allowed())
        if held.kind == "shared":
            return df
        if self.scope is None or not self.scope.strip():
            return df.limit(0)
        return df.where(self._mine(held))

    def scan(self, filters=None, where: str | None = None, columns: list[str] | None = None, order_by=None, limit: int | None = None, late: bool = False) -> DataFrame:
        """Latest rows; how they were found is in ``report``."""
        held, rule = self.snapshot, self._allowed()
        if held.kind == "user":
            filters = filters_of(filters)
            if self.scope is None or not self.scope.strip():
                df, self.report = merge.scan(self.catalog, held, filters, where, columns, rule=F.lit(False))
                return df.limit(0)
            rule = self._mine(held) if rule is None else self._mine(held) & rule
            column = held.options.scope_column
            if column in held.pk and isinstance(held.schema()[column].dataType, T.StringType):
                filters = [Filter(column, "=", self.scope.strip()), *filters]
        df, self.report = merge.scan(self.catalog, held, filters, where, columns, order_by, limit, late, rule)
        return df

    def to_df(self) -> DataFrame:
        return self.scan()

    def page(self, after: tuple | None, rows: int) -> DataFrame:
        """Rows in key order behind a key: paging without offsets."""
        held, filters = self.snapshot, []
        if after is not None:
            if any(v is None for v in after) or len(after) != len(held.pk):
                raise TierError("a page key needs a value for each key column")
            filters = [Filter(held.pk[0], ">=", after[0])]  # prunes segments; the whole key decides
        df = self._scoped(held, merge.scan(self.catalog, held, filters)[0])
        if after is not None:
            kinds = {n: t for _, n, t in held.columns()}
            df = df.where(F.struct(*held.pk) > F.struct(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in zip(held.pk, after, strict=True)]))
        return df.orderBy(*held.pk).limit(rows)

    def changes_since(self, since_seq: int = 0, limit_rows: int = 1000, last_rows: int | None = None) -> DataFrame:
        if self.rule is not None:
            raise TierError("the change feed is refused under a row rule")
        return feed.changes_since(self.catalog, self.snapshot, since_seq, limit_rows, last_rows, self.scope)

    # changes

    def insert(self, rows: DataFrame, seq: str | None = None) -> int:
        """New rows; a key that is hot already is refused. A key that only cold rows have becomes live again."""
        return self._apply(rows, INSERT, seq)

    def update(self, rows: DataFrame, seq: str | None = None) -> int:
        """New values for hot rows by key; columns that ``rows`` lacks keep theirs. Keys that aren't hot are not touched."""
        return self._apply(rows, UPDATE, seq)

    def delete(self, keys: DataFrame, seq: str | None = None) -> int:
        """Delete hot rows by key; each leaves a tombstone until it is flushed. Keys that aren't hot are not touched."""
        return self._apply(keys, DELETE, seq)

    def update_where(self, where: str, values: dict[str, str]) -> int:
        """Set columns of hot rows that pass ``where`` to SQL expressions over the row's old values.

        Key, scope and order columns are refused: segments and the change index find rows by them.
        """
        held = self.snapshot
        kept = {*held.pk, held.options.order_column, held.options.scope_column}
        if fixed := sorted(kept & set(values)):
            raise TierError(f"columns {fixed} can't be changed")
        for c in values:
            held.id_of(c)
        return self._again(lambda: self._where(where, UPDATE, values))

    def delete_where(self, where: str) -> int:
        """Delete hot rows that pass ``where``."""
        return self._again(lambda: self._where(where, DELETE, {}))

    def _where(self, where: str, op: int, values: dict[str, str]) -> int:
        held = self.snapshot  # what is read and what is changed are of one version
        hot = self._scoped(held, merge.Reader(self.catalog, held).hot()).where(where)
        return self._apply_once(hot.select(*held.pk, *[F.expr(e).alias(c) for c, e in values.items()]), op, None, True, held)

    def _numbered(self, rows: DataFrame, held: Snapshot, seq: str | None) -> tuple[DataFrame, int]:
        """Rows with their seq, written down first so that numbers stay what they are."""
        floor = held.held["max_seq"]
        mark = f"_changes/{flushing.uuid.uuid4().hex}"
        if seq is not None:
            rows = rows.withColumnRenamed(seq, SEQ)
            rows.write.parquet(self.catalog.store.full(mark))
            back = self.spark.read.schema(rows.schema).parquet(self.catalog.store.full(mark))
            least, most = back.agg(F.min(SEQ), F.max(SEQ)).first()
            if least is not None and least <= floor:
                raise TierError(f"seq {least} is not above {floor}")
            return back, most or floor
        parts = rows.repartitionByRange(*held.pk).withColumn("_part", F.spark_partition_id())
        parts = parts.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*held.pk)))
        parts.write.parquet(self.catalog.store.full(mark))
        back = self.spark.read.schema(parts.schema).parquet(self.catalog.store.full(mark))
        counts = {r["_part"]: r["count"] for r in back.groupBy("_part").count().collect()}
        total = sum(counts.values())
        first, before, offsets = _IDS.next(floor, max(1, total)), 0, []
        for part in sorted(counts):
            offsets.append((part, first + before - 1))
            before += counts[part]
        if not offsets:
            return back.withColumn(SEQ, F.lit(0).cast("long")).drop("_part", "_nth"), floor
        at = self.spark.createDataFrame(offsets, "_part int, _offset long")
        numbered = back.join(F.broadcast(at), "_part").withColumn(SEQ, F.col("_offset") + F.col("_nth")).drop("_part", "_nth", "_offset")
        return numbered, first + total - 1

    def _apply(self, rows: DataFrame, op: int, seq: str | None, check: bool = True) -> int:
        return self._again(lambda: self._apply_once(rows, op, seq, check))

    def _again(self, change: Callable[[], int]) -> int:
        """A change that is made anew, on the newest version, if another writer was first."""
        for _ in range(ATTEMPTS):
            try:
                return change()
            except Conflict:
                continue
        raise Conflict(f"{ATTEMPTS} attempts were overtaken")

    def _apply_once(self, rows: DataFrame, op: int, seq: str | None, check: bool, held: Snapshot | None = None) -> int:
        held = held or self.snapshot
        if held.kind == "user" and check:
            scope = need_scope(self.scope)
            scoped = held.options.scope_column
            if op == INSERT and scoped not in rows.columns:
                raise TierError(f"rows lack the scope column {scoped!r}")
            if scoped in rows.columns and rows.where(~F.col(scoped).cast("string").eqNullSafe(F.lit(scope))).limit(1).count():
                raise TierError("rows of another scope")
        names, pk = held.schema().names, held.pk
        if missing := [c for c in pk if c not in rows.columns]:
            raise TierError(f"rows lack key columns {missing}")
        kinds = {n: t for _, n, t in held.columns()}
        given = [n for n in names if n in rows.columns] if op != DELETE else pk
        rows = rows.select(*[F.col(n).cast(kinds[n]).alias(n) for n in given], *([F.col(seq).cast("long").alias(seq)] if seq else []))
        reader = merge.Reader(self.catalog, held)
        hot = reader.hot()
        if op == INSERT:
            if check:
                nulls = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in pk])
                if rows.where(nulls).limit(1).count() or rows.groupBy(*pk).count().where("count > 1").limit(1).count():
                    raise TierError("primary key columns hold nulls or repeated values")
                if held.hot and rows.join(hot.select(*pk), pk, "left_semi").limit(1).count():
                    raise TierError("duplicate key: already hot")
        else:
            mine = hot.where(self._mine(held)) if held.kind == "user" and check else hot  # another scope's row of that key stays
            mine = mine if self.rule is None else mine.where(self._allowed())
            rows = rows.dropDuplicates(pk).join(mine.select(*pk), pk, "left_semi")
        if self.rule is not None and op != DELETE:
            images = rows if op == INSERT else rows.join(hot.select(*pk, *[c for c in names if c not in given]), pk)
            images = images.select(*[F.col(c) if c in images.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names])
            if images.where(~self._allowed()).limit(1).count():
                raise TierError("rows that the row rule does not allow")
        numbered, top = self._numbered(rows, held, seq)
        n = numbered.count()
        if not n:
            return 0
        draft = held.draft()
        changed = numbered.select(*pk, SEQ, F.lit(op).cast("short").alias(OP))
        fresh = op == INSERT and not (held.index and reader.index().join(numbered.select(*pk), pk, "left_semi").limit(1).count())
        new = None
        if op == UPDATE:
            old = hot.drop(SEQ).select(*pk, *[c for c in names if c not in given])
            new = numbered.join(old, pk).select(*names, SEQ)
        elif op == INSERT:
            new = numbered.select(*[F.col(c) if c in given else F.lit(None).cast(kinds[c]).alias(c) for c in names], SEQ)
        flushing.add(self.catalog, draft, new, changed, held.schema_version, delta=not fresh)
        draft["max_seq"] = max(top, held.held["max_seq"])
        self.catalog.publish(draft, held.version)
        return n

    def apply_changes(self, changes: DataFrame, batch_id: int | None = None) -> int:
        """Fold captured changes (application columns, seq, op) into hot rows and change index.

        The last change of each key by seq counts. A batch number that has been applied, or seqs at or below the table's
        newest, are skipped, so that a repeated delivery changes nothing.
        """
        return self._again(lambda: self._fold(changes, batch_id))

    def _fold(self, changes: DataFrame, batch_id: int | None) -> int:
        held = self.snapshot
        if batch_id is not None and batch_id <= held.held["applied_batch"]:
            return 0
        pk, names = held.pk, held.schema().names
        reader = merge.Reader(self.catalog, held)
        floor = held.held["max_seq"]
        last = changes.where(F.col("seq") > floor).withColumn("_nth", F.row_number().over(Window.partitionBy(*pk).orderBy(F.col("seq").desc()))).where("_nth = 1").drop("_nth")
        mark = f"_changes/{flushing.uuid.uuid4().hex}"
        last.write.parquet(self.catalog.store.full(mark))
        last = self.spark.read.schema(last.schema).parquet(self.catalog.store.full(mark))
        n, top = last.agg(F.count("*"), F.max("seq")).first()
        draft = held.draft()
        if n:
            changed = last.select(*pk, F.col("seq").cast("long").alias(SEQ), F.col("op").cast("short").alias(OP))
            live = last.where(F.col("op") != DELETE).select(*names, F.col("seq").cast("long").alias(SEQ))
            there = reader.index().select(*pk).unionByName(reader.hot().select(*pk))
            known = bool(held.index or held.hot) and there.join(last.select(*pk), pk, "left_semi").limit(1).count() > 0
            flushing.add(self.catalog, draft, live, changed, held.schema_version, delta=known)
            draft["max_seq"] = max(top, floor)
        if batch_id is not None:
            draft["applied_batch"] = batch_id
        self.catalog.publish(draft, held.version)
        return n

    def backfill(self) -> int:
        """Hot rows without an entry in the change index get one, as inserts in order of their seq; entries stay as they are."""
        return self._again(self._backfill)

    def _backfill(self) -> int:
        held = self.snapshot
        reader = merge.Reader(self.catalog, held)
        missing = reader.hot().select(*held.pk, SEQ).join(reader.index().select(*held.pk), held.pk, "left_anti").withColumn(OP, F.lit(INSERT).cast("short"))
        n = missing.count()
        if n:
            draft = held.draft()
            flushing.add(self.catalog, draft, None, missing, held.schema_version, delta=False)  # keys that no piece has
            self.catalog.publish(draft, held.version)
        return n

    # flush and care

    def flush(self, force: bool = False, now: dt.datetime | None = None, passes: int = 1) -> dict:
        """Move rows to cold files, by policy or by ``force``; up to ``passes`` times while there is something to move."""
        self.snapshot  # noqa: B018  refuses a detached table
        done = flushing.flush(self.catalog, force, now)
        for _ in range(passes - 1):
            if done["status"] != "completed":
                break
            more = flushing.flush(self.catalog, force, now)
            if more["status"] != "completed":
                break
            done = {**more, "rows": done["rows"] + more["rows"], "segments": done["segments"] + more["segments"]}
        return done

    def vacuum(self, older_than: dt.timedelta = dt.timedelta(days=1)) -> dict:
        return care.vacuum(self.catalog, older_than)

    def status(self) -> dict:
        return care.status(self.catalog)

    def verify(self) -> dict:
        return care.verify(self.catalog)

    def recover(self, dry_run: bool = True) -> dict:
        return care.recover(self.catalog, dry_run)

    def jobs(self, statuses: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
        return care.jobs(self.catalog, statuses, types)

    # schema

    def _evolve(self, columns: list[dict]) -> None:
        held = self.catalog.load()  # two changes of the schema at once are refused, not merged
        draft = held.draft()
        version = max(map(int, draft["schemas"])) + 1
        draft["schemas"][str(version)], draft["schema_version"] = columns, version
        draft["next_column"] = max(draft["next_column"], *(c["id"] + 1 for c in columns))
        self.catalog.publish(draft, held.version)

    def rename_column(self, old: str, new: str) -> None:
        held = self.snapshot
        held.id_of(old)
        if old in held.pk or old in (held.options.order_column, held.options.scope_column):
            raise TierError(f"{old!r} can't be renamed")
        if new in held.schema().names or new.startswith("_"):
            raise TierError(f"{new!r} can't be used")
        self._evolve([{**c, "name": new} if c["name"] == old else c for c in held.draft()["schemas"][str(held.schema_version)]])

    def add_column(self, name: str, kind: str | T.DataType) -> None:
        held = self.snapshot
        kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
        check_type(name, kind)
        if name in held.schema().names or name.startswith("_"):
            raise TierError(f"{name!r} can't be used")
        columns = held.draft()["schemas"][str(held.schema_version)]
        self._evolve([*columns, {"id": held.held["next_column"], "name": name, "type": json.loads(kind.json())}])

    def drop_column(self, name: str) -> None:
        held = self.snapshot
        held.id_of(name)
        if name in held.pk or name in (held.options.order_column, held.options.scope_column):
            raise TierError(f"{name!r} can't be dropped")
        self._evolve([c for c in held.draft()["schemas"][str(held.schema_version)] if c["name"] != name])
