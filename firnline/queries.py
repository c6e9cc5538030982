"""Registered queries over tiered tables, each with the SQL that gives the same rows from the plain tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import OP, SEQ, OlderThan, Options, RowLimit
from .operators import care
from .operators.table import TieredTable
from .plans.merge import Reader
from .sources.storage import shared_dir
from .streaming import capture
from .surface import CH, PARAMETERS, SURFACE, tiered_sql

_built: dict[tuple, str] = {}

O_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
#: The logical rows of the ``orders`` fixture.
LOGICAL = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus,
 CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
 FROM orders WHERE o_orderkey % 11 <> 0"""
EVENTS = "SELECT event_id, ts, user_id, event_type, value, props FROM events"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fixture(spark: SparkSession, sf_dir: str, name: str, build: Callable) -> TieredTable:
    """A tiered table that is built once for each session and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        root = f"{shared_dir(spark)}/firnline-tables/{uuid.uuid4().hex[:12]}/{name}"
        build(root)
        _built[key] = root
    return TieredTable(spark, _built[key])


def _changed(df: DataFrame) -> DataFrame:
    return df.withColumn("o_orderstatus", F.lit("U")).withColumn("o_totalprice", F.col("o_totalprice") + 1)


def _file_rows(n: int) -> int:
    return max(1, n // 16)


def orders_table(spark: SparkSession, sf_dir: str) -> TieredTable:
    """Two cold versions of some keys, cold tombstones, tombstones in the change index, changed and plain hot rows.

    n keys; those from n - 1000 on stay hot. Multiples of 7 have a second version, multiples of 11 are deleted.
    A key that is cold already gets its second version by a new insert, as updates reach hot rows only.
    """

    def build(root: str) -> None:
        orders = read(spark, sf_dir, "orders")
        n = orders.count()
        cut = n - 1000
        k = F.col("o_orderkey")
        seq = lambda df, base: df.withColumn("s", k + base + 1)
        t = TieredTable.manage(spark, root, "orders", orders.schema, ["o_orderkey"], Options(RowLimit(1000, 1000, _file_rows(n), 1 << 40)))
        t.insert(seq(orders.where(k < cut), 0), "s")
        t.flush(force=True)
        again = orders.where((k < cut // 2) & (k % 7 == 0) & (k % 11 != 0))
        t.insert(seq(_changed(again), n), "s")
        doomed = orders.where((k < cut // 3) & (k % 11 == 0))
        t.insert(seq(doomed, 2 * n), "s")
        t.delete(seq(doomed, 3 * n), "s")
        t.flush(force=True)  # tombstones first, as they are few
        t.flush(force=True)
        t.insert(seq(orders.where(k >= cut), 4 * n), "s")
        t.update(seq(_changed(orders.where((k >= cut) & (k % 7 == 0))), 5 * n), "s")
        t.insert(seq(_changed(orders.where((k >= cut // 2) & (k < cut) & (k % 7 == 0) & (k % 11 != 0))), 6 * n), "s")
        t.insert(seq(orders.where((k >= cut // 3) & (k < cut) & (k % 11 == 0)), 7 * n), "s")
        t.delete(seq(orders.where((k >= cut // 3) & (k % 11 == 0)), 8 * n), "s")

    return _fixture(spark, sf_dir, "orders", build)


def orders_state(spark: SparkSession, sf_dir: str, state: str) -> TieredTable:
    """The plain orders, all hot, half cold, or all cold."""

    def build(root: str) -> None:
        orders = read(spark, sf_dir, "orders")
        n = orders.count()
        limit = {"hot": n, "mixed": n // 2, "cold": 0}[state]
        t = TieredTable.manage(spark, root, f"orders_{state}", orders.schema, ["o_orderkey"], Options(RowLimit(limit, 1, 1, 1 << 40)))
        t.alter(policy=RowLimit(limit, 1, _file_rows(n), 1 << 40))
        t.insert(orders.withColumn("s", F.col("o_orderkey") + 1), "s")
        t.flush()

    return _fixture(spark, sf_dir, f"orders_{state}", build)


def events_table(spark: SparkSession, sf_dir: str) -> TieredTable:
    """Append-only events; segments ordered by ts, the newest tenth hot."""

    def build(root: str) -> None:
        events = read(spark, sf_dir, "events")
        n = events.count()
        t = TieredTable.manage(spark, root, "events", events.schema, ["event_id"], Options(RowLimit(n // 10, 1, _file_rows(n), 1 << 40), order_column="ts", bloom_columns=["user_id"]))
        t.insert(events.withColumn("s", F.col("event_id") + 1), "s")
        t.flush()

    return _fixture(spark, sf_dir, "events", build)


def documents_table(spark: SparkSession, sf_dir: str) -> TieredTable:
    """A user table: documents, with their source as scope."""

    def build(root: str) -> None:
        docs = read(spark, sf_dir, "documents")
        options = Options(RowLimit(0, 1, _file_rows(docs.count()), 1 << 40), scope_column="source")
        TieredTable.manage(spark, root, "documents", docs.schema, ["source", "doc_id"], options, kind="user", rows=docs).flush()

    return _fixture(spark, sf_dir, "documents", build)


def lineitem_table(spark: SparkSession, sf_dir: str) -> TieredTable:
    """Order lines, which have no key of their own, numbered; the newest tenth hot."""

    def build(root: str) -> None:
        lines = read(spark, sf_dir, "lineitem").withColumn("l_id", F.monotonically_increasing_id())
        lines.write.parquet(f"{root}_numbered")
        lines = spark.read.schema(lines.schema).parquet(f"{root}_numbered")
        n = lines.count()
        t = TieredTable.manage(spark, root, "lineitem", lines.schema, ["l_id"], Options(RowLimit(n // 10, 1, _file_rows(n), 1 << 40)))
        t.insert(lines.withColumn("s", F.col("l_id") + 1), "s")
        t.flush()

    return _fixture(spark, sf_dir, "lineitem", build)


def conversations_table(spark: SparkSession, sf_dir: str) -> TieredTable:
    """A key of two columns; first turns deleted while cold versions of them exist."""

    def build(root: str) -> None:
        rows = read(spark, sf_dir, "conversations")
        t = TieredTable.manage(spark, root, "conversations", rows.schema, ["conv_id", "turn"], Options(RowLimit(0, 1, _file_rows(rows.count()), 1 << 40)), rows=rows)
        t.flush()
        first = rows.where("turn = 0")
        t.insert(first)
        t.delete(first)

    return _fixture(spark, sf_dir, "conversations", build)


def evolved_table(spark: SparkSession, sf_dir: str) -> TieredTable:
    """Customers of three schema versions: one column renamed and one added, then one dropped and added anew."""

    def build(root: str) -> None:
        c = read(spark, sf_dir, "customer")
        k = F.col("c_custkey")
        n = c.count()
        t = TieredTable.manage(spark, root, "customer", c.schema, ["c_custkey"], Options(RowLimit(0, 1, _file_rows(n), 1 << 40)))
        t.insert(c.where(k < n // 2))
        t.flush()
        t.rename_column("c_name", "full_name")
        t.add_column("tier", "int")
        t.insert(c.where((k >= n // 2) & (k < n - n // 10)).withColumnRenamed("c_name", "full_name").withColumn("tier", F.lit(1)))
        t.flush()
        t.drop_column("c_mktsegment")
        t.add_column("c_mktsegment", "string")
        t.insert(c.where(k >= n - n // 10).withColumnRenamed("c_name", "full_name").withColumn("tier", F.lit(2)))

    return _fixture(spark, sf_dir, "customer", build)


def _orders(f: Callable[[TieredTable, int], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(orders_table(spark, sf_dir), read(spark, sf_dir, "orders").count())

    return query


def _group(df: DataFrame) -> DataFrame:
    return df.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


def tier_reinsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted keys come back by an insert while their tombstone is still in the change index or cold."""

    def build(root: str) -> None:
        orders = read(spark, sf_dir, "orders")
        t = TieredTable.manage(spark, root, "reinsert", orders.schema, ["o_orderkey"], Options(RowLimit(0, 1, _file_rows(orders.count()), 1 << 40)))
        t.insert(orders)
        t.flush()
        gone = orders.where("o_orderkey % 11 = 0")
        t.insert(gone)
        t.delete(gone)
        t.flush(force=True)
        t.insert(gone.where("o_orderkey % 2 = 0"))
        t.delete(gone.where("o_orderkey % 4 = 0"))
        t.insert(gone.where("o_orderkey % 5 = 0 AND (o_orderkey % 2 <> 0 OR o_orderkey % 4 = 0)").withColumn("o_orderstatus", F.lit("R")))

    return _fixture(spark, sf_dir, "reinsert", build).scan()


def capture_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of changes in several files, some keys changed and deleted later, folded into latest state; read twice."""

    def build(root: str) -> None:
        e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
        n = e.count()
        k = F.col("event_id")
        folder = f"{root}_changes"
        t = TieredTable.manage(spark, root, "captured", e.schema, ["event_id"], Options(RowLimit(n, 1, 1000, 1 << 40)))
        for part in (e.withColumn("seq", k + 1).withColumn("op", F.lit(1)), e.where(k % 3 == 0).withColumn("value", F.col("value") + 1).withColumn("seq", k + n + 1).withColumn("op", F.lit(2)), e.where(k % 5 == 0).withColumn("seq", k + 2 * n + 1).withColumn("op", F.lit(3))):
            part.withColumn("op", F.col("op").cast("int")).coalesce(1).write.mode("append").parquet(folder)
            capture.drain(capture.source(spark, t, folder), t, f"{root}_checkpoint")
        capture.drain(capture.source(spark, t, folder), t, f"{root}_checkpoint")  # nothing new: nothing changes

    t = _fixture(spark, sf_dir, "captured", build)
    return Reader(t.catalog, t.snapshot).index().select("event_id", F.col(SEQ).alias("seq"), F.col(OP).cast("int").alias("op"))


def captured_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    capture_latest_state(spark, sf_dir)
    return TieredTable(spark, _built[(spark.sparkContext.applicationId, sf_dir, "captured")]).scan()


def capture_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without a change-index entry get one."""

    def build(root: str) -> None:
        orders = read(spark, sf_dir, "orders")
        t = TieredTable.manage(spark, root, "backfilled", orders.schema, ["o_orderkey"], Options(RowLimit(10, 1, 1000, 1 << 40)))
        t.insert(orders.withColumn("s", F.col("o_orderkey") + 1), "s")
        held = t.snapshot
        draft = held.draft()
        index = Reader(t.catalog, held).index().where("o_orderkey % 3 = 0")
        from .operators.flush import keep

        keep(t.catalog, draft, None, index, held.schema_version)
        t.catalog.publish(draft, held.version)
        t.backfill()

    t = _fixture(spark, sf_dir, "backfilled", build)
    return Reader(t.catalog, t.snapshot).index().select("o_orderkey", F.col(SEQ).alias("seq"), F.col(OP).cast("int").alias("op"))


def flush_row_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the policy moved: by state, rows and range of seq."""
    t = orders_state(spark, sf_dir, "mixed")
    reader = Reader(t.catalog, t.snapshot)
    side = lambda df, name: df.agg(F.count("*").alias("n"), F.min(SEQ).alias("lo"), F.max(SEQ).alias("hi")).select(F.lit(name).alias("side"), "n", "lo", "hi")
    return side(reader.cold(reader.snapshot.active), "cold").unionByName(side(reader.hot(), "hot"))


def flush_older_than(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose seq tells an instant before now less an age: by the events' own time as seq."""
    import datetime as dt

    def build(root: str) -> None:
        e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id")
        t = TieredTable.manage(spark, root, "aged", e.schema, ["event_id"], Options(OlderThan(days=10, min_flush_rows=1, max_rows_per_file=100, max_rows_per_flush=1 << 40), order_column="ts"))
        millis = F.expr("unix_millis(cast(ts AS timestamp))") - 1704067200000
        t.insert(e.withColumn("s", F.shiftleft(millis, 22) + F.col("event_id") + (1 << 52)), "s")
        top = e.agg(F.max("ts")).first()[0]
        from .model import EPOCH, instant_of

        t.flush(now=instant_of(1 << 52) + (top.replace(tzinfo=dt.UTC) - EPOCH))

    t = _fixture(spark, sf_dir, "aged", build)
    reader = Reader(t.catalog, t.snapshot)
    return reader.cold(reader.snapshot.active).select("event_id")


def flush_force_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forced flush of few tombstones moves those alone: what is cold, by operation."""

    def build(root: str) -> None:
        orders = read(spark, sf_dir, "orders")
        t = TieredTable.manage(spark, root, "tombstones", orders.schema, ["o_orderkey"], Options(RowLimit(0, 1, _file_rows(orders.count()), 1 << 40)))
        t.insert(orders)
        t.flush()
        t.insert(orders.where("o_orderkey < 100"))
        t.delete(orders.where("o_orderkey < 40"))
        t.flush(force=True)

    t = _fixture(spark, sf_dir, "tombstones", build)
    reader = Reader(t.catalog, t.snapshot)
    return reader.cold(reader.snapshot.active).groupBy(F.col(OP).cast("int").alias("op")).agg(F.count("*").alias("n"))


def _feed(**asked) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = read(spark, sf_dir, "orders").count()
        t = orders_table(spark, sf_dir)
        given = {k: v(n) if callable(v) else v for k, v in asked.items()}
        return t.changes_since(**given).select("seq", F.col("op").cast("int").alias("op"), F.get_json_object("pk", "$.o_orderkey").cast("long").alias("o_orderkey"), "deleted", "source", F.col("row_image").isNotNull().alias("has_image"))

    return query


#: The stored versions and latest states of the ``orders`` fixture.
FEED = """WITH n AS (SELECT count(*) AS n, count(*) - 1000 AS cut FROM orders), k AS (SELECT o_orderkey AS k, n.n, n.cut FROM orders, n)
SELECT k + 1 AS seq, 1 AS op, k AS o_orderkey, false AS deleted, 'cold' AS source, true AS has_image FROM k WHERE k < cut
UNION ALL SELECT k + n + 1, 1, k, false, 'cold', true FROM k WHERE k < cut // 2 AND k % 7 = 0 AND k % 11 <> 0
UNION ALL SELECT k + 3 * n + 1, 3, k, true, 'cold', false FROM k WHERE k < cut // 3 AND k % 11 = 0
UNION ALL SELECT CASE WHEN k % 7 = 0 THEN k + 5 * n + 1 ELSE k + 4 * n + 1 END, CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END, k, false, 'hot', false FROM k WHERE k >= cut AND k % 11 <> 0
UNION ALL SELECT k + 6 * n + 1, 1, k, false, 'hot', false FROM k WHERE k >= cut // 2 AND k < cut AND k % 7 = 0 AND k % 11 <> 0
UNION ALL SELECT k + 8 * n + 1, 3, k, true, 'hot', false FROM k WHERE k >= cut // 3 AND k % 11 = 0"""


def equality(state: str) -> Callable[[SparkSession, str], DataFrame]:
    """Differences between a tiered table and its plain twin, both ways, as multisets."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        plain, tiered = read(spark, sf_dir, "orders"), orders_state(spark, sf_dir, state).scan()
        return plain.exceptAll(tiered).withColumn("side", F.lit("plain")).unionByName(tiered.exceptAll(plain).withColumn("side", F.lit("tiered")))

    return query


def ops_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders_table(spark, sf_dir).status()
    return spark.createDataFrame([(k, int(s[k])) for k in ("cold_rows", "cold_tombstones", "hot_rows", "pending_changes")], "counter string, value long")


def ops_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = orders_table(spark, sf_dir).verify()["checks"]
    return spark.createDataFrame([(c["name"], c["ok"], c["detail"]["count"]) for c in checks], "name string, ok boolean, wrong long")


def ops_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orders_table(spark, sf_dir).recover(dry_run=True)
    return spark.createDataFrame([("staged", len(found["staged_deleted"])), ("orphans", len(found["quarantined"]))], "kind string, files long")


def ops_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = orders_table(spark, sf_dir)
    care.export_manifest(t.catalog)
    held = care.read_manifest(t.catalog)
    rows = spark.createDataFrame([(s["path"], s["row_count"], s["min_seq"], s["max_seq"]) for s in held["segments"]], "path string, row_count long, min_seq long, max_seq long")
    return rows.agg(F.sum("row_count").alias("rows"), F.min("min_seq").alias("lo"), F.max("max_seq").alias("hi"), (F.countDistinct("path") == len(held["segments"])).alias("apart"))


def ops_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_table(spark, sf_dir).jobs(["completed"], ["flush"]).groupBy("type", "status").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))


def tier_limit_hot_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows an unordered limit gives is open: how many they are, and how many of them the table doesn't have."""
    t = orders_table(spark, sf_dir)
    some = t.scan(limit=100)
    wrong = some.exceptAll(t.scan()).agg(F.count("*").alias("wrong"))
    return some.agg(F.count("*").alias("n")).join(wrong)


def flush_concurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are inserted, updated and deleted while a flush is at work."""

    def build(root: str) -> None:
        from .operators import flush as flushing

        orders = read(spark, sf_dir, "orders")
        n, k = orders.count(), F.col("o_orderkey")
        t = TieredTable.manage(spark, root, "concurrent", orders.schema, ["o_orderkey"], Options(RowLimit(0, 1, _file_rows(n), 1 << 40)), rows=orders.where(k < n - 500))
        other = TieredTable(spark, root)

        def change() -> None:
            other.insert(orders.where(k >= n - 500))
            other.update(_changed(orders.where(k % 7 == 0)))
            other.delete(orders.where(k % 11 == 0))

        flushing.FAILPOINTS["before_activate"] = change
        try:
            t.flush(force=True)
        finally:
            flushing.FAILPOINTS.clear()

    return _fixture(spark, sf_dir, "concurrent", build).scan()


def tier_update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot rows changed and deleted by condition, in several small changes on top of each other."""

    def build(root: str) -> None:
        orders = read(spark, sf_dir, "orders")
        t = TieredTable.manage(spark, root, "conditions", orders.schema, ["o_orderkey"], Options(RowLimit(0, 1, _file_rows(orders.count()), 1 << 40)), rows=orders)
        t.update_where("o_orderkey % 7 = 0", {"o_orderstatus": "'V'"})
        t.update_where("o_orderstatus = 'V' AND o_orderpriority = '1-URGENT'", {"o_totalprice": "o_totalprice * 2"})
        t.delete_where("o_orderkey % 5 = 0 AND o_orderpriority = '5-LOW'")

    return _fixture(spark, sf_dir, "conditions", build).scan()


def tier_rehydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest rows written back to a plain table on detaching."""
    key = (spark.sparkContext.applicationId, sf_dir, "rehydrated")
    if key not in _built:
        root = f"{shared_dir(spark)}/firnline-tables/{uuid.uuid4().hex[:12]}"
        rows = read(spark, sf_dir, "customer")
        t = TieredTable.manage(spark, f"{root}/t", "rehydrated", rows.schema, ["c_custkey"], Options(RowLimit(20, 1, 50, 1 << 40)), rows=rows)
        t.flush()
        t.delete(rows.where(F.col("c_custkey") >= rows.count() - 10))
        t.unmanage(f"{root}/plain", drop_cold=True)
        _built[key] = f"{root}/plain"
    return spark.read.parquet(_built[key])




QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tier_scan_all": _orders(lambda t, n: t.scan()),
    "tier_count": _orders(lambda t, n: t.scan().agg(F.count("*").alias("n"))),
    "tier_group_agg": _orders(lambda t, n: _group(t.scan())),
    "tier_pk_eq": _orders(lambda t, n: t.scan([("o_orderkey", "=", 42)])),
    "tier_pk_range": _orders(lambda t, n: t.scan([("o_orderkey", "between", (3000, 3100))])),
    "tier_pk_in": _orders(lambda t, n: t.scan([("o_orderkey", "in", (1, 42, n - 50))])),
    "tier_mutable_filter": _orders(lambda t, n: t.scan([("o_orderkey", ">=", 0)], where="o_orderstatus = 'F'")),
    "tier_proven_empty": _orders(lambda t, n: t.scan([("o_orderkey", ">=", n - 10)])),
    "tier_null_bounds": _orders(lambda t, n: t.scan(where="o_custkey IS NULL OR o_totalprice > 100000")),
    "tier_topk_asc": _orders(lambda t, n: t.scan(order_by=[("o_orderkey", True)], limit=50)),
    "tier_topk_desc": _orders(lambda t, n: t.scan(order_by=[("o_orderkey", False)], limit=50)),
    "tier_late_mat": _orders(lambda t, n: t.scan(order_by=[("o_orderdate", False), ("o_orderkey", True)], limit=50, late=True)),
    "tier_limit_hot_first": tier_limit_hot_first,
    "tier_page": _orders(lambda t, n: t.page((500,), 40)),
    "tier_cold_tombstone": _orders(lambda t, n: t.scan([("o_orderkey", "<", (n - 1000) // 3)])),
    "tier_reinsert": tier_reinsert,
    "tier_state_hot": lambda s, d: _group(orders_state(s, d, "hot").scan()),
    "tier_state_mixed": lambda s, d: _group(orders_state(s, d, "mixed").scan()),
    "tier_state_cold": lambda s, d: _group(orders_state(s, d, "cold").scan()),
    "tier_events_recent": lambda s, d: events_table(s, d).scan(order_by=[("ts", False), ("event_id", False)], limit=50),
    "tier_events_range": lambda s, d: events_table(s, d).scan([("event_id", "between", (100, 900))], where="value > 50"),
    "tier_composite_pk": lambda s, d: conversations_table(s, d).scan(),
    "tier_scope": lambda s, d: documents_table(s, d).in_scope("src3").scan(),
    "tier_scope_where": lambda s, d: documents_table(s, d).in_scope("src3").scan(where="lang = 'en' OR source <> 'src3' OR true"),
    "tier_row_rule": _orders(lambda t, n: t.guarded("o_orderpriority <> '5-LOW'").scan(where="o_orderstatus = 'U' OR true")),
    "tier_update_where": tier_update_where,
    "tier_scope_unset": lambda s, d: documents_table(s, d).scan().agg(F.count("*").alias("n")),
    "tier_scope_feed": lambda s, d: documents_table(s, d).in_scope("src3").changes_since(limit_rows=1 << 30).select(F.get_json_object("pk", "$.doc_id").cast("long").alias("doc_id"), F.col("op").cast("int").alias("op"), "source"),
    "tier_rename_col": lambda s, d: evolved_table(s, d).scan(columns=["c_custkey", "full_name"]),
    "tier_add_col": lambda s, d: evolved_table(s, d).scan(columns=["c_custkey", "tier"]),
    "tier_drop_add_col": lambda s, d: evolved_table(s, d).scan(columns=["c_custkey", "c_mktsegment"]),
    "tier_rehydrate": tier_rehydrate,
    "feed_from_start": _feed(limit_rows=1 << 30),
    "feed_resume": _feed(since_seq=lambda n: n // 2, limit_rows=100),
    "feed_last_n": _feed(limit_rows=1000, last_rows=100),
    "feed_hot_only": _feed(since_seq=lambda n: 4 * n, limit_rows=1 << 30),
    "flush_row_limit": flush_row_limit,
    "flush_older_than": flush_older_than,
    "flush_force_tombstones": flush_force_tombstones,
    "flush_concurrent": flush_concurrent,
    "capture_latest_state": capture_latest_state,
    "capture_rows": captured_rows,
    "capture_backfill": capture_backfill,
    "equality_state_hot": equality("hot"),
    "equality_state_mixed": equality("mixed"),
    "equality_state_cold": equality("cold"),
    "ops_status": ops_status,
    "ops_integrity": ops_integrity,
    "ops_recover": ops_recover,
    "ops_manifest": ops_manifest,
    "ops_jobs": ops_jobs,
}

_N = "(SELECT count(*) FROM orders)"
_GROUP = "SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM ({}) GROUP BY o_orderpriority"
_PLAIN = f"SELECT {O_COLS} FROM orders"
_CUST = "WITH n AS (SELECT count(*) AS n FROM customer)"

ORACLE_SQL: dict[str, str] = {
    "tier_scan_all": LOGICAL,
    "tier_count": f"SELECT count(*) AS n FROM ({LOGICAL})",
    "tier_group_agg": _GROUP.format(LOGICAL),
    "tier_pk_eq": f"SELECT * FROM ({LOGICAL}) WHERE o_orderkey = 42",
    "tier_pk_range": f"SELECT * FROM ({LOGICAL}) WHERE o_orderkey BETWEEN 3000 AND 3100",
    "tier_pk_in": f"SELECT * FROM ({LOGICAL}) WHERE o_orderkey IN (1, 42, {_N} - 50)",
    "tier_mutable_filter": f"SELECT * FROM ({LOGICAL}) WHERE o_orderstatus = 'F'",
    "tier_proven_empty": f"SELECT * FROM ({LOGICAL}) WHERE o_orderkey >= {_N} - 10",
    "tier_null_bounds": f"SELECT * FROM ({LOGICAL}) WHERE o_custkey IS NULL OR o_totalprice > 100000",
    "tier_topk_asc": f"SELECT * FROM ({LOGICAL}) ORDER BY o_orderkey LIMIT 50",
    "tier_topk_desc": f"SELECT * FROM ({LOGICAL}) ORDER BY o_orderkey DESC LIMIT 50",
    "tier_late_mat": f"SELECT * FROM ({LOGICAL}) ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
    "tier_page": f"SELECT * FROM ({LOGICAL}) WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 40",
    "tier_cold_tombstone": f"SELECT * FROM ({LOGICAL}) WHERE o_orderkey < ({_N} - 1000) // 3",
    "tier_reinsert": """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 AND o_orderkey % 5 = 0 AND (o_orderkey % 2 <> 0 OR o_orderkey % 4 = 0) THEN 'R' ELSE o_orderstatus END AS o_orderstatus,
 o_totalprice, o_orderdate, o_orderpriority FROM orders
 WHERE o_orderkey % 11 <> 0 OR o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0 OR o_orderkey % 5 = 0 AND (o_orderkey % 2 <> 0 OR o_orderkey % 4 = 0)""",
    **{f"tier_state_{s}": _GROUP.format(_PLAIN) for s in ("hot", "mixed", "cold")},
    "tier_events_recent": f"{EVENTS} ORDER BY ts DESC, event_id DESC LIMIT 50",
    "tier_events_range": f"{EVENTS} WHERE event_id BETWEEN 100 AND 900 AND value > 50",
    "tier_composite_pk": "SELECT conv_id, turn, role, text FROM conversations WHERE turn <> 0",
    "tier_scope": "SELECT doc_id, text, lang, source, n_chars FROM documents WHERE source = 'src3'",
    "tier_scope_where": "SELECT doc_id, text, lang, source, n_chars FROM documents WHERE source = 'src3'",
    "tier_limit_hot_first": "SELECT CAST(100 AS BIGINT) AS n, CAST(0 AS BIGINT) AS wrong",
    "flush_concurrent": LOGICAL,
    "tier_row_rule": f"SELECT * FROM ({LOGICAL}) WHERE o_orderpriority <> '5-LOW'",
    "tier_update_where": f"""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'V' ELSE o_orderstatus END AS o_orderstatus,
 CASE WHEN o_orderkey % 7 = 0 AND o_orderpriority = '1-URGENT' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
 FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderpriority = '5-LOW')""",
    "tier_scope_unset": "SELECT CAST(0 AS BIGINT) AS n",
    "tier_scope_feed": "SELECT doc_id, 1 AS op, 'cold' AS source FROM documents WHERE source = 'src3'",
    "tier_rename_col": "SELECT c_custkey, c_name AS full_name FROM customer",
    "tier_add_col": f"{_CUST} SELECT c_custkey, CASE WHEN c_custkey < n // 2 THEN NULL WHEN c_custkey < n - n // 10 THEN 1 ELSE 2 END AS tier FROM customer, n",
    "tier_drop_add_col": f"{_CUST} SELECT c_custkey, CASE WHEN c_custkey >= n - n // 10 THEN c_mktsegment END AS c_mktsegment FROM customer, n",
    "tier_rehydrate": f"{_CUST} SELECT customer.* FROM customer, n WHERE c_custkey < n - 10",
    "feed_from_start": FEED,
    "feed_resume": f"SELECT * FROM ({FEED}) WHERE seq > {_N} // 2 ORDER BY seq LIMIT 100",
    "feed_last_n": f"SELECT * FROM ({FEED}) ORDER BY seq DESC LIMIT 100",
    "feed_hot_only": f"SELECT * FROM ({FEED}) WHERE seq > 4 * {_N}",
    "flush_row_limit": f"SELECT CASE WHEN o_orderkey < {_N} - {_N} // 2 THEN 'cold' ELSE 'hot' END AS side, count(*) AS n, min(o_orderkey) + 1 AS lo, max(o_orderkey) + 1 AS hi FROM orders GROUP BY 1",
    "flush_older_than": "SELECT event_id FROM events WHERE date_trunc('millisecond', ts) < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 DAY FROM events)",
    "flush_force_tombstones": "SELECT op, count(*) AS n FROM (SELECT 1 AS op FROM orders UNION ALL SELECT 3 FROM orders WHERE o_orderkey < 40) GROUP BY op",
    "capture_latest_state": """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_id + 2 * n + 1 WHEN event_id % 3 = 0 THEN event_id + n + 1 ELSE event_id + 1 END AS seq,
 CASE WHEN event_id % 5 = 0 THEN 3 WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS op FROM events, (SELECT count(*) AS n FROM events)""",
    "capture_rows": "SELECT event_id, user_id, event_type, CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS value FROM events WHERE event_id % 5 <> 0",
    "capture_backfill": "SELECT o_orderkey, o_orderkey + 1 AS seq, 1 AS op FROM orders",
    **{f"equality_state_{s}": f"SELECT {O_COLS}, '' AS side FROM orders WHERE false" for s in ("hot", "mixed", "cold")},
    "ops_status": f"""SELECT 'cold_rows' AS counter, CAST(count(*) AS BIGINT) AS value FROM ({FEED}) WHERE source = 'cold' UNION ALL SELECT 'cold_tombstones', count(*) FROM ({FEED}) WHERE source = 'cold' AND deleted
 UNION ALL SELECT 'hot_rows', count(*) FROM ({FEED}) WHERE source = 'hot' AND NOT deleted UNION ALL SELECT 'pending_changes', count(*) FROM ({FEED}) WHERE source = 'hot'""",
    "ops_integrity": "SELECT unnest(['one_active_schema', 'at_most_one_active_flush_job', 'active_segments_have_path_and_rows', 'no_stale_pending_segments', 'no_duplicate_active_path', 'active_segment_files_exist', 'seq_ranges_are_ordered', 'segment_counts_match_files', 'no_version_is_stored_twice', 'hot_keys_are_unique', 'one_change_for_each_key']) AS name, true AS ok, CAST(0 AS BIGINT) AS wrong",
    "ops_manifest": f"SELECT count(*) AS rows, min(seq) AS lo, max(seq) AS hi, true AS apart FROM ({FEED}) WHERE source = 'cold'",
    "ops_jobs": f"""SELECT 'flush' AS type, 'completed' AS status, CAST(CASE WHEN count(*) FILTER (WHERE deleted) > 4096 THEN 2 ELSE 3 END AS BIGINT) AS n, count(*) AS rows
 FROM ({FEED}) WHERE source = 'cold'""",
    "ops_recover": "SELECT 'staged' AS kind, CAST(0 AS BIGINT) AS files UNION ALL SELECT 'orphans', 0",
}


def _surface(body: str, args: dict | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in ("region", "nation", "customer", "supplier", "part", "lineitem", "events", "conversations"):
            read(spark, sf_dir, name).createOrReplaceTempView(name)
        orders_table(spark, sf_dir).scan().createOrReplaceTempView("orders_t")
        events_table(spark, sf_dir).scan().createOrReplaceTempView("events_t")
        if "lineitem_t" in body:
            lineitem_table(spark, sf_dir).scan().createOrReplaceTempView("lineitem_t")
        return spark.sql(body, args)

    return query


for _name, (_spark, _duck) in {**SURFACE, **CH}.items():
    QUERIES[_name] = _surface(_spark)
    ORACLE_SQL[_name] = tiered_sql(_duck, orders_t=LOGICAL, events_t=EVENTS, lineitem_t="SELECT * FROM lineitem")

for _name, (_spark, _args, _duck) in PARAMETERS.items():
    QUERIES[_name] = _surface(_spark, _args)
    ORACLE_SQL[_name] = tiered_sql(_duck, orders_t=LOGICAL, events_t=EVENTS)
