import random

import pytest
from pyspark.sql import functions as F

from firnline.model import DELETE, OP, SEQ, Options, RowLimit, TierError
from firnline.operators import care
from firnline.operators import flush as flushing
from firnline.operators.feed import RetentionGap
from firnline.operators.table import TieredTable
from firnline.plans.merge import Reader, cold_best, cold_proven_empty, strategy_of
from firnline.plans.prune import Filter, candidates, keys_apart


def make(spark, tmp_path, rows=(), schema="id long, body string, qty int", pk=("id",), policy=RowLimit(0, 1, 4, 1 << 40), **options):
    df = spark.createDataFrame(list(rows), schema)
    return TieredTable.manage(spark, str(tmp_path / "t"), "t", df.schema, list(pk), Options(policy, **options), rows=df if rows else None), df


def got(df):
    return sorted(tuple(r) for r in df.collect())


ROWS = [(i, f"row-{i}", i % 7) for i in range(1, 21)]


def test_empty_and_one_row(spark, tmp_path):
    t, df = make(spark, tmp_path)
    assert t.scan().count() == 0
    assert t.flush(force=True)["status"] == "nothing_to_flush"
    t.insert(spark.createDataFrame([(1, "only", 1)], df.schema))
    assert got(t.scan()) == [(1, "only", 1)]
    t.flush(force=True)
    assert got(t.scan()) == [(1, "only", 1)] and t.status()["hot_rows"] == 0


def test_changes_follow_legal_history(spark, tmp_path):
    t, df = make(spark, tmp_path)
    new = lambda *rows: spark.createDataFrame(list(rows), df.schema)
    t.insert(new((1, "one", 1), (2, "two", 2), (3, "three", 3)))
    assert t.update(new((2, "two-u", 12))) == 1
    assert t.delete(new((3, "", 0)).select("id")) == 1
    assert t.delete(new((99, "", 0)).select("id")) == 0
    t.insert(new((3, "reinsert", 9)))
    assert got(t.scan()) == [(1, "one", 1), (2, "two-u", 12), (3, "reinsert", 9)]
    with pytest.raises(TierError, match="duplicate"):
        t.insert(new((1, "again", 1)))
    t.flush(force=True)
    assert t.update(new((1, "cold", 1))) == 0  # cold rows are not reached by updates and deletes
    assert t.delete(new((1, "", 0)).select("id")) == 0
    assert got(t.scan())[0] == (1, "one", 1)
    t.insert(new((1, "hot", 5)))
    assert got(t.scan([("id", "=", 1)])) == [(1, "hot", 5)] and t.report.path == "hot_native" and t.report.opened == 0


def test_cold_tombstone_beats_older_cold_versions_and_filters_come_last(spark, tmp_path):
    t, df = make(spark, tmp_path, ROWS)
    t.flush(force=True)
    again = df.where("id IN (5, 6)").withColumn("body", F.lit("new"))
    t.insert(again)
    t.delete(again.where("id = 5").select("id"))
    assert [r[0] for r in got(t.scan([("id", "between", (4, 7))]))] == [4, 6, 7]
    t.flush(force=True)  # few tombstones go alone
    reader = Reader(t.catalog, t.snapshot)
    assert reader.cold(t.snapshot.active).where(F.col(OP) == DELETE).count() == 1
    assert [r[0] for r in got(t.scan([("id", "between", (4, 7))]))] == [4, 6, 7]
    t.flush(force=True)
    assert got(t.scan(where="body = 'row-6'")) == []  # the old version must not come back
    assert got(t.scan(where="body = 'new'")) == [(6, "new", 6)]


def test_pruning_keeps_what_it_cannot_rule_out(spark, tmp_path):
    t, _ = make(spark, tmp_path, ROWS)
    t.flush(force=True)
    held = t.snapshot
    assert len(held.active) == 5 and keys_apart(held.active)
    assert got(t.scan([("id", "=", 9)])) == [(9, "row-9", 2)]
    assert (t.report.considered, t.report.opened, t.report.strategy) == (5, 1, "exact_primary_key")
    assert len(candidates(held, [Filter("id", ">", 20)])) == 1  # open bounds are widened
    assert cold_proven_empty(held, [("id", ">=", 21)]) and cold_proven_empty(held, [("id", "in", (99,))]) and not cold_proven_empty(held, [("id", "in", (9, 99))])
    held.segments[0].bounds[1] = (None, None, 0)
    assert len(candidates(held, [Filter("id", "=", 9)], held.segments)) == 2
    with pytest.raises(TierError, match="inverted"):
        Filter("id", "between", (9, 1))
    assert cold_best(t.snapshot, "id", True) == 1 and cold_best(t.snapshot, "id", False) == 20


def test_strategies(spark, tmp_path):
    t, df = make(spark, tmp_path, ROWS)
    t.flush(force=True)
    t.insert(spark.createDataFrame([(i, "hot", 0) for i in range(100, 106)], df.schema))
    held = t.snapshot
    assert strategy_of(held, [Filter("id", "=", 1)], [("id", True)], 3) == "exact_primary_key"
    assert strategy_of(held, [], [("id", True)], 3) == "ordered_progressive"
    assert strategy_of(held, [], [], 3) == "unordered_hot_first"
    assert strategy_of(held, [], [], None) == "general_merge"
    assert [r[0] for r in t.scan(order_by=[("id", False)], limit=5).collect()] == [105, 104, 103, 102, 101]
    assert t.report.opened == 0
    assert [r[0] for r in t.scan(order_by=[("id", True)], limit=3).collect()] == [1, 2, 3]
    assert t.report.opened <= 4
    assert [r[0] for r in t.scan(order_by=[("qty", False)], limit=3, late=True).collect()] == [6, 13, 20]
    assert t.scan(limit=4).count() == 4 and t.report.path == "unordered_hot_first"
    assert t.scan(limit=20).count() == 20 and t.report.opened == 5
    assert [r[0] for r in t.page((18,), 4).collect()] == [19, 20, 100, 101]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_history_equals_a_plain_table(spark, tmp_path, seed):
    r = random.Random(seed)
    t, df = make(spark, tmp_path, policy=RowLimit(3, 1, 3, 1 << 40))
    twin, hot = {}, set()
    for step in range(9):
        kind = r.choice(["insert", "insert", "update", "delete", "flush", "force"])
        if kind == "insert":
            rows = [(i, f"s{step}", r.randint(0, 9)) for i in r.sample(range(12), 4) if i not in hot]
            if rows:
                t.insert(spark.createDataFrame(rows, df.schema))
                twin.update({x[0]: x for x in rows})
                hot |= {x[0] for x in rows}
        elif kind == "update":
            rows = [(i, f"u{step}", 1) for i in r.sample(range(12), 5)]
            t.update(spark.createDataFrame(rows, df.schema))
            twin.update({x[0]: x for x in rows if x[0] in hot})
        elif kind == "delete":
            keys = r.sample(range(12), 4)
            t.delete(spark.createDataFrame([(i,) for i in keys], "id long"))
            for i in hot & set(keys):
                del twin[i]
            hot -= set(keys)
        else:
            t.flush(force=kind == "force")
            hot = {x[0] for x in Reader(t.catalog, t.snapshot).hot().select("id").collect()}
        assert got(t.scan()) == sorted(twin.values()), (seed, step, kind)
    assert t.verify()["ok"], t.verify()


def test_feed_pages_make_the_whole_feed(spark, tmp_path):
    t, df = make(spark, tmp_path, ROWS)
    t.flush(force=True)
    t.insert(df.where("id < 4"))
    t.delete(df.where("id = 2").select("id"))
    whole = [tuple(r) for r in t.changes_since(limit_rows=1000).collect()]
    assert len(whole) == 23 and [w[0] for w in whole] == sorted(w[0] for w in whole)
    assert {w[5] for w in whole[:20]} == {"cold"} and all(w[4] is None for w in whole[20:])
    pages, cursor = [], 0
    while page := [tuple(r) for r in t.changes_since(cursor, 7).collect()]:
        pages += page
        cursor = page[-1][0]
    assert pages == whole
    assert [tuple(r) for r in t.changes_since(last_rows=5).collect()] == whole[-5:]
    assert [tuple(r) for r in t.changes_since(whole[9][0], 1000, 5).collect()] == whole[10:]
    for bad in ({"since_seq": -1}, {"limit_rows": 0}, {"last_rows": 0}, {"limit_rows": 3, "last_rows": 4}):
        with pytest.raises(TierError):
            t.changes_since(**bad)
    with pytest.raises(RetentionGap) as gap:
        t.changes_since(1)
    assert gap.value.oldest_available == whole[0][0]


def test_scope(spark, tmp_path):
    rows = [(1, "user-a", "x"), (2, "user-a", "y"), (3, "user-b", "z")]
    df = spark.createDataFrame(rows, "id long, user_id string, title string")
    t = TieredTable.manage(spark, str(tmp_path / "t"), "notes", df.schema, ["user_id", "id"], Options(RowLimit(0, 1, 2), scope_column="user_id"), "user", df)
    t.flush()
    assert t.scan().count() == 0 and t.in_scope("user-a").scan().count() == 2 and t.in_scope(" user-b ").scan().count() == 1
    with pytest.raises(TierError, match="scope"):
        t.changes_since()
    with pytest.raises(TierError, match="another scope"):
        t.in_scope("user-a").insert(spark.createDataFrame([(9, "user-b", "")], df.schema))
    assert t.in_scope("user-a").changes_since().count() == 2
    assert t.in_scope("user-a' OR '1'='1").scan().count() == 0


def notes(spark, tmp_path, pk):
    rows = [(i, f"user-{'ab'[i % 2]}", f"t{i}") for i in range(1, 21)]
    df = spark.createDataFrame(rows, "id long, user_id string, title string")
    t = TieredTable.manage(spark, str(tmp_path / "n"), "notes", df.schema, pk, Options(RowLimit(0, 1, 4), scope_column="user_id"), "user", df)
    t.flush(force=True)
    t._apply(spark.createDataFrame([(i, f"user-{'ab'[i % 2]}", "hot") for i in range(19, 25)], df.schema), 1, None, check=False)
    return t, df


@pytest.mark.parametrize(("where", "pk"), [("true OR user_id <> 'user-a'", ["id"]), ("NOT (user_id = 'user-a') OR title LIKE 't%'", ["user_id", "id"])])
def test_no_filter_reaches_beyond_the_scope(spark, tmp_path, where, pk):
    """Cold, hot and shadowed rows, by each strategy."""
    t, _ = notes(spark, tmp_path, pk)
    a = t.in_scope("user-a")
    mine = lambda df: {r["user_id"] for r in df.collect()} <= {"user-a"}
    assert mine(a.scan(where=where)) and mine(a.scan([("id", "=", 3)], where=where)) and mine(a.scan([("id", "=", 23)], where=where)) and mine(a.scan(where=where, limit=50))
    assert mine(a.scan(where=where, order_by=[("id", False)], limit=50)) and mine(a.scan(where=where, order_by=[("id", True)], limit=50, late=True)) and mine(a.page(None, 50))
    for text in ("true) OR (true", "1=1) OR (1=1", "true); --", "true) OR user_id IN ('user-b'"):
        with pytest.raises(Exception):  # noqa: B017
            a.scan(where=text).collect()
    assert [r["id"] for r in a.scan(order_by=[("id", False)], limit=3).collect()] == [24, 22, 20]
    assert t.scan(where=where).count() == 0 and t.in_scope("").scan(where=where).count() == 0


def test_a_scope_does_not_change_rows_of_another(spark, tmp_path):
    t, df = notes(spark, tmp_path, ["id"])
    a = t.in_scope("user-a")
    assert a.update(spark.createDataFrame([(19, "user-a", "taken")], df.schema)) == 0  # 19 is user-b's
    assert a.delete(spark.createDataFrame([(21, "user-a", "")], df.schema)) == 0
    assert a.update(spark.createDataFrame([(20, "user-a", "own")], df.schema)) == 1
    assert {r["id"]: r["title"] for r in t.in_scope("user-b").scan([("id", ">=", 19)]).collect()} == {19: "hot", 21: "hot", 23: "hot"}


def test_refused_at_registration(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "id long, s string")
    opt = Options(RowLimit(1))
    manage = lambda schema, pk, o=opt, kind="shared", rows=None: TieredTable.manage(spark, str(tmp_path / "x"), "x", schema, pk, o, kind, rows)
    with pytest.raises(TierError, match="primary key"):
        manage(df.schema, [])
    with pytest.raises(TierError, match="repeated"):
        manage(df.schema, ["id"], rows=df)
    with pytest.raises(TierError, match="unsupported"):
        manage(spark.createDataFrame([], "id long, m map<string,int>").schema, ["id"])
    with pytest.raises(TierError, match="order"):
        manage(df.schema, ["id"], Options(RowLimit(1), order_column="s"))
    with pytest.raises(TierError, match="scope"):
        manage(df.schema, ["id"], kind="user")
    manage(df.schema, ["id"])
    with pytest.raises(TierError, match="already managed"):
        manage(df.schema, ["id"])


def test_schema_evolution(spark, tmp_path):
    t, _ = make(spark, tmp_path, ROWS[:6])
    t.flush(force=True)
    t.rename_column("body", "note")
    t.add_column("extra", "double")
    t.drop_column("qty")
    t.add_column("qty", "int")
    t.insert(spark.createDataFrame([(50, "n", 1.5, 7)], "id long, note string, extra double, qty int"))
    rows = {r["id"]: r for r in t.scan().collect()}
    assert rows[1]["note"] == "row-1" and rows[1]["extra"] is None and rows[1]["qty"] is None and rows[50]["qty"] == 7
    for bad in (lambda: t.rename_column("id", "k"), lambda: t.drop_column("id"), lambda: t.add_column("note", "int"), lambda: t.add_column("m", "map<int,int>")):
        with pytest.raises(TierError):
            bad()


@pytest.mark.parametrize("point", ["staged", "published", "before_activate"])
def test_a_failed_flush_loses_nothing_and_is_cleaned_up(spark, tmp_path, point):
    t, _ = make(spark, tmp_path, ROWS)

    def crash():
        raise RuntimeError("stop here")

    flushing.FAILPOINTS[point] = crash
    try:
        with pytest.raises(RuntimeError, match="stop here"):
            t.flush(force=True)
    finally:
        flushing.FAILPOINTS.clear()
    assert got(t.scan()) == ROWS and t.jobs(["failed"]).count() == 1
    found = t.recover(dry_run=True)
    assert found["staged_deleted"] or found["quarantined"]
    t.recover(dry_run=False)
    assert t.recover() == {"staged_deleted": [], "quarantined": [], "dry_run": True}
    assert t.flush(force=True)["ok"] and got(t.scan()) == ROWS and t.verify()["ok"]


@pytest.mark.parametrize(("point", "kind"), [("staged", "all"), ("published", "insert"), ("before_activate", "capture")])
def test_changes_during_a_flush_lose_nothing(spark, tmp_path, point, kind):
    t, df = make(spark, tmp_path, ROWS)
    other, twin = TieredTable(spark, t.catalog.store.root), {r[0]: r for r in ROWS}
    new = lambda *rows: spark.createDataFrame(list(rows), df.schema)

    def change():
        if kind in ("insert", "all"):
            other.insert(new((100, "new", 0)))
            twin[100] = (100, "new", 0)
        if kind in ("update", "all"):
            assert other.update(new((3, "changed", 0), (20, "changed", 1))) == 2
            twin.update({3: (3, "changed", 0), 20: (20, "changed", 1)})
        if kind in ("delete", "all"):
            assert other.delete(new((5, "", 0)).select("id")) == 1
            del twin[5]
        if kind == "capture":
            top = other.snapshot.held["max_seq"]
            other.apply_changes(spark.createDataFrame([(7, "folded", 0, top + 1, 2), (8, None, None, top + 2, 3), (101, "n", 1, top + 3, 1)], "id long, body string, qty int, seq long, op int"), 0)
            twin.update({7: (7, "folded", 0), 101: (101, "n", 1)})
            del twin[8]

    flushing.FAILPOINTS[point] = change
    try:
        assert t.flush(force=True)["rows"] == 20
    finally:
        flushing.FAILPOINTS.clear()
    assert got(t.scan()) == sorted(twin.values()) and t.verify()["ok"] and t.recover()["quarantined"] == []
    assert t.flush(force=True, passes=5)["ok"] and got(t.scan()) == sorted(twin.values()) and t.status()["pending_changes"] == 0


def test_jobs_are_taken_up_and_taken_over(spark, tmp_path):
    import datetime as dt

    from firnline.operators import schedule

    t, _ = make(spark, tmp_path, ROWS, policy=RowLimit(0, 1, 4, 8))
    job = care.enqueue_flush(t.catalog)
    done = schedule.tick([t])["t"]
    assert done["job_id"] == job and done["rows"] == 8 and t.jobs(["completed"]).count() == 1
    assert schedule.candidate(t) and schedule.tick([t])["t"]["rows"] == 8  # not blocked by what has ended
    held = t.catalog.load()
    draft = held.draft()
    draft["jobs"].append({"id": "dead", "type": "flush", "status": "running", "token": "x", "rows": 1, "error": None, "created_at": "2020-01-01T00:00:00+00:00", "lease_until": (dt.datetime.now(dt.UTC) + dt.timedelta(hours=1)).isoformat()})
    t.catalog.publish(draft, held.version)
    assert t.flush()["status"] == "busy" and not schedule.candidate(t)
    held = t.catalog.load()
    draft = held.draft()
    draft["jobs"][-1]["lease_until"] = "2020-01-01T01:00:00+00:00"
    t.catalog.publish(draft, held.version)
    assert t.flush()["ok"] and {r["id"] for r in t.jobs(["failed"]).collect()} == {"dead"} and t.scan().count() == 20
    t.insert(spark.createDataFrame([(100, "x", 1)], "id long, body string, qty int"))
    flushing.FAILPOINTS["before_activate"] = lambda: care.cancel_job(t.catalog)
    try:
        with pytest.raises(flushing.Lost):
            t.flush(force=True)
    finally:
        flushing.FAILPOINTS.clear()
    assert t.scan().count() == 21 and t.jobs(["cancelled"]).count() == 1


def test_one_of_many_creators_wins_and_its_file_is_whole(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from firnline.sources.storage import Store

    store = Store(spark, str(tmp_path))
    for k in range(3):
        with ThreadPoolExecutor(8) as pool:
            won = list(pool.map(lambda i, k=k: store.create(f"c/v{k}.json", f"{i}" * 1000), range(8)))
        assert sum(won) == 1 and store.read(f"c/v{k}.json") == f"{won.index(True)}" * 1000
    assert store.names("c") == ["v0.json", "v1.json", "v2.json"]


def test_only_overlapping_segments_are_deduplicated(spark, tmp_path):
    rows = [(t, i, f"{t}-{i}") for t in ("a", "b") for i in range(20)]
    t, df = make(spark, tmp_path, rows, "tenant string, id long, body string", ("tenant", "id"), RowLimit(0, 1, 5, 1 << 40))
    t.flush(force=True)
    assert len(t.snapshot.active) == 8
    plan = t.scan()._jdf.queryExecution().executedPlan().toString()
    assert not t.report.deduplicated and "Window" not in plan  # though first key columns overlap
    t.insert(df.where("tenant = 'a' AND id BETWEEN 7 AND 8").withColumn("body", F.lit("new")))
    t.flush(force=True)
    found = {r[:2]: r[2] for r in got(t.scan())}
    assert t.report.deduplicated and t.report.overlapping == 2 and t.report.opened == 9
    assert found == {r[:2]: "new" if r[0] == "a" and r[1] in (7, 8) else r[2] for r in rows}
    assert got(t.scan([("id", "in", (3, 99))])) == [("a", 3, "a-3"), ("b", 3, "b-3")] and t.report.opened == 2
    assert t.changes_since(0, 7).count() == 7


def test_the_nth_seq_needs_no_sort(spark):
    r = random.Random(4)
    for n, spread in ((1, 10), (50, 30), (30_000, 1 << 60), (30_000, 500)):
        values = sorted(r.randrange(spread) for _ in range(n))
        df = spark.createDataFrame([(v,) for v in values], f"{SEQ} long")
        for k in {1, n, (n + 1) // 2, max(1, n - 1)}:
            assert flushing.nth(df, k) == values[k - 1]
        assert flushing.nth(df, n + 1) is None


def test_vacuum_keeps_what_a_version_names(spark, tmp_path):
    import datetime as dt

    t, df = make(spark, tmp_path, ROWS)
    for i in range(3):
        t.update(df.where(f"id = {i + 1}").withColumn("body", F.lit("u")))
    want = got(t.scan())
    assert t.vacuum() == {"files": [], "versions": []}  # nothing is a day old
    found = t.vacuum(dt.timedelta(0))
    assert found["versions"] and {f.split("/")[0] for f in found["files"]} == {"hot", "index", "_changes"}
    assert got(t.scan()) == want and t.verify()["ok"] and len(t.catalog.versions()) == 1 and len(t.catalog.store.names("hot")) == 1
    t.flush(force=True)
    assert got(t.scan()) == want and t.vacuum(dt.timedelta(0))["files"]


def test_two_writers_of_one_version(spark, tmp_path):
    from firnline.catalog import Conflict

    t, _ = make(spark, tmp_path, ROWS)
    held = t.snapshot
    t.catalog.publish(held.draft(), held.version)
    with pytest.raises(Conflict):
        t.catalog.publish(held.draft(), held.version)


def test_jobs_manifest_and_detaching(spark, tmp_path):
    t, _ = make(spark, tmp_path, ROWS)
    job = care.enqueue_flush(t.catalog)
    assert job and care.enqueue_flush(t.catalog) is None
    assert care.cancel_job(t.catalog, job) == 1 and care.cancel_job(t.catalog) == 0
    t.flush(force=True)
    assert t.jobs(["completed"], ["flush"]).count() == 1
    import datetime as dt

    assert care.purge_jobs(t.catalog, dt.timedelta(0)) == 2
    root = care.export_manifest(t.catalog)
    assert root["files"]["total_files"] == 5
    assert sum(s["row_count"] for s in care.read_manifest(t.catalog)["segments"]) == 20
    with pytest.raises(TierError):
        t.unmanage(drop_cold=True)
    assert t.unmanage(str(tmp_path / "plain"), drop_cold=True) == 20
    with pytest.raises(TierError, match="not managed"):
        t.scan()


def test_a_missing_cold_file_is_an_error(spark, tmp_path):
    t, _ = make(spark, tmp_path, ROWS)
    t.flush(force=True)
    t.catalog.store.delete(t.snapshot.active[0].path)
    assert not t.verify()["ok"]
    with pytest.raises(Exception):  # noqa: B017
        t.scan().collect()


def test_applied_batches_are_not_applied_again(spark, tmp_path):
    t, df = make(spark, tmp_path)
    changes = spark.createDataFrame([(1, "a", 1, 10, 1), (1, "b", 2, 11, 2), (2, "c", 3, 12, 1), (2, None, None, 13, 3)], "id long, body string, qty int, seq long, op int")
    assert t.apply_changes(changes, 0) == 2
    assert t.apply_changes(changes, 0) == 0 and t.apply_changes(changes, 1) == 0
    assert got(t.scan()) == [(1, "b", 2)]
    assert got(Reader(t.catalog, t.snapshot).index().select("id", SEQ, OP)) == [(1, 11, 2), (2, 13, 3)]


def test_a_change_writes_no_more_than_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flushing, "MOST_DELTAS", 3)
    monkeypatch.setattr(flushing, "SMALL", -1)
    t, df = make(spark, tmp_path, ROWS)
    base = t.snapshot.hot
    new = lambda *rows: spark.createDataFrame(list(rows), df.schema)
    t.update(new((3, "three", 0), (4, "four", 0)))
    assert t.snapshot.hot[:1] == base and spark.read.parquet(t.catalog.store.full(t.snapshot.hot[1]["path"])).count() == 2
    t.update(new((3, "three-again", 1)))
    t.delete(new((4, "", 0), (5, "", 0)).select("id"))
    held = t.snapshot
    assert len(held.deltas) == 3 and held.hot[:1] == base
    want = sorted([r for r in ROWS if r[0] not in (3, 4, 5)] + [(3, "three-again", 1)])
    assert got(t.scan()) == want and got(t.scan([("id", "=", 4)])) == [] and got(t.scan([("id", "=", 3)])) == [(3, "three-again", 1)]
    assert Reader(t.catalog, held).index().groupBy("id").count().where("count > 1").count() == 0
    t.insert(new((5, "back", 5)))  # a fourth delta: everything becomes one piece
    assert not t.snapshot.deltas and len(t.snapshot.hot) == len(t.snapshot.index) == 1
    assert got(t.scan()) == sorted([*want, (5, "back", 5)])
    assert t.verify()["ok"]


def test_deltas_during_a_flush(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flushing, "SMALL", -1)
    t, df = make(spark, tmp_path, ROWS)
    t.update(df.where("id = 1").withColumn("body", F.lit("before")))
    other = TieredTable(spark, t.catalog.store.root)

    def change():
        other.update(df.where("id IN (1, 2)").withColumn("body", F.lit("during")))
        other.delete(df.where("id = 3").select("id"))

    flushing.FAILPOINTS["before_activate"] = change
    try:
        t.flush(force=True)
    finally:
        flushing.FAILPOINTS.clear()
    want = sorted((i, "during" if i in (1, 2) else b, q) for i, b, q in ROWS if i != 3)
    assert got(t.scan()) == want
    assert sorted(r["id"] for r in Reader(t.catalog, t.snapshot).index().collect()) == [1, 2, 3]
    t.flush(force=True)
    t.flush(force=True)
    assert got(t.scan()) == want and t.status()["hot_rows"] == 0
