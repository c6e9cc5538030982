import datetime as dt

import pytest
from pyspark.sql import functions as F

from firnline import functions as fn
from firnline.functions import user_id
from firnline.model import OlderThan, Options, RowLimit, TierError, instant_of, seq_of
from firnline.operators import schedule
from firnline.operators.storages import Storages
from firnline.operators.table import TieredTable
from firnline.streaming import capture

NOW = dt.datetime(2025, 3, 1, 12, tzinfo=dt.UTC)


def table(spark, path, policy, times):
    df = spark.createDataFrame([(i, "x", seq_of(t) + i) for i, t in enumerate(times)], "id long, body string, s long")
    t = TieredTable.manage(spark, str(path), path.name, df.drop("s").schema, ["id"], Options(policy))
    t.insert(df, "s")
    return t


def test_storages(spark, tmp_path):
    s = Storages(spark, str(tmp_path / "registry"))
    assert s.register("main", "filesystem", str(tmp_path / "data"))
    assert s.root_of("main", "app", "items", "u1").endswith("/data/app/items/u1")
    s.alter("main", path=str(tmp_path / "other"))
    assert s.root_of("main", "app", "items").endswith("/other/app/items") and s.names() == ["main"]
    for bad in (lambda: s.register("main", "filesystem", "/x"), lambda: s.register("b", "tape", "/x"), lambda: s.register("b", "s3", "/x"), lambda: s.root_of("no", "a", "b"), lambda: s.alter("no")):
        with pytest.raises(TierError):
            bad()


def test_due_times(spark, tmp_path):
    day = dt.timedelta(days=1)
    times = [NOW - 9 * day, NOW - 8 * day, NOW - 2 * day]
    t = table(spark, tmp_path / "aged", OlderThan(days=10, min_flush_rows=2, max_rows_per_file=2), times)
    due = schedule.next_due(t, NOW)
    assert abs(due - (NOW + 2 * day)) < dt.timedelta(seconds=1)
    assert schedule.tick([t], NOW)["aged"]["status"] == "nothing_to_flush"
    assert schedule.tick([t], due + dt.timedelta(seconds=1))["aged"]["rows"] == 2
    assert schedule.next_due(t, NOW) is None and t.scan().count() == 3
    t.alter(auto_flush=False)
    assert schedule.tick([t], NOW) == {}


def test_rows_due(spark, tmp_path):
    t = table(spark, tmp_path / "rows", RowLimit(1, 1, 1), [NOW] * 4)
    assert schedule.next_due(t, NOW) == NOW
    assert schedule.tick([t])["rows"]["rows"] == 3 and schedule.next_due(t, NOW) is None


def test_functions(spark):
    a, b = fn.snowflake_id(), fn.snowflake_id()
    assert b > a and fn.version()
    row = spark.createDataFrame([(seq_of(NOW) + 5, 1)], "seq long, id long").select(fn.instant("seq").cast("string").alias("t"), fn.key_digest("id").alias("d"), F.sha2(F.lit('{"id":1}'), 256).alias("e")).first()
    assert row["t"] == "2025-03-01 12:00:00" and row["d"] == row["e"]
    assert instant_of(fn.since(NOW)) == NOW


def test_rules_conditions_and_drop(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2], i * 10) for i in range(1, 13)], "id long, team string, pay int")
    t = TieredTable.manage(spark, str(tmp_path / "r"), "r", df.schema, ["id"], Options(RowLimit(0, 1, 4), scope_column="team"), rows=df)
    t.flush(force=True)
    t.insert(spark.createDataFrame([(i, "ab"[i % 2], i * 10) for i in range(20, 24)] + [(30, None, 1)], df.schema))
    a = t.guarded("team = 'a'")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    mine = [2, 4, 6, 8, 10, 12, 20, 22]
    assert ids(a.scan()) == ids(a.scan(where="true OR team = 'b'")) == ids(a.page(None, 99)) == mine  # no answer (30) is no
    assert ids(a.scan([("id", "=", 3)])) == ids(a.scan([("id", "=", 21)])) == [] and ids(a.scan(limit=50)) == mine
    assert ids(a.scan(order_by=[("id", False)], limit=3)) == [12, 20, 22] and ids(a.guarded("id > 9 OR id = 3").scan()) == [10, 12, 20, 22]
    for text in ("true) OR (true", "team = 'a'); --"):
        with pytest.raises(Exception):  # noqa: B017
            t.guarded(text).scan().collect()
    assert a.update_where("true", {"pay": "pay + 1"}) == 2 and a.delete_where("id = 21") == 0
    with pytest.raises(TierError, match="not allow"):
        a.insert(spark.createDataFrame([(40, "b", 1)], df.schema))
    with pytest.raises(TierError, match="not allow"):
        t.guarded("pay < 300").update_where("id = 20", {"pay": "900"})
    with pytest.raises(TierError, match="refused"):
        a.changes_since()
    for c in ("id", "team"):
        with pytest.raises(TierError, match="can't be changed"):
            t.update_where("true", {c: "1"})
    assert {r["id"]: r["pay"] for r in t.scan(where="id >= 20").collect()} == {20: 201, 21: 210, 22: 221, 23: 230, 30: 1}
    with pytest.raises(TierError, match="still managed"):
        capture.teardown(None, t, str(tmp_path / "cp"))
    (tmp_path / "cp" / "offsets").mkdir(parents=True)
    t.drop()
    assert not [p for p in (tmp_path / "r").rglob("*") if p.is_file() and not p.name.startswith(".")]
    capture.teardown(None, t, str(tmp_path / "cp"))
    assert not (tmp_path / "cp").exists() and user_id(t.in_scope(" u ")) == "u" and user_id(t) is None
    with pytest.raises(TierError, match="no tiered table"):
        t.scan()
