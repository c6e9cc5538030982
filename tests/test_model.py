import datetime as dt

import pytest

from firnline.model import OlderThan, Options, RowLimit, SequenceIds, TierError, instant_of, need_scope, policy_from_json, policy_to_json, seq_of
from firnline.sources.storage import fill


@pytest.mark.parametrize(
    ("excess", "chunk", "file", "cap", "rows"),
    [
        (505, 1000, 1000, 10_000, 0), (1000, 1000, 1000, 10_000, 1000), (1250, 1000, 1000, 10_000, 1000), (1500, 1000, 1000, 10_000, 1500), (1000, 300, 1000, 10_000, 1000),
        (900, 300, 1000, 10_000, 0), (25_000, 1000, 1000, 10_000, 10_000), (0, 1, 1, 10, 0), (-5, 1, 1, 10, 0), (7, 1, 1, 5, 5),
    ],
)
def test_rows_to_flush(excess, chunk, file, cap, rows):
    assert RowLimit(100, chunk, file, cap).rows_to_flush(100 + excess) == rows


def test_age_keeps_calendar_months():
    cut = OlderThan(months=1, days=1).cut(dt.datetime(2024, 3, 31, tzinfo=dt.UTC))
    assert instant_of(cut) == dt.datetime(2024, 2, 28, tzinfo=dt.UTC)
    assert OlderThan(min_flush_rows=10, max_rows_per_file=20).rows_to_flush(15) == 0
    assert OlderThan(min_flush_rows=10, max_rows_per_file=10, max_rows_per_flush=12).rows_to_flush(15) == 12


def test_sequence_ids_rise_above_any_floor():
    ids = SequenceIds(3)
    a = ids.next(rows=10)
    b = ids.next()
    assert b > a + 9
    assert ids.next(floor=1 << 61) > 1 << 61
    t = dt.datetime(2025, 5, 6, 7, 8, 9, tzinfo=dt.UTC)
    assert instant_of(seq_of(t)) == t


def test_policies_and_options_survive_json():
    for p in (RowLimit(5), OlderThan(days=3)):
        assert policy_from_json(policy_to_json(p)) == p
    with pytest.raises(TierError):
        policy_from_json({"kind": "filter"})
    with pytest.raises(TierError):
        Options(RowLimit(1), compression="lzo")


def test_scope_and_paths():
    assert need_scope(" a ") == "a"
    for bad in (None, "", "  "):
        with pytest.raises(TierError):
            need_scope(bad)
    assert fill("{namespace}/{tableName}/{scopeId}/", "app", "items") == "app/items/"
    assert fill("{namespace}/{tableName}/{scopeId}/", "app", "items", "u1") == "app/items/u1/"
    with pytest.raises(ValueError):
        fill("{what}/", "a", "b")
