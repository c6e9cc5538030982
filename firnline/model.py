"""Vocabulary of tiered tables: operations, options, types, sequence ids and scopes."""

from __future__ import annotations

import datetime as dt
import threading
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

INSERT, UPDATE, DELETE = 1, 2, 3
#: Columns that hot and cold files carry beside those of the application.
SEQ, OP, DELETED, VERSION = "_seq", "_op", "_deleted", "_schema_version"
FORCE_TOMBSTONES_ONLY = 4096

#: Types that a column may have, and those whose bounds choose segments.
STORABLE = (T.BooleanType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.DecimalType, T.BinaryType, T.TimestampType, T.TimestampNTZType)
ORDERABLE = (T.BooleanType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)


class TierError(ValueError):
    """A request that a tiered table refuses."""


def check_type(name: str, kind: T.DataType) -> None:
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return
    if not isinstance(kind, STORABLE):
        raise TierError(f"column {name!r} has unsupported type {kind.simpleString()}")


@dataclass(frozen=True)
class RowLimit:
    """Keep about ``hot_row_limit`` changed rows hot."""

    hot_row_limit: int
    min_flush_rows: int = 1000
    max_rows_per_file: int = 1000
    max_rows_per_flush: int = 10_000

    def rows_to_flush(self, pending: int) -> int:
        """Whole chunks of min_flush_rows, a last one from half a chunk on, within the cap; at least one full file or nothing."""
        excess = pending - self.hot_row_limit
        if excess < max(1, self.min_flush_rows):
            return 0
        chunks, rest = divmod(excess, max(1, self.min_flush_rows))
        rows = excess if rest >= self.min_flush_rows // 2 else chunks * self.min_flush_rows
        rows = min(rows, self.max_rows_per_flush)
        full = max(1, self.max_rows_per_file)
        if rows < full:
            rows = min(full, self.max_rows_per_flush) if excess >= full else 0
        return rows


@dataclass(frozen=True)
class OlderThan:
    """Flush rows that changed longer ago than an age, kept as months, days and microseconds."""

    months: int = 0
    days: int = 0
    microseconds: int = 0
    min_flush_rows: int = 1000
    max_rows_per_file: int = 1000
    max_rows_per_flush: int = 10_000

    def cut(self, now: dt.datetime) -> int:
        """The least sequence id that is still young at ``now``."""
        month = now.month - 1 - self.months
        year, month = now.year + month // 12, month % 12 + 1
        last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day
        then = now.replace(year=year, month=month, day=min(now.day, last)) - dt.timedelta(days=self.days, microseconds=self.microseconds)
        return seq_of(then)

    def rows_to_flush(self, old: int) -> int:
        if old < max(1, self.min_flush_rows) or old < max(1, self.max_rows_per_file):
            return 0
        return min(old, self.max_rows_per_flush)


Policy = RowLimit | OlderThan


def policy_to_json(policy: Policy) -> dict:
    return {"kind": "row_limit" if isinstance(policy, RowLimit) else "older_than", **asdict(policy)}


def policy_from_json(held: dict) -> Policy:
    held = dict(held)
    kind = held.pop("kind")
    if kind == "filter":
        raise TierError("filter policies are reserved")
    return {"row_limit": RowLimit, "older_than": OlderThan}[kind](**held)


@dataclass
class Options:
    """What a table is managed with."""

    policy: Policy
    compression: str = "zstd"
    order_column: str | None = None
    scope_column: str | None = None
    bloom_columns: list[str] = field(default_factory=list)
    auto_flush: bool = True

    def to_json(self) -> dict:
        return {**asdict(self), "policy": policy_to_json(self.policy)}

    @classmethod
    def from_json(cls, held: dict) -> Options:
        return cls(**{**held, "policy": policy_from_json(held["policy"])})

    def __post_init__(self):
        if self.compression not in ("zstd", "snappy", "none"):
            raise TierError(f"unknown compression {self.compression!r}")


# Sequence ids: 41 bits of milliseconds since the epoch below, 10 bits of worker, 12 bits of counter.
EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
_WORKER_BITS, _COUNTER_BITS = 10, 12


def _utc(t: dt.datetime) -> dt.datetime:
    return t if t.tzinfo else t.replace(tzinfo=dt.UTC)


def seq_of(t: dt.datetime) -> int:
    """The least sequence id of an instant."""
    return max(0, (_utc(t) - EPOCH) // dt.timedelta(milliseconds=1)) << _WORKER_BITS + _COUNTER_BITS


def instant_of(seq: int) -> dt.datetime:
    return EPOCH + dt.timedelta(milliseconds=seq >> _WORKER_BITS + _COUNTER_BITS)


class SequenceIds:
    """Rising ids above any floor; a block of consecutive ids serves a whole batch of rows."""

    def __init__(self, worker: int = 0):
        self._worker, self._last, self._lock = worker % (1 << _WORKER_BITS), 0, threading.Lock()

    def next(self, floor: int = 0, rows: int = 1) -> int:
        """The first of ``rows`` consecutive ids, all above ``floor`` and all that were given before."""
        with self._lock:
            now = seq_of(dt.datetime.fromtimestamp(time.time(), dt.UTC)) | self._worker << _COUNTER_BITS
            first = max(now, floor + 1, self._last + 1)
            self._last = first + rows - 1
            return first


def need_scope(scope: str | None) -> str:
    """The trimmed scope; without one, calls that change or follow a user table are refused."""
    if scope is None or not scope.strip():
        raise TierError("this table needs an active scope")
    return scope.strip()
