"""Functions for queries over tiered tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import __version__
from ..model import EPOCH, SequenceIds, seq_of

_ids = SequenceIds()


def snowflake_id() -> int:
    """A new id, above all that this process has given."""
    return _ids.next()


def version() -> str:
    return __version__


def instant(seq: Column | str) -> Column:
    """The instant within a sequence id, as a timestamp."""
    start = int((EPOCH - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)).total_seconds() * 1000)
    return F.timestamp_millis(F.shiftright(seq, 22) + F.lit(start))


def since(t: dt.datetime) -> int:
    """The least sequence id of an instant: a cursor for the change feed."""
    return seq_of(t)


def key_digest(*key: str) -> Column:
    """SHA-256 of a key's JSON: the identity of a row across stores."""
    return F.sha2(F.to_json(F.struct(*key)), 256)


def user_id(table) -> str | None:
    """The scope that a handle is in; None without one."""
    return table.scope.strip() if table.scope and table.scope.strip() else None
