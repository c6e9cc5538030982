"""Versioned snapshots of a tiered table's catalog, published by create-if-absent.

A snapshot is one JSON document: columns with stable ids, every schema version, the hot and
change-index files, and each cold segment with its bounds. A reader resolves exactly one;
a writer publishes version n + 1 and fails if someone else has.
"""

from __future__ import annotations

import copy
import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .model import Options, TierError
from .sources.storage import Store


#: Change-index pieces whose entries may supersede older pieces; all others hold keys that no other piece has.
DELTA = "index/delta-"
#: How often a change is tried again after another writer was first.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another writer has published this version."""


def freeze(value):
    """A bound as JSON."""
    if isinstance(value, dt.datetime):
        return {"t": value.isoformat()}
    if isinstance(value, dt.date):
        return {"d": value.isoformat()}
    return value


def thaw(value):
    if isinstance(value, dict):
        return dt.datetime.fromisoformat(value["t"]) if "t" in value else dt.date.fromisoformat(value["d"])
    return value


@dataclass
class Segment:
    """One immutable Parquet file and what is known of it without opening it."""

    path: str
    rows: int
    deletes: int
    bytes: int
    min_seq: int
    max_seq: int
    schema_version: int
    batch: int
    bounds: dict[int, tuple]  # column id -> (least, greatest, nulls); least and greatest None if unknown
    scope: str | None = None
    status: str = "active"
    created_at: str = ""
    keys: tuple | None = None  # (least, greatest) whole key; None if unknown

    def to_json(self) -> dict:
        keys = None if self.keys is None else [[freeze(v) for v in key] for key in self.keys]
        return {**self.__dict__, "keys": keys, "bounds": {str(k): [freeze(a), freeze(b), n] for k, (a, b, n) in self.bounds.items()}}

    @classmethod
    def from_json(cls, held: dict) -> Segment:
        keys = None if held.get("keys") is None else tuple(tuple(thaw(v) for v in key) for key in held["keys"])
        return cls(**{**held, "keys": keys, "bounds": {int(k): (thaw(a), thaw(b), n) for k, (a, b, n) in held["bounds"].items()}})


class Snapshot:
    """One version of a table."""

    def __init__(self, held: dict):
        self.held = held
        self.version: int = held["version"]
        self.name: str = held["name"]
        self.pk: list[str] = held["pk"]
        self.kind: str = held["kind"]
        self.options = Options.from_json(held["options"])
        self.schema_version: int = held["schema_version"]
        self.hot: list[dict] = held["hot"]
        self.index: list[str] = held["index"]
        self.segments = [Segment.from_json(s) for s in held["segments"]]

    @property
    def active(self) -> list[Segment]:
        return [s for s in self.segments if s.status == "active"]

    @property
    def deltas(self) -> list[str]:
        return [p for p in self.index if p.startswith(DELTA)]

    def columns(self, version: int | None = None) -> list[tuple[int, str, T.DataType]]:
        """(id, name, type) of the columns of a schema version."""
        rows = self.held["schemas"][str(version or self.schema_version)]
        return [(c["id"], c["name"], T._parse_datatype_json_string(json.dumps(c["type"]))) for c in rows]

    def id_of(self, name: str) -> int:
        for i, n, _ in self.columns():
            if n == name:
                return i
        raise TierError(f"no column {name!r}")

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t) for _, n, t in self.columns()])

    def draft(self) -> dict:
        """A copy to change into the next version."""
        return copy.deepcopy(self.held)


class Catalog:
    """The snapshots of one table under ``root``/catalog."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = Store(spark, root)
        self.spark = spark

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self.store.names("catalog") if n.startswith("v") and n.endswith(".json")]

    def load(self, version: int | None = None) -> Snapshot:
        known = self.versions()
        if not known:
            raise TierError(f"no tiered table at {self.store.root}")
        return Snapshot(json.loads(self.store.read(f"catalog/v{version or max(known):010d}.json")))

    def publish(self, draft: dict, after: int) -> Snapshot:
        """Compare-and-set: ``draft`` becomes version ``after`` + 1 or Conflict is raised."""
        draft["version"] = after + 1
        draft["updated_at"] = dt.datetime.now(dt.UTC).isoformat()
        if not self.store.create(f"catalog/v{after + 1:010d}.json", json.dumps(draft)):
            raise Conflict(f"version {after + 1} of {draft['name']} exists")
        return Snapshot(draft)

    def update(self, change: Callable[[Snapshot, dict], object]) -> object:
        """Publish what ``change`` makes of a draft of the newest version, anew if another writer was first. Nothing is published if it returns None."""
        for _ in range(ATTEMPTS):
            held = self.load()
            draft = held.draft()
            out = change(held, draft)
            if out is None:
                return None
            try:
                self.publish(draft, held.version)
                return out
            except Conflict:
                continue
        raise Conflict(f"{ATTEMPTS} attempts were overtaken")

    def create(self, name: str, schema: T.StructType, pk: list[str], kind: str, options: Options) -> Snapshot:
        if self.versions():
            raise TierError(f"{name} is already managed")
        columns = [{"id": i + 1, "name": f.name, "type": json.loads(f.dataType.json())} for i, f in enumerate(schema)]
        draft = {
            "id": uuid.uuid4().hex, "name": name, "pk": pk, "kind": kind, "options": options.to_json(), "schema_version": 1, "schemas": {"1": columns},
            "next_column": len(columns) + 1, "next_batch": 1, "hot": [], "index": [], "segments": [], "jobs": [], "max_seq": 0, "applied_batch": -1, "active": True,
        }
        return self.publish(draft, 0)
