"""A registry of storage locations, each probed before it is used."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from ..model import TierError
from ..sources.storage import Store, fill

#: File system schemes of each kind of backend.
KINDS = {"filesystem": ("", "file"), "s3": ("s3", "s3a"), "gcs": ("gs",), "azure": ("abfs", "abfss", "wasbs")}
TEMPLATE = "{namespace}/{tableName}/{scopeId}/"


class Storages:
    """Named locations below ``root``; credentials are names of Hadoop settings, never their values."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def _load(self) -> dict:
        return json.loads(self.store.read("storages.json")) if self.store.exists("storages.json") else {}

    def _save(self, held: dict) -> None:
        self.store.create("storages.json", json.dumps(held), replace=True)

    def _check(self, kind: str, path: str, probe: bool) -> None:
        if kind not in KINDS:
            raise TierError(f"unknown storage kind {kind!r}")
        scheme = path.split(":", 1)[0] if "://" in path or path.startswith("file:") else ""
        if scheme not in KINDS[kind]:
            raise TierError(f"{path!r} is no {kind} location")
        if probe:
            there, name = Store(self.spark, path), f"_probe/{uuid.uuid4().hex}"
            if not there.create(name, "probe") or there.read(name) != "probe":
                raise TierError(f"{path!r} can't be written")
            there.delete(name)

    def register(self, name: str, kind: str, path: str, credentials: str | None = None, template: str = TEMPLATE, probe: bool = True) -> str:
        """Add a location; returns its id."""
        held = self._load()
        if name in held:
            raise TierError(f"storage {name!r} exists")
        fill(template, "n", "t", "s")
        self._check(kind, path, probe)
        held[name] = {"id": uuid.uuid4().hex, "kind": kind, "path": path.rstrip("/"), "credentials": credentials, "template": template}
        self._save(held)
        return held[name]["id"]

    def alter(self, name: str, path: str | None = None, credentials: str | None = None, probe: bool = True) -> None:
        """Move a location or change its credentials; files are not moved."""
        held = self._load()
        if name not in held:
            raise TierError(f"no storage {name!r}")
        if path is not None:
            self._check(held[name]["kind"], path, probe)
            held[name]["path"] = path.rstrip("/")
        if credentials is not None:
            held[name]["credentials"] = credentials
        self._save(held)

    def root_of(self, name: str, namespace: str, table: str, scope: str | None = None) -> str:
        """Where a table of this storage lives."""
        held = self._load()
        if name not in held:
            raise TierError(f"no storage {name!r}")
        return f"{held[name]['path']}/{fill(held[name]['template'], namespace, table, scope)}".rstrip("/")

    def names(self) -> list[str]:
        return sorted(self._load())
