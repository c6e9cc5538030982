"""Files through Hadoop's FileSystem, so that any store that Spark reads will do."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


class Store:
    """A folder in some file system, with paths relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _at(self, name: str):
        return self._path(self.full(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str) -> list[str]:
        """Entries of a folder; none if it is missing."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def files(self, name: str) -> list[str]:
        """All files below a folder, as names relative to the root."""
        if not self.exists(name):
            return []
        out, it = [], self._fs.listFiles(self._at(name), True)
        base = self._fs.makeQualified(self._path(self.root)).toUri().getPath().rstrip("/") + "/"
        while it.hasNext():
            out.append(it.next().getPath().toUri().getPath().removeprefix(base))
        return sorted(out)

    def size(self, name: str) -> int:
        return self._fs.getFileStatus(self._at(name)).getLen()

    def total(self, name: str) -> int:
        """Bytes of all files below a folder."""
        return self._fs.getContentSummary(self._at(name)).getLength()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def modified(self, name: str) -> float:
        """Seconds since 1970 at which a file or folder was last changed."""
        return self._fs.getFileStatus(self._at(name)).getModificationTime() / 1000

    def _fill(self, stream, text: str) -> None:
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, name: str, text: str, replace: bool = False) -> bool:
        """Write a small file; False if it is there already and mustn't be replaced.

        Without ``replace`` a file appears whole or not at all, and of several writers one wins: by a conditional put
        on object stores, else by a file written aside that is linked or renamed without replacing.
        """
        at, scheme = self._at(name), self._fs.getUri().getScheme()
        if replace:
            self._fill(self._fs.create(at, True), text)
            return True
        try:
            if scheme in ("s3", "s3a"):
                self._fill(self._fs.createFile(at).overwrite(False).must("fs.option.create.conditional.overwrite", True).recursive().build(), text)
                return True
            if scheme == "gs":  # the connector's create is conditional, and the object appears when it is closed
                self._fill(self._fs.create(at, False), text)
                return True
        except Exception as e:
            if any(x in str(e) for x in ("exist", "412", "409")):
                return False
            raise
        aside = self._at(f"{name.rpartition('/')[0]}/_aside-{uuid.uuid4().hex}".lstrip("/"))
        self._fill(self._fs.create(aside, False), text)
        jvm = self.spark._jvm
        try:
            if scheme == "file":
                local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(at), local(aside))
            else:
                options = jvm.org.apache.hadoop.fs.Options
                none = self.spark.sparkContext._gateway.new_array(options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(at).toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, at, none)
                return True
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        finally:
            self._fs.delete(aside, False)
        return True

    def move(self, name: str, to: str) -> None:
        """Rename without replacing."""
        if self.exists(to):
            raise FileExistsError(self.full(to))
        self._fs.mkdirs(self._at(to).getParent())
        if not self._fs.rename(self._at(name), self._at(to)):
            raise OSError(f"cannot move {name} to {to}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a temporary one where none is configured and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="firnline-tables-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def fill(template: str, namespace: str, table: str, scope: str | None = None) -> str:
    """A path from ``{namespace}/{tableName}/{scopeId}/``; a table without scope has no scope step."""
    out = template.replace("{namespace}", namespace).replace("{tableName}", table)
    if "{scopeId}" in out:
        if scope is None:
            out = out.replace("{scopeId}/", "").replace("{scopeId}", "")
        else:
            out = out.replace("{scopeId}", scope)
    if "{" in out or ".." in out.split("/"):
        raise ValueError(f"bad path template {template!r}")
    return out
