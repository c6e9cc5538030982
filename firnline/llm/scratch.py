"""Written tables in the shared folder, and gapless ranks that need no global sort.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: a lost executor
then costs a re-read, not a recomputation from the sources.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType, _parse_datatype_string


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is configured and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return str(held.get())
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="firnline-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


_written: list[str] = []


def sweep(spark: SparkSession) -> int:
    """Delete all that this process has settled; call it once no result that reads it is needed any more."""
    n = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the reader of what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/firnline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _local_ranks(key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        order = np.argsort(keys, kind="stable")
        values, starts, counts = np.unique(keys[order], return_index=True, return_counts=True)
        rank = np.empty(len(keys), np.int64)
        for value, start, count in zip(values.tolist(), starts.tolist(), counts.tolist(), strict=True):
            base = seen.get(value, 0)
            rank[order[start : start + count]] = np.arange(base, base + count)
            seen[value] = base + count
        columns = [*batch.columns, pa.array(np.full(len(keys), part, np.int32)), pa.array(rank)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", "_local"])


def ranked(df: DataFrame, key: str, rank: str, name: str, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str | None = None) -> DataFrame:
    """``df`` with ``rank``: 0, 1, ... without gaps among the rows of each ``key``.

    ``key`` is an integer column without nulls. Each task numbers its own rows per key
    while it writes them; a table of (task, key) counts then gives each task its offset.
    No key's rows meet in one task. With ``make``, its rows (of ``schema``) are ranked, in the same worker
    that makes them: a second worker for each core would hold its memory for as long as the executor lives.
    """
    fields = _parse_datatype_string(schema) if schema else df.schema
    both = StructType([*fields, StructField("_part", IntegerType()), StructField("_local", LongType())])
    held = settle(df.mapInArrow(lambda it: _local_ranks(key, make(it) if make else it), both), name)
    counts = held.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    offsets = counts.selectExpr(
        key, "_part", f"sum(_n) OVER (PARTITION BY {key} ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - _n AS _before"
    )
    return held.join(offsets, [key, "_part"]).withColumn(rank, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


#: Bytes of an Arrow batch on its way to Python, and rows up to which a list of ids is broadcast.
BATCH_BYTES, BROADCAST_ROWS = 8 << 20, 2_000_000


def bound_batches(spark: SparkSession) -> None:
    """Long texts make large batches: bound their bytes, as workers hold several copies of one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match(r"-?\d+", spark.conf.get(name))[0]) not in range(1, BATCH_BYTES + 1):
        spark.conf.set(name, str(BATCH_BYTES))


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows; it is read from a written table, so that counting is cheap."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def id_text(docs: DataFrame) -> DataFrame:
    """Only (doc_id, text) of a table, whatever else it holds."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` doesn't have, in any case."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out
