"""Change capture: a stream of ordered changes kept as latest state."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..model import TierError
from ..operators.table import TieredTable
from ..sources.storage import Store


def change_schema(table: TieredTable) -> T.StructType:
    """What a source of changes carries: the table's columns, seq and op (1 insert, 2 update, 3 delete)."""
    return T.StructType([*table.snapshot.schema(), T.StructField("seq", T.LongType()), T.StructField("op", T.IntegerType())])


def source(spark: SparkSession, table: TieredTable, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Changes from Parquet files that arrive in a folder, a bounded number of files at a time."""
    return spark.readStream.schema(change_schema(table)).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def capture(changes: DataFrame, table: TieredTable, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Fold micro-batches into ``table``.

    Delivery is at least once and folding is idempotent by batch number and seq, so that effects are
    exactly once. With ``once`` the query takes what is there and ends: a fence for readers.
    """
    writer = changes.writeStream.foreachBatch(lambda batch, n: table.apply_changes(batch, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def drain(changes: DataFrame, table: TieredTable, checkpoint: str) -> None:
    """Apply everything that has arrived."""
    capture(changes, table, checkpoint).awaitTermination()


def teardown(query: StreamingQuery | None, table: TieredTable, checkpoint: str) -> None:
    """Stop a capture and forget how far it came; refused while the table is managed, as its next capture would start over."""
    if table.catalog.versions() and table.catalog.load().held["active"]:
        raise TierError("the table is still managed")
    if query is not None:
        query.stop()
    folder, _, name = checkpoint.rstrip("/").rpartition("/")
    Store(table.spark, folder).delete(name)


def progress(query: StreamingQuery) -> dict:
    """State and lag of a capture."""
    last = query.lastProgress
    held = json.loads(last.json) if hasattr(last, "json") and last is not None else dict(last or {})
    return {"active": query.isActive, "batch": held.get("batchId"), "rows": held.get("numInputRows"), "rows_per_second": held.get("processedRowsPerSecond"), "error": str(query.exception()) if query.exception() else None}
