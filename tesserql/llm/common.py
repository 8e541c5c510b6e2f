"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes in one Arrow batch; texts may be very long.
BATCH_ROWS = "2000"
BATCH_BYTES = str(16 << 20)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts may take in a Python worker."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        try:
            spark.conf.set(key, value)
        except Exception as e:  # an older Spark without that setting
            if "CANNOT_MODIFY" not in str(e):
                raise


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none, as in tests, a local one is made and
    set for checkpoints.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tesserql-")
        spark.conf.set("spark.checkpoint.dir", base)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created there yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Lets Spark delete a write's shuffle files when it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table written to the shared folder, with its lineage cut, and
    the table's path.  The shuffle files of the write are not kept."""
    spark = df.sparkSession
    path = fresh_dir(spark, "table")
    before = spark.conf.get(CLEAN, None)
    if before is not None:  # else a Spark without that setting
        spark.conf.set(CLEAN, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path), path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder, with its lineage cut."""
    return written(df)[0]


#: Bytes of rows up to which a written table is broadcast.  The driver holds a
#: broadcast table several times.
BROADCAST_BYTES = 32 << 20
#: Of a row's bytes in a broadcast table, those besides its texts.
ROW_BYTES = 64


def sized(table: DataFrame) -> DataFrame:
    """A written table of few columns with a hint for its joins: broadcast or
    not by its rows, as files with equal values (paths) are far smaller."""
    texts = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c, kind in table.dtypes if kind in ("string", "binary")]
    n = table.agg(F.sum(sum(texts, F.lit(ROW_BYTES)).cast("long"))).first()[0] or 0
    return F.broadcast(table) if n <= BROADCAST_BYTES else shuffled(table)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` with a hint that its joins broadcast neither side.  The optimiser
    takes what ``explode`` and Arrow functions return to be about as large as
    the files they read, and would broadcast rows that the driver cannot hold."""
    return df.hint("merge")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: What a Python worker keeps from task to task, by the module that keeps it.
_KEPT: dict[str, list[Callable[[], None]]] = {}
_LAST: list[str] = []


def kept_by(owner: str, forget: Callable[[], None]) -> None:
    """Have ``forget`` called when a worker turns to another module's tasks."""
    _KEPT.setdefault(owner, []).append(forget)


def turn_to(owner: str) -> None:
    """Give back the memory of what a worker keeps for other modules."""
    if _LAST == [owner]:
        return
    _LAST[:] = [owner]
    for other, calls in _KEPT.items():
        if other != owner:
            for forget in calls:
                forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only with that C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | StructType,
) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    small_batches(df.sparkSession)
    owner = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(owner)
        yield from fn(batches)

    return df.mapInArrow(run, schema)
