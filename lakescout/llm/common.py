"""What the operators of this subpackage share: table access, durable lineage cuts and the hold-out rule."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker turns into Python objects at once; bounds its memory for long texts.
SLICE_ROWS = 256
#: What a worker keeps after a task without looking for free memory.
KEPT_BYTES = 150_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in a folder that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``. Where that is unset, a local session
    (tests) gets a temporary folder; on a cluster that is an error, as executors don't share such folders."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(named)
    return named


class Scratch:
    """Written tables in a folder of their own under the checkpoint folder, gone when cleared or at the session's end.

    What is written starts short plans, survives lost executors and is computed once."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.tables = spark, f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.clear)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.tables}"
        self.tables += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Remove all tables; a session that has ended can't any more."""
        atexit.unregister(self.clear)
        if self.tables and self.spark.sparkContext._jsc is not None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.tables = 0


def durable(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the checkpoint folder and read it from there: its rows survive the loss of executors,
    and later jobs don't compute them again."""
    folder = checkpoint_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Give the executors this package's modules, wherever the driver was started; once for an application."""
    context = spark.sparkContext
    name = f"lakescout-{context.applicationId}.zip"
    if any(str(f).endswith(name) for f in context._python_includes):
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="lakescout-"), name)
    with zipfile.ZipFile(path, "w") as archive:
        for module in sorted(root.rglob("*.py")):
            archive.write(module, module.relative_to(root.parent))
    context.addPyFile(path)


#: What a Python worker keeps between tasks, by (module, key). Workers outlive stages.
HELD: dict[tuple, object] = {}


def held(module: str, key: str, make):
    """Something dear that a worker keeps for the tasks of one module."""
    if (module, key) not in HELD:
        HELD[module, key] = make()
    return HELD[module, key]


def map_batches(df: DataFrame, run, ddl) -> DataFrame:
    """``df.mapInArrow`` with this package's modules at hand in the workers. A worker that goes on to another
    module's tasks lets go of what it held for the one before."""
    ship(df.sparkSession)
    return df.mapInArrow(alone(run), ddl)


def alone(run):
    """``run`` for tasks of its module: a worker lets go of what it held for another one, and gives free memory back
    when the task has ended, as idle workers stay beside those of the next stage."""
    module = run.__module__

    def task(batches):
        for other in [k for k in HELD if k[0] != module]:
            del HELD[other]
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back(least: int = KEPT_BYTES) -> None:
    """Return free memory of the allocators to the system, if this process has more than so many bytes."""
    try:
        resident = int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")
        trim = ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not Linux, or another C library
        return
    if resident > least:
        pa.default_memory_pool().release_unused()
        trim(0)


def remainder(doc_id: Column) -> Column:
    """crc32 of the decimal doc_id modulo 5: what the hold-out rules are stated in (null for a null doc_id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def slices(batches, *columns: str, rows: int = SLICE_ROWS):
    """Cut Arrow batches into slices of few rows, each given as the batch and its columns as Python lists."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, *(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns)


def rows_to_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """An Arrow batch of Python columns."""
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of ``name type, ...`` with the few types used here."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(","))])
