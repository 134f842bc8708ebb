"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import ship

#: Rows turned into Python objects at a time inside an Arrow batch.
SLICE = 256
#: Rows of an Arrow batch where whole documents pass to Python and back.
BATCH = 1024
#: What tasks of a kind leave in this worker for the next of their kind.
KEPT: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, size: int = SLICE) -> Iterator:
    """Short slices of Arrow batches, so that few texts are Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def short_batches(spark: SparkSession, rows: int = BATCH) -> None:
    """Hand rows to Python in Arrow batches of at most so many; the JVM and the worker both hold a whole batch, each more than once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def drop_kept(keeps=None) -> None:
    """Free what tasks of other kinds have kept in this worker."""
    for kind in KEPT.keys() - {keeps}:
        del KEPT[kind]


def lean(run: Callable, keeps=None) -> Callable:
    """A function of Arrow batches that ends its task without the memory it took.

    Workers are reused by all later tasks, so what one keeps counts against each of
    them. Everything that `run` held is freed before memory is handed back; what
    it keeps in KEPT under `keeps` stays until a task of another kind begins.
    """

    @wraps(run)
    def task(batches):
        drop_kept(keeps)
        yield from run(batches)
        release_memory()

    return task


def fold(doc_id, mod: int) -> int | None:
    """crc32 of the id's decimal text, modulo `mod`; None for a null id."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % mod


def fold_column(column, mod: int):
    """The same as `fold`, as a Spark column."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(mod)


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def checkpoint_dir(spark: SparkSession, fallback: str = "/tmp/factloom-checkpoints") -> None:
    """Use the cluster's shared folder; a folder of our own only in local mode, where the session may name none."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or fallback)


def saved(df: DataFrame) -> DataFrame:
    """The rows, materialised in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release_memory() -> None:
    """Hand freed memory of this process back to the system, where its allocators can; they keep it otherwise."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, a query's shuffle files are deleted when it ends, by Spark itself, and not when the driver happens to collect them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
