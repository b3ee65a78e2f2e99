"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of characters other than the six ASCII blanks.
BLANKS = "\\x20\\x09-\\x0D"
#: The six ASCII blanks themselves, for translate().
BLANK_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; only where that is unset (tests) a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and cut its lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that this subpackage has written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of settled tables that nothing will read again, neither directly nor by a result that is still to run."""
    for df in tables:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            delete(df.sparkSession, file.get())


@contextmanager
def settings(spark: SparkSession, **values: object) -> Iterator[None]:
    """Settings of the session for what is run inside, restored after; a double underscore stands for a dot."""
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def freeing_shuffles(spark: SparkSession):
    """Inside, each query's shuffle files are deleted when it ends, not when the driver's collector gets to it."""
    return settings(spark, **{"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"})


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 8):
    """Inside, Spark hands rows to Python in batches of so many or fewer: both sides hold a batch."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=rows, spark__sql__execution__arrow__maxBytesPerBatch=megabytes << 20)


def spare_memory() -> None:
    """Give what this process has freed back to the system: a worker waits for its next task beside others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_held: dict[object, object] = {}


def held[T](key: object, make: Callable[[], T]) -> T:
    """What this Python worker holds from task to task under the key; one at a time, so an operator's tables go when another begins."""
    if key not in _held:
        _held.clear()
        spare_memory()
        _held[key] = make()
    return _held[key]  # type: ignore[return-value]


def sparing(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for mapInArrow, sparing memory at a task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        spare_memory()

    return run


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def unused(name: str, *taken: list[str]) -> str:
    """The name, with underscores added until none of the columns in taken has it, in whatever case."""
    names = {c.lower() for columns in taken for c in columns}
    while name.lower() in names:
        name += "_"
    return name
