"""Where operators put intermediate tables and files: the folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Where the tables are that ``materialize`` has written.
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def work_dir(spark: SparkSession) -> str:
    """The shared folder of this session. A temporary one is used only in local mode and when none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="alertloom-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/alertloom/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files go when it has ended; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again; this cuts the lineage, survives lost executors and frees the shuffle files that the rows took."""
    path = new_path(df.sparkSession, name)
    with setting(df.sparkSession, CLEANUP, "true"):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has written, once nothing that is still to be computed reads them; others are left."""
    for table in tables:
        place = _PLACES.pop(table, None)
        if place is not None:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Jobs that run inside have this setting."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_rows(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Jobs that run inside send at most so many rows to Python at once: for rows that are large."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path on it, for use inside tasks."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def make_dir(path: str) -> None:
    fs, place = filesystem(path)
    fs.create_dir(place, recursive=True)


def open_write(path: str):
    fs, place = filesystem(path)
    return fs.open_output_stream(place)


def open_read(path: str):
    """A file for random access."""
    fs, place = filesystem(path)
    return fs.open_input_file(place)


def memory_map(path: str) -> memoryview | bytes:
    """The whole file, memory-mapped where the file system is a mounted one."""
    import pyarrow as pa

    fs, place = filesystem(path)
    if isinstance(fs, pafs.LocalFileSystem):
        if fs.get_file_info(place).size == 0:
            return b""
        return memoryview(pa.memory_map(place).read_buffer())
    with fs.open_input_file(place) as f:
        return memoryview(f.read_buffer())
