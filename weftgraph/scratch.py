"""Tables written to shared storage, to cut lineage or to read a costly result more than once.

The folder is the cluster's ``spark.checkpoint.dir``. Where that is unset, as in tests, a
folder of this process is used instead. Written tables survive the loss of executors.

Shuffles of a job that writes a table are of no use after it, so their files go when it ends and not when the driver
happens to collect its garbage. Tables of many rows are written ``packed``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: How large tables are written: sorted texts and running numbers as differences from the row before.
PACKED = {"compression": "zstd", "parquet.writer.version": "v2"}
_own: str | None = None
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    global _own
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="weft-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return _own


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in getattr(_open, "made", [])[-1:]:
        made.append(path)
    return path


@contextmanager
def set_to(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs that are run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def passing(spark: SparkSession) -> AbstractContextManager[None]:
    """The files of shuffles go with the jobs that are run inside; a table that is read twice has to be written."""
    return set_to(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(df: DataFrame, name: str, compression: str | None = None, packed: bool = False) -> DataFrame:
    """Writes a DataFrame to a new Parquet table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.options(**PACKED) if packed else df.write
    if compression:
        writer = writer.option("compression", compression)
    with passing(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, packed: bool = False) -> tuple[DataFrame, int]:
    """As ``written``, with the number of rows, which the same job counts."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name, packed=packed)
    return table, int(seen.get["n"])


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame], compression: str | None = None, packed: bool = False) -> DataFrame:
    """Writes what ``build`` returns, and then deletes the tables that were written on the way to it."""
    path = new_path(spark, name)
    made = _open.made = getattr(_open, "made", [])
    made.append([])
    try:
        df = build()
        writer = df.write.options(**PACKED) if packed else df.write
        if compression:
            writer = writer.option("compression", compression)
        with passing(spark):
            writer.parquet(path)
    finally:
        for gone in made.pop():
            remove(spark, gone)
    return spark.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Deletes a table as ``written`` returned it, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        remove(table.sparkSession, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop's file system, so that it works on any store."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
