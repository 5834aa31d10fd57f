"""Tables in the folder that driver and executors share: what is read twice, and what cuts a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
_stored: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # where shared tables lie


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session, whose executors are threads of this machine, gets a folder of its own where none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own_folder[app]


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """For one action Python workers get Arrow batches of that size; the session's own setting comes back after it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    _stored[stored] = path
    return stored


def forget(*tables: DataFrame) -> None:
    """Delete shared tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_stored.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
