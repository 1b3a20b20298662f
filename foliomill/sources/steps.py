"""Steps of a query as tables in a folder that all executors share: what follows neither plans nor runs them again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Only a local master, as in tests, has one of its own where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _local_dirs:
        _local_dirs[key] = tempfile.mkdtemp(prefix="foliomill-")
        atexit.register(shutil.rmtree, _local_dirs[key], True)
    return "file://" + _local_dirs[key]


#: While a table is written, the query's shuffle files go when it ends, not when the driver happens to collect its garbage, and
#: texts go to Python in batches of some megabytes, whatever their number.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as a Parquet table in the shared folder and read it back.

    The table survives the loss of any executor, and its schema is kept as it is. The query's shuffle files are deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table made by materialise() that nothing will read again."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def step(df: DataFrame) -> DataFrame:
    """materialise() for queries that need no shared folder: a cluster that names none keeps the step on its executors' disks."""
    try:
        shared_dir(df.sparkSession)
    except ValueError:
        return df.persist(StorageLevel.DISK_ONLY)
    return materialise(df)
