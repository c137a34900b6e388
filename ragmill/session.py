"""Session helpers: a local session for tests and tools, and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session with the settings the test-suite and the benchmark use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ragmill")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is a single JVM is a folder of this machine used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return qualified(spark, configured)
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _LOCAL
    if _LOCAL is None or not os.path.isdir(_LOCAL):
        _LOCAL = tempfile.mkdtemp(prefix="ragmill-")
        atexit.register(shutil.rmtree, _LOCAL, True)
    return "file://" + _LOCAL


_LOCAL: str | None = None


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, so that it means the same to Spark and to readers in tasks."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub("^file:/+", "file:///", full)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run's intermediate table; no two calls share one."""
    path = f"{shared_dir(spark)}/ragmill-{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this process has written so far; call it when results that need them are stored."""
    removed = 0
    while _SCRATCH:
        at = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        removed += at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return removed


@contextmanager
def released(spark: SparkSession):
    """Within this, the shuffle files of a query go as soon as it has ended: right where its result is a written table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing reads it again."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def extended(schema: StructType, **columns: DataType) -> StructType:
    """The schema with more columns; a data frame's own schema object stays as it is."""
    return StructType([*schema.fields, *(StructField(n, t) for n, t in columns.items())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
