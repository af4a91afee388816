"""Session settings, table access and shared scratch space."""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Settings a local session is built with; a cluster brings its own.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.config(map=LOCAL_CONF).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the platform's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or where that
    is unset and the master local, as in tests, a temporary one of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir is not set; {master} needs a folder that all executors share")
    made = tempfile.mkdtemp(prefix="webloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


_WRITTEN: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The tables that ``stored`` writes within the block are deleted at its end; results
    must be read or written before."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        drop_stored(spark, before)


def drop_stored(spark: SparkSession, keep: int = 0) -> None:
    """Deletes the tables this process wrote with ``stored``, but for the first ``keep``;
    results that were not yet read depend on them."""
    while len(_WRITTEN) > keep:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there,
    so a lost executor costs a re-read, and readers share one computation. The job runs
    when this is called, so operators that use it compute while their plan is built."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that start within the block delete their shuffle files when they end, and not
    when the driver happens to collect its garbage. Only for what is not computed again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shipped(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A broadcast object, loaded by calling the result in a task. Objects of this
    package's classes travel by value, so workers need no copy of the package."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)
