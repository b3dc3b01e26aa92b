"""Tables between stages of a job.

They lie in the cluster's shared folder, in one folder for each application, or for each run() that is entered; what lies there
can be removed as a whole once no frame that was made of it is needed any more.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_run: ContextVar[str | None] = ContextVar("run", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; where that is unset, one of this machine, for which Spark must be local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/") if base else f"file://{tempfile.gettempdir()}/gleaner-stages"


def run_folder(spark: SparkSession) -> str:
    """Where tables are written: the folder of the run that was entered, else the application's."""
    return _run.get() or f"{shared_folder(spark)}/gleaner-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    return f"{run_folder(spark)}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, whichever that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Removes all tables that this application has written outside of a run()."""
    remove(spark, f"{shared_folder(spark)}/gleaner-{spark.sparkContext.applicationId}")


@contextmanager
def run(spark: SparkSession) -> Iterator[str]:
    """Tables written within go to a folder of their own, which is removed at the end; results must be used or written by then."""
    path = f"{run_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _run.set(path)
    try:
        yield path
    finally:
        _run.reset(token)
        remove(spark, path)


def staged(df: DataFrame) -> DataFrame:
    """The frame written as a table of the shared folder and read again.

    A stage that is used several times is so worked out once, and a lost executor repeats one stage and not all before it.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
