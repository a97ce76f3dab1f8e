"""Written intermediate tables in the folder that the whole cluster shares.

A table that several later jobs read is written as Parquet below ``spark.checkpoint.dir`` and read
again: that cuts its lineage, and the loss of an executor costs only the tasks in flight. Nothing is
kept on an executor's own disk. Tables go as soon as no later plan reads them; what a returned frame still
reads goes when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and all tasks run on the driver's machine, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints"
#: Shuffle files of a write go with the job that made them; set for that write alone.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see; only a session on one machine may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return LOCAL_DEFAULT


class Workspace:
    """A folder of its own for one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(_delete_at_exit, weakref.ref(spark), self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back; an empty frame keeps its schema."""
        schema, before = df.schema, self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(self.path(name))
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            _delete(self.spark, self.path(name))


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def _delete_at_exit(session: weakref.ref, root: str) -> None:
    spark = session()
    if spark is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone before
            _delete(spark, root)
