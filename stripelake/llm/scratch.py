"""Intermediate tables in the folder that driver and executors share.

A table written here survives the loss of any executor and cuts the lineage, unlike a cache or a
local checkpoint.  The folder is the cluster's ``spark.checkpoint.dir``; only where that is unset
(tests, one machine) a temporary folder stands in.  Tables go when the driver's process ends, or
earlier through ``drop``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, object] = {}
_stand_in: list[str] = []


def folder(spark: SparkSession) -> str:
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not _stand_in:
        _stand_in.append("file://" + tempfile.mkdtemp(prefix="stripelake-"))
    return _stand_in[0]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{folder(spark)}/stripelake/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _made.pop(path, None)


#: Rows of an Arrow batch while an intermediate table is written: whole texts and shingle sets are long rows.
ARROW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def short_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to ARROW_ROWS rows from now on, for a result that is not written here but by the caller.

    A task's rows are one batch else, which the executor holds several times over beside its heap, and the worker once more.
    """
    key, most = ARROW_ROWS
    if not 0 < int(spark.conf.get(key)) <= int(most):
        spark.conf.set(key, most)


class Table:
    """A written intermediate table."""

    def __init__(self, df: DataFrame, name: str, codec: str = "zstd"):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = new_path(self.spark, name)
        before = self.spark.conf.get(ARROW_ROWS[0])
        self.spark.conf.set(*ARROW_ROWS)
        try:
            df.write.option("compression", codec).parquet(self.path)
        finally:
            self.spark.conf.set(ARROW_ROWS[0], before)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        drop(self.spark, self.path)


def save(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    return Table(df, name, codec).df


@atexit.register
def _sweep() -> None:
    for path, spark in list(_made.items()):
        try:
            drop(spark, path)
        except Exception:  # the session has gone before the process
            return
