"""A scrollable cursor over an ordered result."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

_kept: dict[str, object] = {}
_stand_in: list[str] = []


def _keep(df: DataFrame) -> DataFrame:
    """``df``, written once to the cluster's shared folder (where none is set, a temporary one) until the driver's process ends."""
    spark = df.sparkSession
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not _stand_in:
            _stand_in.append("file://" + tempfile.mkdtemp(prefix="stripelake-numbered-"))
        shared = _stand_in[0]
    path = f"{shared.rstrip('/')}/stripelake-numbered/{uuid.uuid4().hex}"
    _kept[path] = spark
    held = df.drop(*[c for c, kind in df.dtypes if kind == "void"])  # files have no such columns
    held.write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(held.schema).parquet(path)
    return read.select(*[F.col(f"`{c}`") if kind != "void" else F.lit(None).alias(c) for c, kind in df.dtypes])


@atexit.register
def _sweep() -> None:
    for path, spark in list(_kept.items()):
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has gone before the process
            return


def numbered(df: DataFrame, order: list) -> tuple[DataFrame, int]:
    """``df`` with ``position``, the number of each row in the given order from 1, and the number of rows.

    The sorted rows are written first: the bounds of range partitions come from a random sample, so a second run of the same plan may
    deal rows to other partitions than those that were counted.
    """
    spark = df.sparkSession
    parts = _keep(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_nth")))
    sizes = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    at, base = 0, {}
    for p in sorted(sizes):
        base[p] = at
        at += sizes[p]
    offsets = spark.createDataFrame(sorted(base.items()) or [(0, 0)], "_part int, _base long")
    within = F.col("_nth") - F.shiftleft(F.col("_part").cast("long"), 33) + 1
    return parts.join(F.broadcast(offsets), "_part").withColumn("position", within + F.col("_base")).drop("_part", "_nth", "_base"), at


class Cursor:
    """Positions run from 1; before the first row it is 0, behind the last one more than their number.

    Row numbers come from a distributed sort: range partitions are counted, and each numbers its own
    rows from where the ones before it end, so no task holds the whole result.
    """

    def __init__(self, df: DataFrame, order: list):
        self.rows, self.size = numbered(df, order)
        self.position = 0

    def move(self, n: int) -> Cursor:
        self.position = min(max(self.position + n, 0), self.size + 1)
        return self

    def fetch_frame(self, n: int) -> DataFrame:
        """The next n rows (the previous, for negative n), as a DataFrame."""
        low, high = (self.position + 1, self.position + n) if n >= 0 else (self.position + n, self.position - 1)
        self.move(n if n >= 0 and high <= self.size or n < 0 and low >= 1 else (self.size + 1 - self.position if n >= 0 else -self.position))
        return self.rows.where(F.col("position").between(low, high))

    def fetch(self, n: int = 1) -> list[Row]:
        return self.fetch_frame(n).orderBy("position" if n >= 0 else F.desc("position")).collect()

    def absolute(self, n: int) -> list[Row]:
        self.position = min(max(n if n >= 0 else self.size + 1 + n, 0), self.size + 1)
        return self.rows.where(F.col("position") == self.position).collect()

    def relative(self, n: int) -> list[Row]:
        return self.absolute(min(max(self.position + n, 0), self.size + 1))

    def first(self) -> list[Row]:
        return self.absolute(1)

    def last(self) -> list[Row]:
        return self.absolute(self.size)
