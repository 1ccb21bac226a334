"""Text in and out: CSV files, lines at hand, and other stores through Spark's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _struct(schema: T.StructType | str) -> T.StructType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


def copy_from(spark: SparkSession, path: str, schema: T.StructType | str, *, columns: list[str] | None = None, delimiter: str = ",", null: str = "", header: bool = False) -> DataFrame:
    """Reads CSV into declared types; a value that does not fit fails the read.  ``columns`` names the file's columns where they are fewer; the
    others are null."""
    full = _struct(schema)
    names = columns or full.names
    part = T.StructType([full[n] for n in names])
    df = spark.read.schema(part).csv(path, sep=delimiter, nullValue=null, header=header, mode="FAILFAST")
    from pyspark.sql import functions as F

    return df.select(*[F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in full])


def copy_to(df: DataFrame, path: str, *, delimiter: str = ",", null: str = "", header: bool = False) -> None:
    df.write.mode("overwrite").csv(path, sep=delimiter, nullValue=null, emptyValue='""', header=header)


def copy_lines(spark: SparkSession, lines: list[str], schema: T.StructType | str, *, delimiter: str = ",", null: str = "") -> DataFrame:
    """CSV from lines at hand, in place of standard input or a program's output."""
    from pyspark.sql import functions as F

    struct = _struct(schema)
    text = spark.createDataFrame([(x,) for x in lines], "line string")
    parsed = text.select(F.from_csv("line", struct.simpleString()[7:-1].replace(":", " "), {"sep": delimiter, "nullValue": null, "mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")


def jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A remote table; give partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def jdbc_append(df: DataFrame, url: str, table: str, **options) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet files of any store Spark reads, such as s3a://."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
