"""A registry of named queries: SQL for Spark over the driver's tables, and the same for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_NAMES = re.compile(r"\{(" + "|".join(TABLES) + r")\}")


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """One SQL text for both engines, tables as {name}; ``oracle`` where DuckDB's dialect differs."""
        used = sorted(set(_NAMES.findall(text)))

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})

        self.queries[name] = run
        self.oracles[name] = _NAMES.sub(r"\1", oracle or text)

    def frame(self, name: str, oracle: str | None = None):
        """Decorates a function of (read, spark), where read(table) gives a DataFrame."""

        def keep(fn):
            self.queries[name] = lambda spark, sf_dir: fn(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"), spark)
            if oracle:
                self.oracles[name] = _NAMES.sub(r"\1", oracle)
            return fn

        return keep
