"""Incrementally maintained aggregate views, fed by batches or by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage.table import Engine

#: Aggregates that can be combined from parts.
COMBINE = {"count": "sum", "sum": "sum", "min": "min", "max": "max"}


class IncrementalView:
    """Groups of an append-only input: each batch is aggregated alone, then merged into the stored groups it touches."""

    def __init__(self, engine: Engine, name: str, keys: list[str], measures: dict[str, tuple[str, str]], schema: T.StructType):
        for how, _ in measures.values():
            if how not in COMBINE:
                raise ValueError(f"{how} cannot be maintained from appended rows")
        self.keys, self.measures = keys, measures
        self.table = engine.create_as(name, self._aggregate(engine.spark.createDataFrame([], schema)))

    def _aggregate(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.keys).agg(*[getattr(F, how)(c).alias(n) for n, (how, c) in self.measures.items()])

    def apply(self, rows: DataFrame, number: int | None = None) -> None:
        """Merges a batch; ``number`` tells a stream's batches and is kept in the version that holds their rows."""
        part = self._aggregate(rows)
        t = self.table
        with t.change() as m:
            held = t._read(m, row_ids=True)
            on = [held[k].eqNullSafe(part[k]) for k in self.keys]
            cond = on[0]
            for c in on[1:]:
                cond = cond & c
            touched = held.join(part, cond, "left_semi")
            merged = touched.select(*self.keys, *self.measures).unionByName(part).groupBy(*self.keys).agg(*[getattr(F, COMBINE[how])(n).alias(n) for n, (how, _) in self.measures.items()])
            t._mask(m, touched)
            t._write(merged, m)
            if number is not None:
                m["batch"] = number

    def follow(self, stream: DataFrame, checkpoint: str):
        """Maintains the view from a streaming DataFrame.  A batch that is replayed after a crash is applied once: its number is kept in
        the manifest with its rows."""

        def batch(df: DataFrame, number: int) -> None:
            if self.table.manifest.get("batch", -1) >= number:
                return
            self.apply(df, number)

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()

    def read(self) -> DataFrame:
        return self.table.read()
