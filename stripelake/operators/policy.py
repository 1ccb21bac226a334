"""Row-level security: a frame that shows only the rows its policy lets the current user see."""

from __future__ import annotations

from pyspark.sql import DataFrame


class Policy:
    def __init__(self, df: DataFrame, using: str):
        self._df, self.using = df, using

    def read(self) -> DataFrame:
        return self._df.where(self.using)
