"""Callbacks around changes of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from ..storage.table import Table, TableError

EVENTS = ("before", "before_row", "after")
STATEMENTS = ("insert", "update", "delete")


class Triggers:
    """before_row maps the rows to be written (a DataFrame to a DataFrame); before and after are called once for each statement.

    after gets the transition tables: the new rows of an insert, the old and the new rows of an update, the old rows of a delete.
    Deletes have no before_row, and triggers after each row do not exist.
    """

    def __init__(self, table: Table):
        self.table = table
        self._fns: dict[tuple[str, str], list[Callable]] = {}

    def on(self, event: str, fn: Callable, of: str = "insert") -> None:
        if event not in EVENTS or of not in STATEMENTS or (event, of) == ("before_row", "delete"):
            raise TableError(f"no trigger {event} of {of}")
        self._fns.setdefault((event, of), []).append(fn)

    def _call(self, event: str, of: str, *args: DataFrame) -> None:
        for fn in self._fns.get((event, of), []):
            fn(*args)

    def _rows(self, of: str) -> Callable[[DataFrame], DataFrame]:
        def through(df: DataFrame) -> DataFrame:
            for fn in self._fns.get(("before_row", of), []):
                df = fn(df)
            return df

        return through

    def append(self, df: DataFrame) -> DataFrame:
        self._call("before", "insert")
        new = self.table.append(self._rows("insert")(df))
        self._call("after", "insert", new)
        return new

    def update(self, values: dict[str, Column | str], condition: Column | str = "true") -> int:
        self._call("before", "update")
        before = self.table.manifest
        n = self.table.update(values, condition, through=self._rows("update"))
        self._call("after", "update", self.table._gone_since(before), self.table._new_since(before))
        return n

    def delete(self, condition: Column | str) -> int:
        self._call("before", "delete")
        before = self.table.manifest
        n = self.table.delete(condition)
        self._call("after", "delete", self.table._gone_since(before))
        return n
