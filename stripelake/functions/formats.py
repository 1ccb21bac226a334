"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_padded(c: Column | str, digits: int) -> Column:
    """An integer with at least ``digits`` digits, zeros in front and a sign only if negative; # where it has more."""
    x = (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")
    sign = F.when(x < 0, "-").otherwise("")
    body = F.lpad(F.abs(x).cast("string"), digits, "0")
    return F.when(F.length(F.abs(x).cast("string")) > digits, F.concat(sign, F.lit("#" * digits))).otherwise(F.concat(sign, body))
