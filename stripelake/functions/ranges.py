"""Ranges with inclusive or exclusive bounds, as structs; a null bound is infinite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(low: Column, high: Column, bounds: str = "[)") -> Column:
    if bounds not in ("[)", "(]", "[]", "()"):
        raise ValueError(f"unknown bounds {bounds}")
    return F.struct(low.alias("lo"), high.alias("hi"), F.lit(bounds[0] == "[").alias("lo_inc"), F.lit(bounds[1] == "]").alias("hi_inc"))


def is_empty(r: Column) -> Column:
    return F.coalesce((r["lo"] > r["hi"]) | ((r["lo"] == r["hi"]) & ~(r["lo_inc"] & r["hi_inc"])), F.lit(False))


def contains(r: Column, x: Column) -> Column:
    low = F.coalesce(F.when(r["lo_inc"], x >= r["lo"]).otherwise(x > r["lo"]), F.lit(True))
    high = F.coalesce(F.when(r["hi_inc"], x <= r["hi"]).otherwise(x < r["hi"]), F.lit(True))
    return F.when(x.isNotNull(), ~is_empty(r) & low & high)


def overlaps(a: Column, b: Column) -> Column:
    def below(x: Column, y: Column) -> Column:  # x ends before y begins
        return F.coalesce((x["hi"] < y["lo"]) | ((x["hi"] == y["lo"]) & ~(x["hi_inc"] & y["lo_inc"])), F.lit(False))

    return ~is_empty(a) & ~is_empty(b) & ~below(a, b) & ~below(b, a)


def equal(a: Column, b: Column) -> Column:
    """Empty ranges are equal to each other."""
    same = a["lo"].eqNullSafe(b["lo"]) & a["hi"].eqNullSafe(b["hi"]) & (a["lo_inc"] == b["lo_inc"]) & (a["hi_inc"] == b["hi_inc"])
    return (is_empty(a) & is_empty(b)) | (~is_empty(a) & ~is_empty(b) & same)


def sort_key(r: Column) -> Column:
    """Orders empty ranges first, then by lower and upper bound, infinite ones outermost."""
    return F.struct((~is_empty(r)).alias("a"), r["lo"].isNotNull().alias("b"), r["lo"].alias("c"), (~r["lo_inc"]).alias("d"), r["hi"].isNull().alias("e"), r["hi"].alias("f"), r["hi_inc"].alias("g"))


def key(r: Column) -> Column:
    """A key that equal ranges share, null for empty ones: join with ``key(a).eqNullSafe(key(b))``, which Spark hashes or sorts."""
    return F.when(~is_empty(r), r)
