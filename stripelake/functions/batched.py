"""User-defined functions over Arrow batches, and table functions."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


@F.pandas_udf("double")
def scale(x: pd.Series) -> pd.Series:
    return x * 1.1


@udtf(returnType="g int")
class Series:
    """Whole numbers from a start to an end, both included, by a step."""

    def eval(self, start: int, end: int, step: int):
        if start is not None and end is not None and step:
            for g in range(start, end + (1 if step > 0 else -1), step):
                yield (g,)
