"""Rows dealt into contiguous ranges of a number, each range to a partition of its own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def n_parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def range_bounds(df: DataFrame, col: str, parts: int) -> list[float]:
    """At most ``parts`` - 1 cut points that split the rows about evenly.

    Only these numbers reach the driver.  They steer balance alone: any bounds give the
    same rows in the same order.
    """
    if parts < 2:
        return []
    q = df.select(F.col(col).cast("double").alias("v")).na.drop().approxQuantile("v", [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted(set(q))


def part_of(col: Column, bounds: list[float]) -> Column:
    """Number of the range that a value lies in; null is in the first."""
    cuts = np.asarray(bounds, np.float64)

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        x = v.to_numpy(dtype=np.float64, na_value=-np.inf)
        return pd.Series(np.searchsorted(cuts, x, "right").astype(np.int32))

    return place(col.cast("double"))
