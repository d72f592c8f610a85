"""Plans of iterative fits whose changing numbers are data: compiled once, run at every step."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_numbers(df: DataFrame, numbers: Iterable[float], name: str = "_p") -> DataFrame:
    """``df`` with the array ``name`` on every row, from a table of one row. Numbers in the expressions themselves would make a new plan of
    every step, to be compiled anew."""
    one = df.sparkSession.createDataFrame([([float(v) for v in numbers],)], f"{name} array<double>")
    return df.crossJoin(F.broadcast(one))  # one row
