"""Query registry shared by the catalog modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from panelflow.functions.numeric import np_round

QUERIES: dict[str, Callable] = {}


def query(name: str):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        return fn
    return deco


def round_floats(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Round every floating column (summation order differs between
    engines; the oracle applies the same rounding)."""
    return df.select(*[np_round(F.col(f.name), decimals).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])
