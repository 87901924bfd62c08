"""How the registered queries and their SQL put results: days as text, money and counts as plain numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import bindings as b


def plain(df: DataFrame) -> DataFrame:
    """Dates and times as text, decimals as doubles, integers as longs."""

    def cast(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType)):
            return c.cast("string").alias(f.name)
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("long").alias(f.name)
        return c

    return df.select(*[cast(f) for f in df.schema])


def n(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def m(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def t(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def rnd(x: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits})"


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n"


LOG, DIMS, ROLLUP = b.LOG_SQL, b.DIMS_SQL, b.ROLLUP_SQL
