"""Registry of named queries: a Spark builder and (optionally) a DuckDB oracle per name.

``register(name, sql=..., doubles=[...])`` records a builder ``fn(spark, sf_dir) -> DataFrame``.
Output rules applied to every registered query so both sides hash alike:
* Spark side: double/float columns rounded to 6 digits (-0.0 -> 0.0), integral columns -> long;
* SQL side: the listed ``doubles`` columns are rounded the same way.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import r6, sql_r6


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: list[str] = field(default_factory=list)
    operators: str = ""

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return normalize_output(self.build(spark, sf_dir))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.doubles:
            return self.sql
        rep = ", ".join(f"{sql_r6(c)} AS {c}" for c in self.doubles)
        return f"SELECT * REPLACE ({rep}) FROM (\n{self.sql}\n) q"


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, doubles: list[str] | tuple = (), operators: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, list(doubles), operators)
        return fn
    return deco


def normalize_output(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(r6(F.col(f.name)).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("long").alias(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            cols.append(r6(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
