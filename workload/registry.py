"""Query registry: one Spark callable and, where SQL can say it, one oracle per name.

A column spec such as ``"fold:s tp:i auc:d"`` shapes both sides the same way:
text, 64-bit integers, and doubles rounded to nine places with NaN as null.
Engines break exact rounding ties differently, so doubles are nudged first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def shape_frame(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind == "d":
            c = c.cast("double")
            c = F.round(F.when(~F.isnan(c), c) + 3e-13, 9) + 0.0
        elif kind == "b":
            c = c.cast("boolean")
        else:
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def shape_sql(sql: str, spec: str) -> str:
    out = []
    for plain, kind in _columns(spec):
        name = f'"{plain}"'
        if kind == "i":
            c = f"CAST({name} AS BIGINT)"
        elif kind == "d":
            v = f"CAST({name} AS DOUBLE)"
            c = f"round(CASE WHEN isnan({v}) THEN NULL ELSE {v} END + 3e-13, 9) + 0.0"
        elif kind == "b":
            c = f"CAST({name} AS BOOLEAN)"
        else:
            c = f"CAST({name} AS VARCHAR)"
        out.append(f"{c} AS {name}")
    return f"SELECT {', '.join(out)} FROM ({sql}) AS shaped"


def query(name: str, spec: str, sql: str | None = None):
    """Register a query function under a name, with its column spec and oracle."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: shape_frame(fn(spark, sf_dir), spec)
        if sql is not None:
            ORACLES[name] = shape_sql(sql, spec)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
