"""Registered queries with the SQL that states the same result independently."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curlew.queries.sql_views import SQL_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Plain column types (BIGINT, DOUBLE, STRING, BOOLEAN), so results compare across engines."""
    widened = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(f.dataType, T.FloatType):
            column = column.cast("double")
        elif isinstance(f.dataType, (T.DecimalType, T.DateType)):
            column = column.cast("string")
        widened.append(column.alias(f.name))
    return df.select(*widened)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the logical tables of ``SQL_VIEWS`` by name."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf: _plain(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def with_views(sql: str) -> str:
    """Prepend the definitions of every logical table the text mentions."""
    needed: dict[str, str] = {}

    def need(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(body)
                needed.setdefault(name, body)

    need(sql)
    if not needed:
        return sql.strip()
    head = ",\n".join(f"{name} AS ({body.strip()})" for name, body in needed.items())
    return f"WITH {head}\nSELECT * FROM ({sql.strip()})"
