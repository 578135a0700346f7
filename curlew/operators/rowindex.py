"""Global positions and running totals without a one-partition window.

The rows are range-sorted into many partitions and stored once; the per-partition sizes (one row per partition)
give every partition its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curlew.session import store

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def _stored_in_order(df: DataFrame, order_by: list[Column]) -> DataFrame:
    marked = df.orderBy(*order_by).withColumn("_mark", F.monotonically_increasing_id())
    return store(marked, "ordered").withColumn("_part", F.shiftright("_mark", _LOCAL_BITS))


def _offsets(stored: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Per partition: what lies before it, and the grand total, of each named sum."""
    sizes = stored.groupBy("_part").agg(*[c.alias(f"_size_{n}") for n, c in totals.items()])
    everything = Window.orderBy("_part")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    columns = []
    for name in totals:
        columns.append(F.coalesce(F.sum(f"_size_{name}").over(before), F.lit(0)).alias(f"_before_{name}"))
        columns.append(F.sum(f"_size_{name}").over(whole).alias(f"_total_{name}"))
    return sizes.select("_part", *columns)


def with_row_index(df: DataFrame, order_by: list[Column], name: str = "row_index", total: str | None = None) -> DataFrame:
    """Append the 0-based position of each row in the given order, and optionally the row count."""
    stored = _stored_in_order(df, order_by)
    offsets = _offsets(stored, {"rows": F.count(F.lit(1))})
    local = F.col("_mark").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    indexed = stored.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before_rows") + local)
    if total:
        indexed = indexed.withColumn(total, F.col("_total_rows"))
    return indexed.drop("_mark", "_part", "_before_rows", "_total_rows")


def with_running_totals(df: DataFrame, order_by: list[Column], sums: dict[str, str], totals: bool = True) -> DataFrame:
    """Append, for each ``{name: column}``, the sum over all rows before this one as ``name`` and the grand total
    as ``total_<name>``."""
    stored = _stored_in_order(df, order_by)
    offsets = _offsets(stored, {n: F.sum(c) for n, c in sums.items()})
    earlier = Window.partitionBy("_part").orderBy("_mark").rowsBetween(Window.unboundedPreceding, -1)
    out = stored.join(F.broadcast(offsets), "_part")
    for name, column in sums.items():
        out = out.withColumn(name, F.col(f"_before_{name}") + F.coalesce(F.sum(column).over(earlier), F.lit(0)))
        if totals:
            out = out.withColumn(f"total_{name}", F.col(f"_total_{name}"))
    return out.drop("_mark", "_part", *[f"_before_{n}" for n in sums], *[f"_total_{n}" for n in sums])
