"""The row at a position of an order, found by counting instead of sorting.

Histograms of one column after another narrow the place down to a slot of few rows, or of equal ones; only the slot is ordered.
Nothing but the order columns is read, and nothing of the rows moves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curlew.operators.rowindex import with_row_index

SLOT_ROWS = 200_000  # rows that are ordered in the end, by one task
BINS = 4096
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class Cut:
    """The order columns' values at a position (nulls first), and how many of the rows with the same values lie before it."""

    values: dict[str, object]
    equal_before: int

    def before(self) -> Column:
        """Whether a row's values come before the cut's."""
        less, equal = F.lit(False), F.lit(True)
        for name, value in self.values.items():
            column = F.col(name)
            if value is not None:
                less = less | (equal & (column.isNull() | (column < F.lit(value))))
            equal = equal & column.eqNullSafe(F.lit(value))
        return F.coalesce(less, F.lit(False))

    def at(self) -> Column:
        """Whether a row has the cut's values."""
        equal = F.lit(True)
        for name, value in self.values.items():
            equal = equal & F.col(name).eqNullSafe(F.lit(value))
        return equal


def cut_at(df: DataFrame, order_by: list[str], position: int, slot_rows: int = SLOT_ROWS) -> Cut:
    """The cut at a 0-based position that ``df`` has. Whole-number columns are narrowed down; from the first other one on, the slot that is
    left is ordered as it is."""
    here, place, size = df.select(*order_by), position, None
    for name in order_by:
        if not isinstance(here.schema[name].dataType, _WHOLE):
            break
        nulls = F.count_if(F.col(name).isNull())
        told = here.agg(F.count(F.lit(1)).alias("n"), nulls.alias("nulls"), F.min(name).alias("low"), F.max(name).alias("high")).first()
        size = told.n
        if size <= slot_rows:
            break
        if place < told.nulls:
            here, size = here.where(F.col(name).isNull()), told.nulls
            continue
        here, place, low, high, size = here.where(F.col(name).isNotNull()), place - told.nulls, told.low, told.high, told.n - told.nulls
        while low < high and size > slot_rows:
            width = -(-(high - low + 1) // BINS)
            inside = here.where(F.col(name).between(low, high))
            # subtracting first could overflow
            slot = F.expr(f"CAST((CAST(`{name}` AS DECIMAL(38, 0)) - {low}) DIV {width} AS INT)")
            for r in inside.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).orderBy("slot").collect():
                if place < r.n:
                    low, high, size = low + r.slot * width, min(high, low + (r.slot + 1) * width - 1), r.n
                    break
                place -= r.n
        here = here.where(F.col(name).between(low, high))
        if size <= slot_rows:
            break
    if size is None:
        size = here.count()
    columns = [F.col(c).asc_nulls_first() for c in order_by]
    if size <= slot_rows:
        found = here.orderBy(*columns).offset(place).limit(1).first()
    else:
        found = with_row_index(here, columns, "_position").where(F.col("_position") == place).first()
    cut = Cut({c: found[c] for c in order_by}, 0)
    cut.equal_before = place - here.agg(F.count_if(cut.before())).first()[0]
    return cut
