"""Row numbers and pages of an ordered result, also large and deep ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edurank.plans.materialize import materialize

# Up to here a top-n (every task keeps offset + limit rows) is the cheapest plan.
TOP_N_ROWS = 100_000
# monotonically_increasing_id keeps the row's place in its partition in the low 33 bits.
_PLACE_BITS = 33


def with_row_number(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``row_number() over (order by ...)`` without putting all rows into one task.

    Rows are sorted into key ranges, numbered inside their range and shifted by
    the sizes of the ranges before; only one size per range passes one task.
    ``order`` has to be a total order.
    """
    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ).selectExpr("*", f"shiftright(_id, {_PLACE_BITS}) as _range", f"_id & {(1 << _PLACE_BITS) - 1} as _place")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_range").count().select(
        "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")
    )
    numbered = placed.join(F.broadcast(offsets), "_range")
    return numbered.selectExpr(*df.columns, f"_offset + _place + 1 as {name}")


def page_rows(df: DataFrame, order: Sequence[Column], offset: int, limit: int, top_n: int = TOP_N_ROWS) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` in the given total order."""
    if offset + limit <= top_n:
        return df.orderBy(*order).offset(offset).limit(limit)
    numbered = with_row_number(df, order, "_row")
    return numbered.where(F.col("_row").between(offset + 1, offset + limit)).drop("_row")
