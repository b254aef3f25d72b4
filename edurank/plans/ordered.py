"""Order dependent column work that does not need one task per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edurank.plans.materialize import materialize

# Consecutive order values handled by one task at a time.
BLOCK_SIZE = 20_000


def forward_fill(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], block: int = BLOCK_SIZE
) -> DataFrame:
    """Replace nulls by the last value before them, per key in ``order`` (a whole number).

    Rows are filled inside blocks of the order; what a block inherits comes from
    one summary row per earlier block.  A key that holds most of the rows is
    therefore spread over many tasks.  Keys may be null.
    """
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocked = materialize(df.withColumn("_block", F.expr(f"{order} div {block}")))
    carried = (
        blocked.groupBy(*keys, "_block")
        .agg(*(F.expr(f"max_by({c}, if({c} is null, null, {order})) as {c}") for c in columns))
        .select(
            *(F.col(k).alias(f"_key_{k}") for k in (*keys, "_block")),
            *(F.last(c, ignorenulls=True).over(earlier).alias(f"_carried_{c}") for c in columns),
        )
    )
    filled = blocked.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in (*keys, "_block")))
    joined = filled.join(carried, same)
    return joined.selectExpr(
        *(f"coalesce({c}, _carried_{c}) as {c}" if c in columns else c for c in df.columns)
    )
