"""Join shapes that stay balanced on few or hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edurank.plans.materialize import materialize

# Bytes of a written dimension that are safe to copy to every executor.
BROADCAST_BYTES = 16 << 20
# Bytes of its rows in memory; files that repeat their values can be a small part of that.
MEMORY_BYTES = 256 << 20
# Files smaller than this are not looked into.
SMALL_BYTES = 1 << 20
# Slices a hot key is cut into when the small side is too big to broadcast.
DEFAULT_SALTS = 64


def stored_bytes(df: DataFrame) -> int:
    """Size of the files a frame of :func:`materialize` reads."""
    return int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))


def memory_bytes(df: DataFrame) -> int:
    """About the size of a written frame's rows as a broadcast holds them; one pass over columns that vary in length."""

    def width(field: T.StructField) -> str:
        name = f"`{field.name}`"
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return f"coalesce(octet_length({name}), 0)"
        if isinstance(field.dataType, (T.ArrayType, T.MapType)):
            return f"32 * greatest(size({name}), 0)"
        return "8"

    widths = " + ".join(width(f) for f in df.schema.fields)
    return int(df.agg(F.expr(f"coalesce(sum(64L + {widths}), 0)")).first()[0])


def salted_join(fact: DataFrame, dim: DataFrame, on: Sequence[str], spread_by: Column, how: str, salts: int) -> DataFrame:
    """Join in which the dimension is repeated once per salt and the fact rows are spread over the salts."""
    salted_dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted_fact = fact.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    return salted_fact.join(salted_dim, [*on, "_salt"], how).drop("_salt")


def join_few_keys(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    spread_by: Column,
    how: str = "inner",
    limit_bytes: int = BROADCAST_BYTES,
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Inner or left join of a large table to a dimension on a key with few values.

    A plain shuffle join would send the whole table to as many tasks as there
    are key values.  The dimension is written once and broadcast if its files are
    within ``limit_bytes``; a larger one is repeated once per salt and the fact
    rows are spread over the salts.
    """
    dim = materialize(dim)
    stored = stored_bytes(dim)
    if stored <= limit_bytes and (stored <= SMALL_BYTES or memory_bytes(dim) <= MEMORY_BYTES):
        return fact.join(F.broadcast(dim), list(on), how)
    return salted_join(fact, dim, on, spread_by, how, salts)
