"""Registered queries and their checking statements."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edurank.workload.views import DomainTables, domain

Builder = Callable[[DomainTables], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Builder
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
    """Add a query; ``oracle`` is omitted only where SQL cannot express the result."""

    def add(build: Builder) -> Builder:
        REGISTRY[name] = Query(build, oracle)
        return build

    return add


def publish(df: DataFrame) -> DataFrame:
    """Plain column types for comparison: whole numbers as bigint, decimals as double."""

    def plain(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return column.cast("bigint").alias(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return column.cast("double").alias(field.name)
        return column

    return df.select(*(plain(f) for f in df.schema.fields))


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish(REGISTRY[name].build(domain(spark, sf_dir)))
