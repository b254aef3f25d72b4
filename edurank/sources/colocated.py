"""Facts laid out by school: bucketed tables that rating and grouping by school read without a shuffle.

All tables have the same number of buckets on ``school_id``, so their joins on it
and every grouping that contains it stay inside a bucket.  Subject statistics
carry school, year and kind of their school year, which saves the widest join.
The layout is a copy for reading, made from one version of the tables.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from edurank.sources.store import Tables

# Tables of the layout; the statistics take their school from the school year.
BUCKETED = ("school", "school_profile_link", "ege_school_year")
FACTS = "school_subject_fact"


class ColocatedTables(Tables):
    """Tables whose facts are bucketed by school; ``subject_facts`` are the widened statistics."""

    def __init__(self, tables: Tables, located: Mapping[str, DataFrame], subject_facts: DataFrame):
        super().__init__(tables.spark, version=tables.version)
        self.base = tables
        self.located = dict(located)
        self.subject_facts = subject_facts

    def __getitem__(self, name: str) -> DataFrame:
        return self.located[name] if name in self.located else self.base[name]

    def with_tables(self, changed: Mapping[str, DataFrame]) -> Tables:
        """Other contents of a table that the layout was made from make the layout unusable."""
        if {*self.located, "ege_school_subject_stat"} & set(changed):
            return self.base.with_tables(changed)
        return ColocatedTables(self.base.with_tables(changed), self.located, self.subject_facts)


def colocate(tables: Tables, name: str, buckets: int | None = None, location: str | None = None) -> ColocatedTables:
    """Write the layout as tables ``name_*`` of the session's catalog and read from it.

    Files go to the warehouse, or to a folder ``location``.  By default there
    are as many buckets as shuffle partitions.
    """
    buckets = buckets or int(tables.spark.conf.get("spark.sql.shuffle.partitions"))
    years = tables["ege_school_year"].select("ege_school_year_id", "school_id", "year", "kind")
    frames = {table: tables[table] for table in BUCKETED}
    frames[FACTS] = tables["ege_school_subject_stat"].join(years, "ege_school_year_id")
    for table, rows in frames.items():
        # One task writes one bucket; a school has a bounded number of rows.
        writer = rows.repartition(buckets, "school_id").write.bucketBy(buckets, "school_id").sortBy("school_id")
        if location:
            writer = writer.option("path", f"{location}/{table}")
        writer.saveAsTable(f"{name}_{table}")
    return open_colocated(tables, name)


def open_colocated(tables: Tables, name: str) -> ColocatedTables:
    """A layout that was written before, with the other tables from ``tables``."""
    read = tables.spark.table
    return ColocatedTables(tables, {t: read(f"{name}_{t}") for t in BUCKETED}, read(f"{name}_{FACTS}"))


def drop_colocated(spark: SparkSession, name: str) -> None:
    """Forget the tables of a layout; files in the warehouse go with them."""
    for table in (*BUCKETED, FACTS):
        spark.sql(f"drop table if exists {name}_{table}")
