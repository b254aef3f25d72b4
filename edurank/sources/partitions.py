"""Tables laid out by region and year; a change rewrites only the partitions it touches.

Rows that belong to a school lie in the folder of its region and, where they have
one, of their year.  A commit compares the content of every partition before and
after by a mark, stages the rows of those that differ, and lets Spark's dynamic
partition overwrite put them in place.  The stage names all that is to be done,
so a commit that was cut off is finished by the next reader or writer.  There is
one writer at a time; for concurrent appends there is :class:`TableStore`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edurank.plans.joins import join_few_keys
from edurank.sources.schema import PRIMARY_KEYS, SCHEMAS, struct_type
from edurank.sources.store import Tables, assign_ids, conform, upsert

REGION, YEAR = "part_region", "part_year"
# Tables of schools, and the year of a row where it has one.
BY_SCHOOL: dict[str, str | None] = {
    "school": None,
    "school_external_key": None,
    "school_profile_link": None,
    "ege_school_year": "year",
    "school_admission_stat": "year",
    "prof_event": "year(event_date)",
    "analytics_run_school": None,
    "analytics_school_selection": None,
    "analytics_school_metric_value": None,
    "analytics_school_rating": None,
    "analytics_school_card": None,
    "analytics_school_report": None,
}
# Tables whose rows lie where their parent row lies: parent and its key.
BY_PARENT = {
    "ege_school_subject_stat": ("ege_school_year", "ege_school_year_id"),
    "school_admission_detail": ("school_admission_stat", "adm_stat_id"),
}
MARKS = 2


def partition_columns(table: str) -> tuple[str, ...]:
    """Folders a table is split into; none for the dictionaries and the heads of the run log."""
    if table in BY_PARENT:
        return REGION, YEAR
    if table in BY_SCHOOL:
        return (REGION, YEAR) if BY_SCHOOL[table] else (REGION,)
    return (REGION,) if table == "municipality" else ()


def placed(tables: Tables, table: str) -> DataFrame:
    """Rows of a table with its partition columns; a row of an unknown school lies in the null region."""
    rows = tables[table]
    if table in BY_PARENT:
        parent, key = BY_PARENT[table]
        return rows.join(placed(tables, parent).select(key, REGION, YEAR), key, "left").select(*rows.columns, REGION, YEAR)
    if table == "municipality":
        return rows.withColumn(REGION, F.col("region_id"))
    if table not in BY_SCHOOL:
        return rows
    year = BY_SCHOOL[table]
    dated = rows.withColumn(YEAR, F.expr(f"cast({year} as int)")) if year else rows
    towns = tables["municipality"].select("municipality_id", F.col("region_id").alias(REGION))
    if table == "school":
        return join_few_keys(dated, towns, ["municipality_id"], F.col("school_id"), how="left").select(*rows.columns, REGION)
    schools = placed(tables, "school").select("school_id", REGION)
    return dated.join(schools, "school_id", "left").select(*dated.columns, REGION)


def _among(parts: Iterable[Sequence], columns: Sequence[str]) -> Column:
    """The row lies in one of the partitions, given as values of ``columns``; also prunes folders."""
    found = F.lit(False)
    by_region: dict = {}
    for part in parts:
        by_region.setdefault(part[0], []).append(part[1] if len(columns) > 1 else None)
    for region, years in by_region.items():
        here = F.col(columns[0]).isNull() if region is None else F.col(columns[0]) == region
        if len(columns) > 1:
            known = [y for y in years if y is not None]
            when = F.col(columns[1]).isin(*known) if known else F.lit(False)
            here &= (when | F.col(columns[1]).isNull()) if len(known) < len(years) else when
        found |= here
    return found


class PartitionedStore:
    """Tables under one folder, as a whole or, given ``regions``, only the partitions of these."""

    def __init__(self, spark: SparkSession, root: str, regions: Sequence[int] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.regions = None if regions is None else tuple(regions)

    def only(self, *regions: int) -> PartitionedStore:
        """The same store seen through some regions: loads read, and commits compare, nothing else of split tables."""
        return PartitionedStore(self.spark, self.root, regions)

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _schema(self, table: str) -> T.StructType:
        kinds = {REGION: T.LongType(), YEAR: T.IntegerType()}
        return T.StructType([*struct_type(table).fields, *(T.StructField(c, kinds[c]) for c in partition_columns(table))])

    def stored(self, table: str) -> DataFrame | None:
        """Rows with their partition columns; None for a table that was never written."""
        path, fs = self._path(table)
        if not fs.exists(path):
            return None
        rows = self.spark.read.schema(self._schema(table)).parquet(f"{self.root}/{table}")
        columns = partition_columns(table)
        if columns and self.regions is not None:
            rows = rows.where(F.col(REGION).isin(*self.regions))
        return rows

    def load(self) -> Tables:
        self.finish()
        frames = {name: self.stored(name) for name in SCHEMAS}
        own = {name: df.select(*struct_type(name).fieldNames()) for name, df in frames.items() if df is not None}
        return Tables(self.spark, own)

    def create(self, tables: Tables, names: Iterable[str]) -> PartitionedStore:
        """Write tables that the store does not have yet."""
        for name in names:
            columns = partition_columns(name)
            rows = placed(tables, name).select(*struct_type(name).fieldNames(), *columns)
            writer = (rows.hint("rebalance", *map(F.col, columns)) if columns else rows).write.mode("errorifexists")
            (writer.partitionBy(*columns) if columns else writer).parquet(f"{self.root}/{name}")
        return self

    def partitions(self, table: str) -> DataFrame:
        """Rows and file names of every partition of a table."""
        columns = partition_columns(table)
        files = F.array_sort(F.collect_set("_metadata.file_name")).alias("files")
        return self.stored(table).groupBy(*columns).agg(F.count("*").alias("n"), files)

    # --- changes -----------------------------------------------------------------------------

    def _marks(self, rows: DataFrame, table: str, side: int) -> DataFrame:
        """One row per partition: how many rows, and sums of their hashes."""
        fields = struct_type(table).fields
        values = [F.to_json(f.name) if "map" in f.dataType.simpleString() else F.col(f.name) for f in fields]
        columns = partition_columns(table)
        sums = [F.sum(F.xxhash64(F.lit(i), *values).cast("decimal(20,0)")).alias(f"mark{i}") for i in range(MARKS)]
        place = [F.col(c) if c in columns else F.lit(None).cast(k).alias(c) for c, k in ((REGION, "bigint"), (YEAR, "int"))]
        named = rows.select(F.lit(table).alias("table_name"), F.lit(side).alias("side"), *place, *(f.name for f in fields))
        return named.groupBy("table_name", "side", REGION, YEAR).agg(F.count("*").alias("n"), *sums)

    def _difference(self, before: Mapping[str, DataFrame | None], after: Mapping[str, DataFrame]) -> list:
        """Partitions whose content differs: table, region, year, rows before and after.

        One job for all tables; one row per partition reaches the driver.
        """
        parts = [self._marks(rows, table, 1) for table, rows in after.items()]
        parts += [self._marks(rows, table, 0) for table, rows in before.items() if rows is not None]
        if not parts:
            return []
        sides = reduce(DataFrame.unionByName, parts)
        content = F.struct("n", *(f"mark{i}" for i in range(MARKS)))

        def of(side: int) -> Column:
            return F.first(F.when(F.col("side") == side, content), ignorenulls=True)

        both = sides.groupBy("table_name", REGION, YEAR).agg(of(0).alias("old"), of(1).alias("new"))
        changed = both.where(~F.col("old").eqNullSafe(F.col("new")))
        counts = [F.coalesce(F.col(f"{side}.n"), F.lit(0)).alias(name) for side, name in (("old", "rows_before"), ("new", "rows_after"))]
        return changed.select("table_name", REGION, YEAR, *counts).collect()

    def commit(
        self,
        changed: Mapping[str, DataFrame],
        appended: Mapping[str, DataFrame] | None = None,
        base: int | None = None,
        numbered: Collection[str] = (),
    ) -> list:
        """Make the tables hold ``changed`` and add ``appended``; returns the partitions that were touched.

        The interface of :meth:`TableStore.commit`; ``base`` and ``numbered`` are
        not looked at, as there is one writer.
        """
        now = self.load()
        grown = {name: now[name].unionByName(conform(df, name)) for name, df in (appended or {}).items()}
        new = {**grown, **{name: conform(df, name) for name, df in changed.items()}}
        state = now.with_tables(new)
        after = {name: placed(state, name) for name in new}
        touched = self._difference({name: self.stored(name) for name in new}, after)
        self._put({name: after[name] for name in {t.table_name for t in touched}}, touched)
        return touched

    def upsert(self, table: str, source: DataFrame, keys: Sequence[str], update: Sequence[str]) -> list:
        """Upsert rows whose keys tell their partition (school and year); only those partitions are read and written."""
        (identity,) = PRIMARY_KEYS[table]
        now, columns = self.load(), partition_columns(table)
        source = source.select(*keys, *(c for c in source.columns if c not in keys))
        aimed = placed(now.with_tables({table: source}), table).select(*columns).distinct()
        parts = [tuple(r) for r in aimed.collect()]
        held = self.stored(table)
        held = held if held is None else held.where(_among(parts, columns))
        target = now[table] if held is None else held.select(*now[table].columns)
        known = source.join(target.select(*keys, identity), list(keys))
        # New keys follow those of the whole table: one column of it, from the footers' row groups.
        fresh = assign_ids(source.join(target.select(*keys), list(keys), "left_anti"), now[table], identity, keys)
        merged = conform(upsert(target, known.unionByName(fresh, allowMissingColumns=True), keys, update), table)
        after = placed(now.with_tables({table: merged}), table)
        touched = self._difference({table: held}, {table: after})
        self._put({table: after}, touched)
        return touched

    def _put(self, after: Mapping[str, DataFrame], touched: Sequence) -> None:
        """Stage the rows of the touched partitions, then publish the stage."""
        if not touched:
            return
        token = uuid.uuid4().hex
        todo: dict[str, dict] = {}
        for name, rows in after.items():
            columns = partition_columns(name)
            own = [t for t in touched if t.table_name == name]
            kept = rows.where(_among([tuple(t[c] for c in columns) for t in own], columns)) if columns else rows
            # Partitions of one region and year share files; large ones are split by the rebalancing.
            spread = kept.hint("rebalance", *map(F.col, columns)) if columns else kept
            spread.write.mode("errorifexists").parquet(f"{self.root}/_stage/{token}/{name}")
            todo[name] = {"emptied": [[t[c] for c in columns] for t in own if not t.rows_after]}
        path, fs = self._path("_stage", token, "todo.json")
        stream = fs.create(path, False)
        stream.write(bytearray(json.dumps(todo), "utf-8"))
        stream.close()
        self.finish()

    def finish(self) -> None:
        """Publish stages that are complete; a stage without its list was cut off before and is ignored."""
        path, fs = self._path("_stage")
        if not fs.exists(path):
            return
        for status in fs.listStatus(path):
            token = status.getPath().getName()
            todo_path, _ = self._path("_stage", token, "todo.json")
            if not fs.exists(todo_path):
                continue
            text = self.spark.read.text(todo_path.toString(), wholetext=True).first()[0]
            for name, todo in json.loads(text).items():
                self._publish(name, f"{self.root}/_stage/{token}/{name}", todo["emptied"])
            fs.delete(status.getPath(), True)

    def _publish(self, table: str, stage: str, emptied: Sequence[Sequence]) -> None:
        """Overwrite the staged partitions and drop the emptied ones; may be done again."""
        columns = partition_columns(table)
        rows = self.spark.read.schema(self._schema(table)).parquet(stage)
        writer = rows.write.mode("overwrite")
        if columns:
            writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*columns)
        writer.parquet(f"{self.root}/{table}")
        for part in emptied:
            folders = [f"{c}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for c, v in zip(columns, part, strict=True)]
            path, fs = self._path(table, *folders)
            if columns:
                fs.delete(path, True)

