"""Table storage: explicit schemas, versions made of folders, one commit for many tables.

A commit writes new rows to fresh folders and then one small manifest naming the
current folders of each table: one folder after a rewrite, one more after an
append.  Readers follow the newest manifest, so a table that is being read is
never overwritten and a failed job leaves the old state in place.

A commit is based on the manifest its tables were loaded from.  If others have
committed since, it goes on only when they changed none of its tables; otherwise
it fails and nothing is lost.  The manifest is created without overwriting, which
is atomic on HDFS and local disks; an object store needs a file system that
honours it (conditional put).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edurank.plans.texts import ByReference
from edurank.sources.schema import PRIMARY_KEYS, SCHEMAS, struct_type

# Buckets used to number new rows in parallel.
ID_BUCKETS = 1024


class Tables(Mapping):
    """Named DataFrames; a table that was never given is empty but typed.

    ``version`` is the number of the manifest they were loaded from, if any;
    ``subject_facts`` are statistics widened by their school year, where a layout has them.
    ``shared`` are tables whose rows share long texts as rows with a reference and these texts
    (:class:`~edurank.plans.texts.ByReference`), where both are known.
    """

    subject_facts: DataFrame | None = None
    shared: Mapping[str, ByReference] = MappingProxyType({})

    def __init__(self, spark: SparkSession, frames: Mapping[str, DataFrame] | None = None, version: int | None = None):
        self.spark = spark
        self.version = version
        self._frames = dict(frames or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name not in SCHEMAS:
                raise KeyError(name)
            self._frames[name] = self.spark.createDataFrame([], struct_type(name))
        return self._frames[name]

    def __iter__(self):
        return iter(SCHEMAS)

    def __len__(self):
        return len(SCHEMAS)

    def with_tables(self, changed: Mapping[str, DataFrame]) -> Tables:
        copy = Tables(self.spark, {**self._frames, **changed}, self.version)
        copy.shared = self.shared_beside(changed)
        return copy

    def shared_beside(self, changed: Collection[str]) -> dict[str, ByReference]:
        """``shared`` without what has changed."""
        return {name: parts for name, parts in self.shared.items() if name not in changed}


class CommitConflict(RuntimeError):
    """Another commit changed the same tables since they were loaded."""


class TableStore:
    """Versioned Parquet tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the newest manifest; 0 for an empty store."""
        path, fs = self._path("_manifest")
        if not fs.exists(path):
            return 0
        names = (status.getPath().getName() for status in fs.listStatus(path))
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        """table -> its folders in a version, by default the newest."""
        version = self.version() if version is None else version
        if not version:
            return {}
        text = self.spark.read.text(f"{self.root}/_manifest/{version:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def load(self) -> Tables:
        version = self.version()
        frames = {
            name: self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.root}/{folder}" for folder in folders))
            for name, folders in self.manifest(version).items()
        }
        return Tables(self.spark, frames, version)

    def commit(
        self,
        changed: Mapping[str, DataFrame],
        partition_by: Mapping[str, Sequence[str]] | None = None,
        appended: Mapping[str, DataFrame] | None = None,
        base: int | None = None,
        numbered: Collection[str] = (),
    ) -> int:
        """Write tables anew, or only add rows to them, and make them current together.

        ``base`` is the version the change was computed from, by default the
        newest one when the commit begins.  Appends bear appends of others, but
        not for tables that are ``numbered``: their new keys follow those of the base.
        """
        base = self.version() if base is None else base
        token = uuid.uuid4().hex

        def written(name: str, df: DataFrame) -> str:
            folder = f"{name}/{token}-{'new' if name in changed else 'more'}"
            writer = conform(df, name).write.mode("errorifexists")
            for columns in filter(None, [(partition_by or {}).get(name)]):
                writer = writer.partitionBy(*columns)
            writer.parquet(f"{self.root}/{folder}")
            return folder

        rewritten = {name: written(name, df) for name, df in changed.items()}
        added = {name: written(name, df) for name, df in (appended or {}).items()}
        start = self.manifest(base)
        while True:
            number = self.version()
            current = self.manifest(number)
            for name in (*rewritten, *added):
                before, now = start.get(name, []), current.get(name, [])
                only_grown = name in added and name not in numbered and now[: len(before)] == before
                if now != before and not only_grown:
                    raise CommitConflict(f"{name} was changed since version {base}")
            for name, folder in rewritten.items():
                current[name] = [folder]
            for name, folder in added.items():
                current[name] = [*current.get(name, []), folder]
            if self._create(number + 1, json.dumps(current)):
                return number + 1

    def _create(self, number: int, text: str) -> bool:
        """Write a manifest; False when another writer took its number."""
        path, fs = self._path("_manifest", f"{number:012d}.json")
        try:
            stream = fs.create(path, False)
        except Exception:
            if fs.exists(path):
                return False
            raise
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        return True


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns, order and types of the table; absent columns become null."""
    types = dict(df.dtypes)
    wanted = [(f.name, f.dataType.simpleString()) for f in struct_type(table)]
    if list(types.items()) == wanted:
        return df
    return df.selectExpr(*(f"cast({name if name in types else 'null'} as {kind}) as {name}" for name, kind in wanted))


def next_id(df: DataFrame, key: str):
    """Largest key so far as a one-value subquery (0 for an empty table)."""
    return df.select(F.coalesce(F.max(key), F.lit(0))).scalar()


def assign_ids(new_rows: DataFrame, existing: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """Number new rows after the existing keys, in parallel and repeatably.

    Rows are bucketed by a hash of ``order_by`` (which has to identify a row),
    numbered inside their bucket and shifted by the size of the buckets before.
    Only the bucket sizes, at most ``ID_BUCKETS`` rows, pass one task.
    """
    bucketed = new_rows.withColumn(
        "_bucket", F.pmod(F.xxhash64(*order_by), F.lit(ID_BUCKETS)).cast("int")
    )
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_bucket"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_bucket").orderBy(*order_by)
    return (
        bucketed.withColumn("_place", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(key, (next_id(existing, key) + F.col("_offset") + F.col("_place")).cast("bigint"))
        .drop("_bucket", "_place", "_offset")
    )


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """Replace ``update`` columns of rows with a known key, add the other rows.

    ``source`` must hold each key once.  Columns of the target outside ``keys``
    and ``update`` keep their value on a match.
    """
    marked = source.withColumn("_hit", F.lit(True)).alias("s")
    joined = target.alias("t").join(marked, list(keys), "full_outer")
    hit = F.col("s._hit")

    def pick(name: str):
        if name in keys:
            return F.col(name)
        if name in update:
            return F.when(hit, F.col(f"s.{name}")).otherwise(F.col(f"t.{name}")).alias(name)
        if name in source.columns:
            return F.coalesce(F.col(f"t.{name}"), F.col(f"s.{name}")).alias(name)
        return F.col(f"t.{name}").alias(name)

    return joined.select(*(pick(c) for c in target.columns))


def insert_absent(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``source`` whose key the target does not have yet, each key once."""
    return source.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")


def delete_by_key(target: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target without the rows whose key is in ``doomed``."""
    return target.join(doomed.select(*keys).distinct(), list(keys), "left_anti")


def upsert_with_ids(
    name: str,
    tables: Tables,
    source: DataFrame,
    keys: Sequence[str],
    update: Sequence[str],
) -> DataFrame:
    """Upsert on a natural key; rows that are new get the next identity keys."""
    target, (identity,) = tables[name], PRIMARY_KEYS[name]
    fresh = assign_ids(source.join(target.select(*keys), list(keys), "left_anti"), target, identity, keys)
    known = source.join(target.select(*keys, identity), list(keys))
    return conform(upsert(target, known.unionByName(fresh, allowMissingColumns=True), keys, update), name)
