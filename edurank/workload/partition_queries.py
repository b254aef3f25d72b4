"""Queries over partitioned tables: what a change rewrites, read from the files before and after it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edurank.operators import merging, regions
from edurank.plans.materialize import FOLDER, materialize, shared_folder
from edurank.sources.partitions import REGION, YEAR, PartitionedStore, partition_columns
from edurank.workload.quality_queries import _INCOMING, _PLACES, _YEAR_CTES, DUPLICATE_CTES, _first_region, _incoming_years
from edurank.workload.registry import register
from edurank.workload.views import with_views

TABLES = (
    "region", "municipality", "school", "school_profile", "school_profile_link", "school_external_key", "ege_subject",
    "ege_school_year", "ege_school_subject_stat", "school_admission_stat", "prof_event",
)
# Tables whose partitions the queries look at.
LOOKED_AT = tuple(t for t in TABLES if t not in ("region", "school_profile", "ege_subject"))


def _fresh_store(tables) -> PartitionedStore:
    """The domain tables in a store of their own; it goes with the other intermediate tables."""
    root = f"{shared_folder(tables.spark)}/{FOLDER}/store-{uuid.uuid4().hex}"
    return PartitionedStore(tables.spark, root).create(tables, TABLES)


def _state(store: PartitionedStore, name: str) -> DataFrame:
    """Rows and files of all partitions as they are now."""
    parts = []
    for table in LOOKED_AT:
        columns = partition_columns(table)
        year = F.col(YEAR) if YEAR in columns else F.lit(None).cast("int").alias(YEAR)
        parts.append(store.partitions(table).select(F.lit(table).alias("table_name"), REGION, year, F.col("n").alias(f"rows_{name}"), F.col("files").alias(f"files_{name}")))
    return materialize(reduce(DataFrame.unionByName, parts))


def _compared(tables, change) -> DataFrame:
    """Rows of every partition before and after ``change`` of a store, and whether its files are others now."""
    store = _fresh_store(tables)
    before = _state(store, "before").alias("b")
    change(store)
    after = _state(store, "after").alias("a")
    keys = ["table_name", REGION, YEAR]
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
    both = before.join(after, same, "full_outer")
    return both.select(
        F.coalesce("b.table_name", "a.table_name").alias("table_name"),
        F.coalesce(f"b.{REGION}", f"a.{REGION}").alias("region_id"),
        F.coalesce(f"b.{YEAR}", f"a.{YEAR}").alias("year"),
        F.coalesce("rows_before", F.lit(0)).alias("rows_before"),
        F.coalesce("rows_after", F.lit(0)).alias("rows_after"),
        (~F.col("files_before").eqNullSafe(F.col("files_after"))).alias("rewritten"),
    )


_FIRST = "(select min(region_id) from f_region)"
_HOMES = [("homes", "select school_id, region_id from f_school join f_municipality using (municipality_id)")]
_BEFORE = {
    "municipality": "select region_id, null as yr, (municipality_id, name)::varchar as item from f_municipality",
    "school": "select region_id, null as yr, school_id::varchar as item from f_school left join homes using (school_id)",
    "school_profile_link": "select region_id, null as yr, (school_id, profile_id)::varchar as item from f_profile_link left join homes using (school_id)",
    "school_external_key": "select region_id, null as yr, ext_key_id::varchar as item from f_external_key left join homes using (school_id)",
    "ege_school_year": "select region_id, yr, (ege_school_year_id, school_id, kind, graduates_total)::varchar as item from f_year left join homes using (school_id)",
    "ege_school_subject_stat": "select region_id, yr, (ege_school_year_id, subject_id, participants_cnt, not_passed_cnt, high_80_99_cnt, score_100_cnt, avg_h, chosen_cnt)::varchar as item "
    "from f_stat left join f_year y using (ege_school_year_id) left join homes using (school_id)",
    "school_admission_stat": "select region_id, yr, (adm_stat_id, school_id, applicants_cnt, enrolled_cnt)::varchar as item from f_admission left join homes using (school_id)",
    "prof_event": "select region_id, year(event_date) as yr, (event_id, school_id)::varchar as item from f_event left join homes using (school_id)",
}
_VIEWS = (*_PLACES, "f_profile", "f_profile_link", "f_external_key", "f_year", "f_stat", "f_admission", "f_event")


def _compared_sql(after: dict[str, str], ctes) -> str:
    """Partitions of the rows before and after; ``rewritten`` if their contents differ."""
    sides = " union all ".join(
        f"select '{table}' as table_name, {side} as side, * from ({text})"
        for side, texts in ((0, _BEFORE), (1, {**_BEFORE, **after}))
        for table, text in texts.items()
    )
    contents = (
        "select table_name, region_id, yr, count(*) filter (where side = 0) as rows_before, "
        "count(*) filter (where side = 1) as rows_after, list(item order by item) filter (where side = 0) as old, "
        "list(item order by item) filter (where side = 1) as new from sides group by 1, 2, 3"
    )
    return with_views(
        "select table_name, region_id, cast(yr as bigint) as year, rows_before, rows_after, old is distinct from new as rewritten from contents",
        *_VIEWS,
        ctes=[*_HOMES, *ctes, ("sides", sides), ("contents", contents)],
    )


_REGION_MAP = (
    "map",
    "select old_id, new_id from (select unnest(members) as old_id, keep_school_id as new_id from alike "
    f"where region_id = {_FIRST}) where old_id <> new_id",
)
_MERGED = {
    "school": "select region_id, null, school_id::varchar from f_school left join homes using (school_id) where school_id not in (select old_id from map)",
    "school_external_key": "select region_id, null, ext_key_id::varchar from f_external_key left join homes using (school_id) where school_id not in (select old_id from map)",
    "school_profile_link": "select region_id, null, (id, profile_id)::varchar from (select distinct coalesce(new_id, school_id) as id, profile_id from f_profile_link left join map on old_id = school_id) "
    "left join homes on homes.school_id = id",
    "ege_school_year": "select region_id, yr, (ege_school_year_id, school_id, kind, graduates_total)::varchar from years left join homes using (school_id)",
    "ege_school_subject_stat": "select region_id, yr, (id, subject_id, p, n, h, s, a, c)::varchar from (select m.new_id as id, subject_id, max(participants_cnt) as p, max(not_passed_cnt) as n, "
    "max(high_80_99_cnt) as h, max(score_100_cnt) as s, max(avg_h) as a, max(chosen_cnt) as c from f_stat join year_map m on m.old_id = ege_school_year_id group by 1, 2) "
    "left join years on years.ege_school_year_id = id left join homes using (school_id)",
    "school_admission_stat": "select region_id, yr, (first_id, id, a, e)::varchar from (select coalesce(new_id, school_id) as id, yr, max(applicants_cnt) as a, max(enrolled_cnt) as e, "
    "first(adm_stat_id order by new_id is not null, school_id) as first_id from f_admission left join map on old_id = school_id group by 1, 2) left join homes on homes.school_id = id",
    "prof_event": "select region_id, year(event_date), (event_id, coalesce(new_id, f_event.school_id))::varchar from f_event left join homes using (school_id) left join map on old_id = f_event.school_id",
}


@register("merge_touched_partitions", _compared_sql(_MERGED, [*DUPLICATE_CTES[:-1], _REGION_MAP, *_YEAR_CTES[len(DUPLICATE_CTES) :]]))
def _merge_touched(tables):
    def change(store):
        own = store.only(tables["region"].agg(F.min("region_id")).first()[0])
        merging.merge_duplicate_schools(own.load()).apply(own)

    return _compared(tables, change)


_DELETED = {table: f"select * from ({text}) where region_id is distinct from {_FIRST}" for table, text in _BEFORE.items()}


@register("delete_region_partitions", _compared_sql(_DELETED, []))
def _delete_touched(tables):
    def change(store):
        regions.delete_region(store.load(), _first_region(tables)).apply(store)

    return _compared(tables, change)


@register(
    "upsert_partitions",
    with_views(
        "select coalesce(t.school_id, s.school_id) as school_id, cast(coalesce(t.yr, s.yr) as bigint) as year, "
        "coalesce(t.kind, s.kind) as kind, coalesce(s.graduates_total, t.graduates_total) as graduates_total, "
        "coalesce((region_id, coalesce(t.yr, s.yr)) in (select (region_id, yr) from incoming left join homes using (school_id)), false) as rewritten "
        "from f_year t full join incoming s on s.school_id = t.school_id and s.yr = t.yr and s.kind = t.kind "
        "left join homes on homes.school_id = coalesce(t.school_id, s.school_id)",
        *_PLACES,
        "f_year",
        ctes=[*_HOMES, ("incoming", _INCOMING)],
    ),
)
def _upsert_partitions(tables):
    store, name = _fresh_store(tables), "ege_school_year"
    files = materialize(store.stored(name).select(F.col("_metadata.file_name").alias("file")).distinct())
    store.upsert(name, _incoming_years(tables), ["school_id", "year", "kind"], ["graduates_total"])
    rows = store.stored(name).select("school_id", "year", "kind", "graduates_total", F.col("_metadata.file_name").alias("file"))
    known = files.withColumn("_known", F.lit(True))
    return rows.join(known, "file", "left").withColumn("rewritten", F.col("_known").isNull()).drop("file", "_known")
