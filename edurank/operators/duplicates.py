"""Duplicate schools and municipalities.

Groups are described by aggregates and a (duplicate -> kept) map in rows; no
array holds the members of a group, so a group may be as large as it likes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edurank.functions import text
from edurank.operators.schools import with_place
from edurank.plans.materialize import dealt, materialize
from edurank.plans.paging import with_row_number
from edurank.sources.store import Tables

GROUP_KEYS = ["region_id", "municipality_key", "code_key", "school_name_norm"]


def keyed_schools(tables: Tables, region: str | None = None) -> DataFrame:
    """Schools with the four parts of their duplicate key; nameless ones are left out."""
    schools = dealt(with_place(tables))
    if region is not None:
        schools = schools.where(text.region_norm(F.col("region_name")) == text.region_norm(F.lit(region)))
    return schools.select(
        "school_id",
        "is_active",
        "full_name",
        "municipality_name",
        "region_id",
        "region_name",
        text.municipality_key(F.col("municipality_name")).alias("municipality_key"),
        F.coalesce(text.school_code3(F.col("full_name")), F.lit("")).alias("code_key"),
        text.duplicate_name_key(F.col("full_name")).alias("school_name_norm"),
    ).where("school_name_norm <> ''")


def _groups(keyed: DataFrame) -> DataFrame:
    """Groups of two and more; an active school is kept before others, then the lowest id."""
    return (
        keyed.groupBy(*GROUP_KEYS)
        .agg(
            F.expr("min(region_name) as region_name"),
            F.expr("count(*) as group_size"),
            F.expr("min(struct(not is_active as passive, school_id)).school_id as keep_school_id"),
        )
        .where("group_size > 1")
    )


def duplicate_groups(tables: Tables, region: str | None = None) -> DataFrame:
    """Numbered duplicate groups in key order."""
    order = [F.col(c) for c in (*GROUP_KEYS, "keep_school_id")]
    return with_row_number(_groups(keyed_schools(tables, region)), order, "group_id").selectExpr(
        "group_id",
        "region_id",
        "region_name",
        "municipality_key",
        "nullif(code_key, '') as school_code3",
        "school_name_norm",
        "keep_school_id",
        "group_size",
    )


def merge_map(tables: Tables, region: str | None = None, limit_groups: int = 0) -> DataFrame:
    """(old_school_id, new_school_id) for every duplicate, optionally of the first groups only.

    The join is on the full group key; a group holding a large part of all schools
    is one hot key on the many side only, which adaptive skew joins split.  Names are cleaned once.
    """
    keyed = materialize(keyed_schools(tables, region).select("school_id", "is_active", "region_name", *GROUP_KEYS))
    groups = _groups(keyed)
    if limit_groups > 0:
        groups = groups.orderBy(*GROUP_KEYS, "keep_school_id").limit(limit_groups)
    return (
        keyed.select("school_id", *GROUP_KEYS)
        .join(groups.select(*GROUP_KEYS, "keep_school_id"), GROUP_KEYS)
        .where("school_id <> keep_school_id")
        .selectExpr("school_id as old_school_id", "keep_school_id as new_school_id")
    )


def duplicate_samples(tables: Tables, region: str | None = None, limit: int = 30) -> DataFrame:
    """The largest groups, one row per duplicate with names to look at."""
    largest = duplicate_groups(tables, region).orderBy(F.desc("group_size"), "group_id").limit(max(0, limit))
    members = keyed_schools(tables, region)
    kept = members.selectExpr(
        "school_id as keep_school_id", "is_active as keep_is_active", "full_name as keep_full_name"
    )
    return (
        largest.selectExpr("*", "coalesce(school_code3, '') as code_key")
        .drop("region_name")
        .join(members, GROUP_KEYS)
        .where("school_id <> keep_school_id")
        .join(kept, "keep_school_id")
        .selectExpr(
            "group_id",
            "region_name",
            "municipality_key",
            "code_key as school_code3",
            "keep_school_id",
            "keep_is_active",
            "keep_full_name",
            "group_size - 1 as dup_count",
            "school_id as dup_school_id",
            "is_active as dup_is_active",
            "municipality_name as dup_municipality",
            "full_name as dup_full_name",
        )
        .orderBy(F.desc("dup_count"), "group_id", "dup_school_id")
    )


def duplicate_counts(tables: Tables, region: str | None = None) -> DataFrame:
    """Number of groups and of schools to be merged away."""
    return _groups(keyed_schools(tables, region)).selectExpr(
        "count(*) as groups", "coalesce(sum(group_size - 1), 0) as duplicates"
    )


def duplicate_municipalities(tables: Tables) -> DataFrame:
    """Municipality names that only differ in spelling, one row per member."""
    normed = tables["municipality"].select(
        "municipality_id", "region_id", "name", text.municipality_norm(F.col("name")).alias("name_norm")
    )
    groups = normed.groupBy("region_id", "name_norm").agg(F.expr("count(*) as dup_count")).where("dup_count > 1")
    return normed.join(groups, ["region_id", "name_norm"]).select(
        "region_id", "name_norm", "dup_count", "municipality_id", "name"
    )
