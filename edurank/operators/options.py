"""Choices offered by the filter forms, programs and their requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edurank.plans.params import unique_ids
from edurank.sources.store import Tables


def municipalities(tables: Tables, region_id: int | None) -> DataFrame:
    """Municipalities of one region; none without a region."""
    rows = tables["municipality"].where(F.col("region_id") == region_id if region_id is not None else F.lit(False))
    return rows.select("municipality_id", "name").orderBy("name", "municipality_id")


def filter_options(tables: Tables, region_id: int | None = None, with_min_score: bool = False) -> dict[str, DataFrame]:
    """The six lists behind the filter form."""
    subject_columns = ["subject_id", "name"] + (["min_passing_score"] if with_min_score else [])
    years = tables["ege_school_year"]
    return {
        "regions": tables["region"].select("region_id", "name").orderBy("name"),
        "municipalities": municipalities(tables, region_id),
        "profiles": tables["school_profile"].select("profile_id", "name").orderBy("name"),
        "years": years.select("year").distinct().orderBy(F.desc("year")),
        "kinds": years.select("kind").distinct().orderBy("kind"),
        "subjects": tables["ege_subject"].select(*subject_columns).orderBy("name"),
    }


def rating_filter_options(tables: Tables, region_id: int | None = None, institute_ids=()) -> dict[str, DataFrame]:
    """The search lists plus pass marks, institutes and programs."""
    return {
        **filter_options(tables, region_id, with_min_score=True),
        "institutes": tables["institute"].select("institute_id", "name").orderBy("name"),
        "programs": programs(tables, institute_ids),
    }


def programs(tables: Tables, institute_ids=()) -> DataFrame:
    """Active programs, optionally of some institutes."""
    active = tables["study_program"].where(F.col("is_active").eqNullSafe(True))
    if institute_ids:
        active = active.where(F.col("institute_id").isin(*unique_ids(institute_ids)))
    institutes = tables["institute"].withColumnRenamed("name", "institute_name")
    return (
        active.join(institutes, "institute_id")
        .select("program_id", "institute_id", "institute_name", "code", "name")
        .orderBy("institute_name", "code", "name")
    )


def requirement_rows(tables: Tables, institute_ids=(), program_ids=()) -> DataFrame:
    """One row per program and subject of the scope, required subjects first."""
    scoped = programs(tables, institute_ids)
    if program_ids:
        scoped = scoped.where(F.col("program_id").isin(*unique_ids(program_ids)))
    if not institute_ids and not program_ids:
        scoped = scoped.limit(0)
    subjects = tables["ege_subject"].withColumnRenamed("name", "subject_name")
    role_order = F.when(F.col("role") == "required", 1).when(F.col("role") == "choice", 2).otherwise(3)
    return (
        scoped.withColumnRenamed("name", "program_name")
        .join(tables["program_ege_requirement"].drop("req_id"), "program_id", "left")
        .join(subjects, "subject_id", "left")
        .select(
            "program_id",
            "institute_name",
            "code",
            "program_name",
            "role",
            "weight",
            "subject_id",
            "subject_name",
            "min_passing_score",
        )
        .orderBy("institute_name", "code", "program_name", role_order, "subject_name")
    )


def program_requirements(tables: Tables, institute_ids=(), program_ids=()) -> DataFrame:
    """One row per program with its required and choice subjects as arrays."""
    subject = F.struct(
        F.col("subject_name").alias("name"),
        "subject_id",
        "weight",
        F.col("min_passing_score").cast("double").alias("min_passing_score"),
    )
    known = F.col("subject_id").isNotNull()
    required = F.lower(F.trim(F.coalesce("role", F.lit("")))) == "required"
    return (
        requirement_rows(tables, institute_ids, program_ids)
        .groupBy("program_id", "institute_name", "code", F.col("program_name").alias("name"))
        .agg(
            F.array_sort(F.collect_list(F.when(known & required, subject))).alias("required_subjects"),
            F.array_sort(F.collect_list(F.when(known & ~required, subject))).alias("choice_subjects"),
        )
        .orderBy("institute_name", F.coalesce("code", F.lit("")), "name")
    )
