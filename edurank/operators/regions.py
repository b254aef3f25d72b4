"""Deleting a region with everything below it, and clearing the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edurank.plans.change import ChangePlan
from edurank.sources.schema import RUN_TABLES, struct_type
from edurank.sources.store import Tables, delete_by_key

SCHOOL_TABLES = (
    "analytics_school_selection",
    "analytics_run_school",
    "analytics_school_metric_value",
    "analytics_school_rating",
    "analytics_school_card",
    "analytics_school_report",
    "ege_school_year",
    "school_admission_stat",
    "prof_event",
    "school_external_key",
    "school_profile_link",
    "school",
)


def orphan_runs(tables: Tables) -> DataFrame:
    """Runs without ratings, metric values, cards and reports."""
    runs = tables["analytics_rating_run"]
    for table in (
        "analytics_school_rating",
        "analytics_school_metric_value",
        "analytics_school_card",
        "analytics_school_report",
    ):
        runs = delete_by_key(runs, tables[table], ["run_id"])
    return runs


def orphan_requests(tables: Tables) -> DataFrame:
    """Requests without filters, selected schools and runs."""
    requests = tables["analytics_request"]
    for table in ("analytics_request_filter", "analytics_school_selection", "analytics_rating_run"):
        requests = delete_by_key(requests, tables[table], ["request_id"])
    return requests


def region_scope(tables: Tables, region_id: int) -> dict[str, DataFrame]:
    """Keys of everything that belongs to a region."""
    municipalities = tables["municipality"].where(F.col("region_id") == region_id).select("municipality_id")
    schools = tables["school"].join(municipalities, "municipality_id", "left_semi").select("school_id")
    years = tables["ege_school_year"].join(schools, "school_id", "left_semi").select("ege_school_year_id")
    admissions = tables["school_admission_stat"].join(schools, "school_id", "left_semi").select("adm_stat_id")
    return {
        "municipality": municipalities,
        "school": schools,
        "ege_school_year": years,
        "school_admission_stat": admissions,
    }


def delete_region(tables: Tables, name: str) -> ChangePlan | None:
    """Plan that removes the region, its data and runs and requests left empty; None if unknown."""
    region = tables["region"].where(F.col("name") == name).select("region_id").first()
    if region is None:
        return None
    region_id = region[0]
    scope = region_scope(tables, region_id)
    schools, municipalities = scope["school"], scope["municipality"]
    changed = {table: delete_by_key(tables[table], schools, ["school_id"]) for table in SCHOOL_TABLES}
    changed["ege_school_subject_stat"] = delete_by_key(
        tables["ege_school_subject_stat"], scope["ege_school_year"], ["ege_school_year_id"]
    )
    changed["school_admission_detail"] = delete_by_key(
        tables["school_admission_detail"], scope["school_admission_stat"], ["adm_stat_id"]
    )
    touched = {table: ("school_id", schools) for table in SCHOOL_TABLES}
    touched["ege_school_subject_stat"] = ("ege_school_year_id", scope["ege_school_year"])
    touched["school_admission_detail"] = ("adm_stat_id", scope["school_admission_stat"])
    touched["municipality"] = ("municipality_id", municipalities)
    filters = tables["analytics_request_filter"].where(~F.col("region_id").eqNullSafe(region_id))
    filters = delete_by_key(filters, municipalities, ["municipality_id"])
    changed["analytics_request_filter"] = delete_by_key(filters, schools, ["school_id"])
    changed["municipality"] = tables["municipality"].where(F.col("region_id") != region_id)
    changed["region"] = tables["region"].where(F.col("region_id") != region_id)
    # runs and requests are judged on what is left; a run's weights go with it
    left = tables.with_tables(changed)
    empty_runs = orphan_runs(left)
    changed["analytics_rating_run"] = delete_by_key(tables["analytics_rating_run"], empty_runs, ["run_id"])
    for table in ("analytics_run_metric", "analytics_run_school"):
        changed[table] = delete_by_key(left[table], empty_runs, ["run_id"])
    left = tables.with_tables(changed)
    changed["analytics_request"] = delete_by_key(
        tables["analytics_request"], orphan_requests(left), ["request_id"]
    )
    changed = {name: df.select(*struct_type(name).fieldNames()) for name, df in changed.items()}
    return ChangePlan(changed, scope, base=tables.version, touched=touched)


def deleted_counts(tables: Tables, plan: ChangePlan) -> DataFrame:
    """Rows removed per table."""
    result = None
    for name in sorted(plan.tables):
        before = tables[name].select(F.lit(name).alias("table_name"), F.lit(1).alias("n"))
        after = plan.tables[name].select(F.lit(name).alias("table_name"), F.lit(-1).alias("n"))
        rows = before.unionByName(after)
        result = rows if result is None else result.unionByName(rows)
    return result.groupBy("table_name").agg(F.expr("sum(n) as deleted"))


def clear_analytics(tables: Tables) -> ChangePlan:
    """Plan that empties the ten run tables (new rows then start at 1 again)."""
    return ChangePlan({name: tables.spark.createDataFrame([], struct_type(name)) for name in RUN_TABLES}, base=tables.version)
