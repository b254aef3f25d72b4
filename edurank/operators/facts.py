"""Exam facts summed per school and per school and subject."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edurank.functions.numeric import HAS_PEOPLE, exact_avg, exact_ratio, people
from edurank.plans.joins import join_few_keys
from edurank.plans.params import SchoolFilters
from edurank.sources.store import Tables


def _narrowed(rows: DataFrame, filters: SchoolFilters | None, schools: DataFrame | None) -> DataFrame:
    if filters is not None and filters.year is not None:
        rows = rows.where(F.col("year") == filters.year)
    if filters is not None and filters.kind:
        rows = rows.where(F.col("kind") == filters.kind)
    if schools is not None:
        rows = rows.join(schools.select("school_id"), "school_id", "left_semi")
    return rows


def periods(tables: Tables, filters: SchoolFilters | None = None, schools: DataFrame | None = None) -> DataFrame:
    """School years of the wanted year and kind, for the wanted schools."""
    return _narrowed(tables["ege_school_year"], filters, schools)


def period_summary(school_years: DataFrame) -> DataFrame:
    """Average graduates, latest year and number of years per school."""
    return school_years.groupBy("school_id").agg(
        F.expr(f"{exact_avg('graduates_total', 1)} as avg_graduates"),
        F.expr("max(year) as last_year"),
        F.expr("count(distinct year) as ege_years"),
    )


def subject_rows(tables: Tables, school_years: DataFrame) -> DataFrame:
    """Subject statistics of the given school years that stand for people."""
    stats = tables["ege_school_subject_stat"].where(HAS_PEOPLE)
    return stats.join(school_years.select("ege_school_year_id", "school_id"), "ege_school_year_id")


def scoped_subject_rows(tables: Tables, filters: SchoolFilters | None = None, schools: DataFrame | None = None) -> DataFrame:
    """Subject statistics that stand for people, of the wanted school years; from the widened ones where there are any."""
    if tables.subject_facts is None:
        return subject_rows(tables, periods(tables, filters, schools))
    return _narrowed(tables.subject_facts.where(HAS_PEOPLE), filters, schools)


def school_subjects(rows: DataFrame) -> DataFrame:
    """One row per school and subject: presence, exact mean score and mean size.

    ``score_sum`` and ``score_cnt`` are kept because the mean over all rows of a
    school is not the mean of its subject means.
    """
    return (
        rows.groupBy("school_id", "subject_id")
        .agg(
            F.expr("sum(avg_score) as score_sum"),
            F.expr("count(avg_score) as score_cnt"),
            F.expr(f"{exact_avg(people(), 2)} as participants_avg"),
        )
        .selectExpr("*", f"{exact_ratio('score_sum', 'score_cnt', 2)} as avg_score")
    )


# Mean over statistics rows from already summed parts (aggregate).
MEAN_SCORE = exact_ratio("sum(score_sum)", "sum(score_cnt)", 2)


def reaches(score: str, pass_mark: str | None, min_avg_score: float | None) -> str:
    """Score at or above the pass mark (none means 0) and the requested minimum."""
    conditions = []
    if pass_mark is not None:
        conditions.append(f"{score} >= coalesce({pass_mark}, 0)")
    if min_avg_score is not None:
        conditions.append(f"{score} >= {Decimal(str(min_avg_score)):f}BD")
    return "(" + (" and ".join(conditions) or "true") + ")"


def with_pass_marks(tables: Tables, subjects: DataFrame) -> DataFrame:
    """Attach the pass mark of each subject."""
    marks = tables["ege_subject"].select("subject_id", "min_passing_score")
    return join_few_keys(subjects, marks, ["subject_id"], F.col("school_id"), how="left")
