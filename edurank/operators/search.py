"""School search: name, place, profile and subject filters, paged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edurank.functions.numeric import HAS_PEOPLE, exact_ratio
from edurank.operators import division, facts
from edurank.operators.schools import profile_names, schools_in_scope
from edurank.plans.materialize import materialize
from edurank.plans.paging import page_rows, with_row_number
from edurank.plans.params import Page, SchoolFilters
from edurank.sources.store import Tables


@dataclass(frozen=True)
class SearchResult:
    rows: DataFrame
    total: int
    page: Page


def schools_with_subjects(tables: Tables, filters: SchoolFilters) -> DataFrame:
    """Schools with one school year that lists every wanted subject, whatever its counts."""
    count = division.words(filters.subject_ids)
    found = division.set_aggregate(division.number_of("subject_id", filters.subject_ids), "true", count)
    complete = (
        tables["ege_school_subject_stat"]
        .where(F.col("subject_id").isin(*filters.subject_ids))
        .groupBy("ege_school_year_id")
        .agg(F.expr(f"{found} as _found"))
        .where(f"{division.common('_found', '_found', count)} = {len(filters.subject_ids)}")
    )
    return facts.periods(tables, filters).join(complete, "ege_school_year_id", "left_semi").select("school_id")


def matching_schools(tables: Tables, filters: SchoolFilters) -> DataFrame:
    """Schools that pass every filter, with their place."""
    schools = schools_in_scope(tables, filters)
    if filters.subject_ids:
        schools = schools.join(schools_with_subjects(tables, filters), "school_id", "left_semi")
    elif filters.year is not None or filters.kind:
        schools = schools.join(facts.periods(tables, filters), "school_id", "left_semi")
    return schools


def search_summary(tables: Tables, wanted: DataFrame | None) -> DataFrame:
    """Period and score summary over all years and kinds, whatever the filters say."""
    school_years = facts.periods(tables, None, wanted)
    stats = tables["ege_school_subject_stat"].where(f"avg_score is not null and {HAS_PEOPLE}")
    if wanted is not None:
        stats = stats.join(school_years.select("ege_school_year_id"), "ege_school_year_id", "left_semi")
    # per school year first: the school shuffle then carries one row per year
    per_year = stats.groupBy("ege_school_year_id").agg(
        F.expr("sum(avg_score) as _sum"), F.expr("count(avg_score) as _cnt")
    )
    scores = (
        school_years.select("ege_school_year_id", "school_id")
        .join(per_year, "ege_school_year_id")
        .groupBy("school_id")
        .agg(F.expr(f"{exact_ratio('sum(_sum)', 'sum(_cnt)', 2)} as avg_score"))
    )
    return facts.period_summary(school_years).join(scores, "school_id", "left")


def describe(tables: Tables, schools: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """Search columns for schools that were found."""
    return (
        schools.join(profile_names(tables, wanted), "school_id", "left")
        .join(search_summary(tables, wanted), "school_id", "left")
        .selectExpr(
            "school_id",
            "full_name",
            "cast(null as string) as short_name",
            "is_active",
            "region_id",
            "region_name",
            "municipality_id",
            "municipality_name",
            "coalesce(profile_names, '') as profile_names",
            "last_year",
            "ege_years",
            "cast(coalesce(avg_graduates, 0) as decimal(10,1)) as avg_graduates",
            "avg_score",
        )
    )


def search_all(tables: Tables, filters: SchoolFilters) -> DataFrame:
    """Every match, unpaged and unordered (exports, counting)."""
    return describe(tables, matching_schools(tables, filters), None)


def _by_name(language: str | None) -> tuple[Column, Column]:
    """Names by their bytes, or by the rules of a language; the id as last tiebreak."""
    name = F.col("full_name") if language is None else F.collate("full_name", language)
    return name.asc(), F.col("school_id").asc()


def in_name_order(tables: Tables, filters: SchoolFilters, language: str | None = None) -> DataFrame:
    """All matches with their ``place`` in name order, from 1."""
    return with_row_number(matching_schools(tables, filters), _by_name(language), "place")


def search_page(tables: Tables, filters: SchoolFilters, page: Page, language: str | None = None) -> DataFrame:
    """One page in name order.  Summaries are computed for the page's schools only.

    Names sort by their bytes, or by the rules of a ``language`` (such as ``ru``:
    letters whatever their case and accents first, then these).
    """
    order = _by_name(language)
    found = materialize(page_rows(matching_schools(tables, filters), order, page.offset, page.limit))
    wanted = F.broadcast(found.select("school_id"))  # at most one page
    return describe(tables, found, wanted).orderBy(*order)


def search_schools(tables: Tables, filters: SchoolFilters, page: Page | None = None) -> SearchResult:
    """A page (moved to the last one when it lies beyond) and the number of matches."""
    page = page or Page()
    total = matching_schools(tables, filters).count()
    page = page.clamped(total)
    return SearchResult(search_page(tables, filters, page), total, page)


def search_export(tables: Tables, filters: SchoolFilters) -> DataFrame:
    """Columns of the search sheet."""
    return search_all(tables, filters).selectExpr(
        "school_id",
        "region_name as region",
        "municipality_name as municipality",
        "full_name as school",
        "short_name",
        "profile_names as profiles",
        "is_active",
        "last_year as ege_last_year",
        "ege_years",
        "cast(avg_graduates as double) as ege_avg_graduates",
        "cast(avg_score as double) as ege_avg_score",
    )
