"""School directory with its place, and the filters that narrow it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edurank.plans.joins import join_few_keys
from edurank.plans.params import SchoolFilters, normalize_query
from edurank.sources.store import Tables


def stored_name_norm(name: Column) -> Column:
    """Stored side of the name search: squeezed, lower case, without yo; not trimmed."""
    squeezed = F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")
    return F.lower(F.translate(squeezed, "Ёё", "Ее"))


def name_matches(name: Column, query: str) -> Column | None:
    """Substring search in which ``%`` and ``_`` of the query keep their LIKE meaning."""
    folded = normalize_query(query)
    if not folded:
        return None
    pattern = re.sub(r"\\([^%_\\])", r"\1", folded)
    return stored_name_norm(name).like(f"%{pattern}%")


def with_place(tables: Tables, schools: DataFrame | None = None) -> DataFrame:
    """Schools with municipality and region names."""
    municipality = tables["municipality"].withColumnRenamed("name", "municipality_name")
    region = tables["region"].withColumnRenamed("name", "region_name")
    schools = tables["school"] if schools is None else schools
    places = municipality.join(region, "region_id")
    return join_few_keys(schools, places, ["municipality_id"], F.col("school_id"))


def schools_in_scope(tables: Tables, filters: SchoolFilters) -> DataFrame:
    """Schools passing the name, place and profile filters, with their place."""
    schools = tables["school"]
    matches = name_matches(F.col("full_name"), filters.q)
    if matches is not None:
        schools = schools.where(matches)
    if filters.municipality_id is not None:
        schools = schools.where(F.col("municipality_id") == filters.municipality_id)
    if filters.profile_ids:
        links = tables["school_profile_link"].where(F.col("profile_id").isin(*filters.profile_ids))
        schools = schools.join(links, "school_id", "left_semi")
    scoped = with_place(tables, schools)
    if filters.region_id is not None:
        scoped = scoped.where(F.col("region_id") == filters.region_id)
    return scoped


def narrows_schools(filters: SchoolFilters) -> bool:
    """True when :func:`schools_in_scope` leaves out schools."""
    return bool(
        normalize_query(filters.q)
        or filters.profile_ids
        or filters.region_id is not None
        or filters.municipality_id is not None
    )


def profile_names(tables: Tables, wanted: DataFrame | None = None) -> DataFrame:
    """Comma separated profile names per school, optionally only for some schools."""
    links = tables["school_profile_link"]
    if wanted is not None:
        links = links.join(wanted.select("school_id"), "school_id", "left_semi")
    return (
        join_few_keys(links, tables["school_profile"], ["profile_id"], F.col("school_id"))
        .groupBy("school_id")
        .agg(F.expr("listagg(name, ', ') within group (order by name)").alias("profile_names"))
    )
