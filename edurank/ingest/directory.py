"""Loading school directories: regions, municipalities, schools, profiles and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edurank.functions import text
from edurank.plans.change import ChangePlan
from edurank.plans.materialize import dealt, materialize
from edurank.plans.ordered import forward_fill
from edurank.sources.cells import (
    SHEET,
    body_rows,
    flat_columns,
    has_words,
    header_rows,
)
from edurank.sources.store import Tables, assign_ids, conform, insert_absent

# Headings of a directory sheet in comparable form.
HEADINGS = {
    "mun_col": "муниципальное образование",
    "school_col": "образовательная организация (школа)",
    "profile_col": "профиль (при наличии)",
}
FALLBACKS = {
    "mun_col": (("муницип",),),
    "school_col": (("образоват", "организац"), ("школ",)),
    "profile_col": (("профил",),),
}


def directory_layout(cells: DataFrame) -> DataFrame:
    """Column roles per sheet by exact heading, else by word parts; sheets without both names are left out."""
    columns = flat_columns(cells, header_rows(cells))
    heading = F.col("heading")

    def first(condition: Column) -> Column:
        return F.min(F.when(condition, F.col("col_idx")))

    roles = []
    for role, exact in HEADINGS.items():
        choices = [F.max(F.when(heading == exact, F.col("col_idx")))]
        choices += [first(has_words(heading, *words)) for words in FALLBACKS[role]]
        roles.append(F.coalesce(*choices).alias(role))
    return (
        columns.groupBy(*SHEET, F.expr("header_row + 1 as first_row"))
        .agg(*roles)
        .where("mun_col is not null and school_col is not null")
    )


def directory_rows(cells: DataFrame) -> DataFrame:
    """Cleaned directory rows: region (from the file name), municipality, school, profile cell."""
    roles = {"municipality": "mun_col", "school": "school_col", "profile": "profile_col"}
    rows = body_rows(cells, directory_layout(cells), roles)
    filled = dealt(forward_fill(rows, SHEET, "row_idx", ["municipality", "school"]), *SHEET, "row_idx")

    def plain(name: str) -> Column:
        value = text.squeeze(F.col(name))
        return F.when(F.lower(value) == "nan", "").otherwise(value)

    named = filled.select(
        text.region_of_file(F.col("file")).alias("region"),
        text.municipality_name(plain("municipality")).alias("municipality"),
        plain("school").alias("_school"),
        plain("profile").alias("profile_raw"),
    ).where("_school <> ''")
    # kept before filtering: a filter on a cleaned name would repeat the cleaning
    standard = materialize(named.withColumn("school", text.standard_school_name(F.col("_school"))).drop("_school"))
    total = r"(?iU)\bвсего\b"
    kept = standard.where(
        (F.col("municipality") != "")
        & ~F.col("municipality").rlike(total)
        & ~F.col("school").rlike(total)
    )
    return kept.select("region", "municipality", "school", "profile_raw").distinct()


def _grown(tables: Tables, table: str, fresh: DataFrame, key: str, order: list[str]) -> DataFrame:
    return materialize(tables[table].unionByName(conform(assign_ids(fresh, tables[table], key, order), table)))


def _keyed_schools(places: DataFrame, schools: DataFrame) -> DataFrame:
    """Schools with the keys of the directory comparison."""
    return dealt(schools, *schools.columns).join(places, "municipality_id").select(
        *schools.columns,
        "region_id",
        text.municipality_key(F.col("municipality")).alias("municipality_key"),
        (text.region_norm(F.col("region")) == text.PRIMORSKY).alias("by_code"),
        text.school_code3(F.col("full_name")).alias("code3"),
        text.school_name_norm(F.col("full_name")).alias("name_norm"),
    )


def new_schools(places: DataFrame, wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Directory schools that match no stored one, neither by code (Primorsky) nor by name."""
    source = _keyed_schools(places, wanted.withColumn("is_active", F.lit(True)))
    keys = ["region_id", "municipality_key", "by_code", "code3", "name_norm"]
    once = source.groupBy(*keys).agg(
        F.expr("min(municipality_id) as municipality_id"),
        F.expr("min(full_name) as full_name"),
        F.expr("bool_or(is_active) as is_active"),
    )
    known = _keyed_schools(places, stored)
    by_name = known.select("region_id", "municipality_key", "name_norm")
    by_code = known.where("code3 is not null").selectExpr(
        "region_id", "municipality_key", "code3", "true as by_code"
    )
    absent = once.join(by_name, ["region_id", "municipality_key", "name_norm"], "left_anti").join(
        by_code, ["region_id", "municipality_key", "code3", "by_code"], "left_anti"
    )
    rows = absent.select("municipality_id", "full_name", "is_active")
    return insert_absent(stored, rows, ["municipality_id", "full_name"])


def find_schools(places: DataFrame, wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored school behind each (municipality_id, full_name): by code first, then by name, lowest id."""
    source = _keyed_schools(places, wanted)
    known = _keyed_schools(places, stored)
    area = ["region_id", "municipality_key"]
    by_code = (
        known.where("by_code and code3 is not null").groupBy(*area, "code3").agg(F.expr("min(school_id) as school_id"))
    )
    by_name = known.groupBy(*area, "name_norm").agg(F.expr("min(school_id) as school_id"))
    candidates = (
        source.where("by_code and code3 is not null")
        .join(by_code, [*area, "code3"])
        .selectExpr("municipality_id", "full_name", "school_id", "1 as priority")
        .unionByName(
            source.join(by_name, [*area, "name_norm"]).selectExpr(
                "municipality_id", "full_name", "school_id", "2 as priority"
            )
        )
    )
    return candidates.groupBy("municipality_id", "full_name").agg(
        F.expr("min_by(school_id, struct(priority, school_id)) as school_id")
    )


def load_school_directory(tables: Tables, cells: DataFrame) -> ChangePlan:
    """Plan that adds what a directory names and the store lacks."""
    rows = materialize(directory_rows(cells))
    names = rows.selectExpr("region as name").distinct()
    regions = _grown(
        tables, "region", insert_absent(tables["region"], names, ["name"]), "region_id", ["name"]
    )

    placed = rows.join(regions.withColumnRenamed("name", "region"), "region").withColumn(
        "_norm", text.municipality_norm(F.col("municipality"))
    )
    stored_municipalities = tables["municipality"].withColumn("_norm", text.municipality_norm(F.col("name")))
    fresh = (
        placed.groupBy("region_id", "_norm")
        .agg(F.expr("min(municipality) as name"))
        .join(stored_municipalities, ["region_id", "_norm"], "left_anti")
    )
    municipalities = _grown(tables, "municipality", fresh, "municipality_id", ["region_id", "name"])
    municipality_ids = (
        municipalities.withColumn("_norm", text.municipality_norm(F.col("name")))
        .groupBy("region_id", "_norm")
        .agg(F.expr("min(municipality_id) as municipality_id"))
    )
    located = materialize(
        placed.join(municipality_ids, ["region_id", "_norm"]).selectExpr(
            "municipality_id", "school as full_name", "profile_raw"
        )
    )
    wanted = located.where("full_name <> ''").select("municipality_id", "full_name").distinct()
    places = municipalities.withColumnRenamed("name", "municipality").join(
        regions.withColumnRenamed("name", "region"), "region_id"
    )
    added = new_schools(places, wanted, tables["school"])
    schools = _grown(tables, "school", added, "school_id", ["municipality_id", "full_name"])
    school_ids = find_schools(places, wanted, schools)

    tokens = (
        dealt(located, *located.columns).withColumn("name", F.explode(text.profile_tokens(F.col("profile_raw"))))
        .join(school_ids, ["municipality_id", "full_name"])
        .select("school_id", "name")
        .distinct()
    )
    tokens = materialize(tokens)
    profiles = _grown(
        tables,
        "school_profile",
        insert_absent(tables["school_profile"], tokens.select("name"), ["name"]),
        "profile_id",
        ["name"],
    )
    links = tokens.join(profiles, "name").select("school_id", "profile_id")
    known_links = tables["school_profile_link"]
    all_links = known_links.unionByName(insert_absent(known_links, links, ["school_id", "profile_id"]))
    counts = reduce(
        DataFrame.unionByName,
        [
            rows.selectExpr("'regions' as item", "count(distinct region) as amount"),
            placed.selectExpr("'municipalities' as item", "count(distinct region_id, municipality) as amount"),
            wanted.selectExpr("'schools' as item", "count(*) as amount"),
            tokens.selectExpr("'profiles' as item", "count(distinct name) as amount"),
            links.selectExpr("'links' as item", "count(*) as amount"),
        ],
    )
    return ChangePlan(
        {
            "region": regions,
            "municipality": municipalities,
            "school": schools,
            "school_profile": profiles,
            "school_profile_link": all_links,
        },
        {"rows": rows, "school_ids": school_ids, "counts": counts},
        base=tables.version,
    )


