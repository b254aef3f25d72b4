"""School cards: everything known about a school, nested per school or as flat tables.

The flat builders work for any number of schools.  Arrays of the nested card are
collected after grouping by their natural key (year, kind, subject, source), so
their length is bounded by those domains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edurank.functions.numeric import exact_avg, round_even
from edurank.operators.schools import with_place
from edurank.plans.joins import join_few_keys
from edurank.plans.materialize import materialize
from edurank.sources.store import Tables

COUNTERS = ("participants_cnt", "not_passed_cnt", "high_80_99_cnt", "score_100_cnt", "chosen_cnt")


# A zero average without any positive counter stands for missing data.
SHOWN_AVERAGE = (
    "case when avg_score = 0 and "
    + " and ".join(f"coalesce({c}, 0) <= 0" for c in COUNTERS)
    + " then null else avg_score end"
)


def _of(df: DataFrame, wanted: DataFrame | None) -> DataFrame:
    return df if wanted is None else df.join(wanted.select("school_id"), "school_id", "left_semi")


def card_header(tables: Tables, wanted: DataFrame | None = None) -> DataFrame:
    """School, place and ordered profile names."""
    links = _of(tables["school_profile_link"], wanted)
    profiles = (
        join_few_keys(links, tables["school_profile"], ["profile_id"], F.col("school_id"))
        .groupBy("school_id")
        .agg(F.array_sort(F.collect_list("name")).alias("profiles"))
    )
    missing = F.lit(None).cast("string")
    return (
        with_place(tables, _of(tables["school"], wanted))
        .join(profiles, "school_id", "left")
        .select(
            "school_id",
            "full_name",
            missing.alias("short_name"),
            missing.alias("address"),
            missing.alias("website"),
            "is_active",
            "municipality_id",
            "municipality_name",
            "region_id",
            "region_name",
            F.coalesce("profiles", F.array().cast("array<string>")).alias("profiles"),
        )
    )


def card_external_keys(tables: Tables, wanted: DataFrame | None = None) -> DataFrame:
    return _of(tables["school_external_key"], wanted).select(
        "school_id", "source_name", "external_key", "normalized_name"
    )


def card_admissions(tables: Tables, wanted: DataFrame | None = None) -> DataFrame:
    return _of(tables["school_admission_stat"], wanted).select(
        "school_id", "year", "applicants_cnt", "enrolled_cnt", "enrolled_avg_score"
    )


def prof_events_by_year(tables: Tables, wanted: DataFrame | None = None) -> DataFrame:
    """Events and people reached per school and calendar year."""
    return (
        _of(tables["prof_event"], wanted)
        .groupBy("school_id", F.year("event_date").alias("year"))
        .agg(
            F.count(F.lit(1)).alias("events_cnt"),
            F.coalesce(F.sum("coverage_cnt"), F.lit(0)).alias("coverage_cnt"),
        )
    )


def card_subject_rows(tables: Tables, wanted: DataFrame | None = None) -> DataFrame:
    """Period and subject rows; a period without subjects keeps one row of nulls."""
    subjects = tables["ege_subject"].withColumnRenamed("name", "subject_name")
    stats = _of(tables["ege_school_year"], wanted).join(tables["ege_school_subject_stat"], "ege_school_year_id", "left")
    return (
        join_few_keys(stats, subjects, ["subject_id"], F.col("ege_school_year_id"), how="left")
        .select(
            "school_id",
            "year",
            "kind",
            "graduates_total",
            F.when(F.col("subject_name").isNotNull(), F.col("subject_id")).alias("subject_id"),
            "subject_name",
            "min_passing_score",
            *COUNTERS[:4],
            F.expr(f"{SHOWN_AVERAGE} as avg_score"),
            "chosen_cnt",
        )
    )


def card_periods(tables: Tables, wanted: DataFrame | None = None, subjects: DataFrame | None = None) -> DataFrame:
    """Totals per period over its subjects, with the plain mean of their averages; ``subjects`` are :func:`card_subject_rows`."""
    totals = {
        "participants_total": "participants_cnt",
        "not_passed_total": "not_passed_cnt",
        "high_80_99_total": "high_80_99_cnt",
        "score_100_total": "score_100_cnt",
        "chosen_total": "chosen_cnt",
    }
    known = "case when subject_id is not null then {} end"
    mean = exact_avg(known.format("avg_score"), 12)
    return (
        (card_subject_rows(tables, wanted) if subjects is None else subjects)
        .groupBy("school_id", "year", "kind", "graduates_total")
        .agg(
            F.expr("count(subject_id) as subjects_cnt"),
            *(F.expr(f"coalesce(sum({known.format(c)}), 0) as {name}") for name, c in totals.items()),
            F.expr(f"cast({mean} as double) as _mean"),
        )
        .selectExpr("* except (_mean)", f"{round_even('_mean', 2)} as avg_score_mean")
    )


def school_timeline(tables: Tables, wanted: DataFrame | None = None) -> DataFrame:
    """Periods per school, latest first, each with its subjects in name order."""
    subject = F.struct(
        "subject_name",
        "subject_id",
        "min_passing_score",
        *COUNTERS[:4],
        "avg_score",
        "chosen_cnt",
    )
    by_period = (
        card_subject_rows(tables, wanted)
        .groupBy("school_id", "year", "kind", "graduates_total")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("subject_id").isNotNull(), subject))).alias("subjects"),
        )
    )
    period = F.struct("year", "kind", "graduates_total", "subjects")
    return by_period.groupBy("school_id").agg(
        F.sort_array(F.collect_list(period), asc=False).alias("ege_timeline")
    )


def school_cards(tables: Tables, school_ids=None) -> DataFrame:
    """One nested row per school; all schools when no ids are given."""
    wanted = None
    if school_ids is not None:
        wanted = tables["school"].where(F.col("school_id").isin(*school_ids)).select("school_id")

    def nested(rows: DataFrame, name: str, columns: list[str], ascending: bool) -> DataFrame:
        items = F.sort_array(F.collect_list(F.struct(*columns)), asc=ascending)
        return rows.groupBy("school_id").agg(items.alias(name))

    parts = (
        nested(
            card_external_keys(tables, wanted),
            "external_keys",
            ["source_name", "external_key", "normalized_name"],
            True,
        ),
        nested(
            card_admissions(tables, wanted),
            "admission_stats",
            ["year", "applicants_cnt", "enrolled_cnt", "enrolled_avg_score"],
            False,
        ),
        nested(prof_events_by_year(tables, wanted), "prof_events", ["year", "events_cnt", "coverage_cnt"], False),
        school_timeline(tables, wanted),
    )
    card = card_header(tables, wanted)
    for part in parts:
        card = card.join(part, "school_id", "left")
    for name in ("external_keys", "admission_stats", "prof_events", "ege_timeline"):
        card = card.withColumn(name, F.coalesce(F.col(name), F.array().cast(card.schema[name].dataType)))
    return card


def school_card_export(tables: Tables, school_ids=None) -> dict[str, DataFrame]:
    """The seven sheets of a card; every sheet keeps the school it belongs to."""
    wanted = None
    if school_ids is not None:
        wanted = tables["school"].where(F.col("school_id").isin(*school_ids)).select("school_id")
    header = card_header(tables, wanted)
    # Two sheets are made of these rows, and both are sorted, which reads them twice.
    subjects = materialize(card_subject_rows(tables, wanted))
    return {
        "school": header.select(
            "school_id",
            F.col("full_name").alias("school_name"),
            "region_id",
            "region_name",
            "municipality_id",
            "municipality_name",
            "is_active",
        ),
        "profiles": header.select("school_id", F.explode("profiles").alias("profile_name")),
        "external_keys": card_external_keys(tables, wanted).orderBy("school_id", "source_name"),
        "ege_periods": card_periods(tables, wanted, subjects).orderBy("school_id", F.desc("year"), F.desc("kind")),
        "ege_subjects": subjects.select(
            "school_id",
            "year",
            "kind",
            "graduates_total",
            "subject_name",
            *COUNTERS[:4],
            "avg_score",
            "chosen_cnt",
        ).orderBy("school_id", F.desc("year"), F.desc("kind"), "subject_name"),
        "admission": card_admissions(tables, wanted).orderBy("school_id", F.desc("year")),
        "prof_events": prof_events_by_year(tables, wanted).orderBy("school_id", F.desc("year")),
    }
