"""Subject analytics for all schools at once: multi-year picture and year comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edurank.functions.numeric import clamp, exact_ratio, round_even
from edurank.operators.card import card_subject_rows
from edurank.sources.store import Tables

# Bands of the status and of the year change.
GREEN_MARGIN = 5.0
FLAT_DELTA = 0.2

_IS_ACTUAL = "lower(trim(coalesce(kind, ''))) = 'actual'"
_PEOPLE = "greatest(coalesce(participants_cnt, chosen_cnt, 0), 0)"


def subject_year_stats(tables: Tables, wanted: DataFrame | None = None) -> DataFrame:
    """Totals and average per school, subject and actual year.

    The average is weighted by people; rows without people only count when there
    is no weighted row.
    """
    scored_people = f"case when avg_score is not null then {_PEOPLE} end"
    alone = f"avg_score is not null and {_PEOPLE} = 0"
    weighted = exact_ratio(f"sum(avg_score * {_PEOPLE})", f"sum({scored_people})", 12)
    plain = exact_ratio(f"sum(case when {alone} then avg_score end)", f"count_if({alone})", 12)
    return (
        card_subject_rows(tables, wanted)
        .where(f"{_IS_ACTUAL} and trim(coalesce(subject_name, '')) <> ''")
        .groupBy("school_id", "subject_id", F.expr("trim(subject_name) as subject_name"), "year")
        .agg(
            F.expr("max(min_passing_score) as min_passing_score"),
            F.expr(f"sum({_PEOPLE}) as participants"),
            *(
                F.expr(f"sum(greatest(coalesce({name}_cnt, 0), 0)) as {name}")
                for name in ("not_passed", "high_80_99", "score_100")
            ),
            F.expr(f"cast(coalesce({weighted}, {plain}) as double) as _mean"),
        )
        .selectExpr("* except (_mean)", f"{round_even('_mean', 2)} as year_avg")
    )


def _status(score: str, pass_mark: str) -> str:
    """green with a margin above the pass mark, yellow at it, red below, na when unknown."""
    return (
        f"case when {score} is null or {pass_mark} is null then 'na' "
        f"when {score} >= {pass_mark} + {GREEN_MARGIN}D then 'green' when {score} >= {pass_mark} then 'yellow' "
        "else 'red' end"
    )


def _ratio(value: str, invert: bool = False) -> str:
    """Place of a value between the school's smallest and largest one; 1 when they are equal."""
    low, high = (f"{f}({value}) over (partition by school_id)" for f in ("min", "max"))
    place = f"case when {high} > {low} then ({value} - {low}) / nullif({high} - {low}, 0D) else 1D end"
    return f"case when {value} is not null then {'1D - ' if invert else ''}{place} end"


def subject_heat(year_stats: DataFrame) -> DataFrame:
    """Means over years per school and subject with their relative position in the school.

    Means are exact decimal sums, so they do not depend on the order of the rows.
    """

    def percent(part: str) -> str:
        share = f"cast({part} as decimal(12,0)) * 100 / cast(nullif(participants, 0) as decimal(12,0))"
        return f"case when participants > 0 then cast({share} as decimal(20,14)) end"

    def mean(value: str) -> str:
        return f"cast(cast(sum({value}) as decimal(28,14)) / cast(nullif(count({value}), 0) as decimal(6,0)) as double)"

    means = {
        "participants_cnt": mean("case when participants > 0 then participants end"),
        "avg_score": mean("cast(year_avg as decimal(7,2))"),
        "not_passed_pct": mean(percent("not_passed")),
        "high_80_99_pct": mean(percent("high_80_99")),
        "score_100_pct": mean(percent("score_100")),
    }
    digits = {"participants_cnt": 1}
    base = ["school_id", "subject_id", "subject_name", *means, "min_passing_score"]
    return (
        year_stats.groupBy("school_id", "subject_id", "subject_name")
        .agg(
            F.expr("cast(max(min_passing_score) as double) as min_passing_score"),
            *(F.expr(f"{value} as {name}") for name, value in means.items()),
        )
        .selectExpr(*(f"{round_even(c, digits.get(c, 2))} as {c}" if c in means else c for c in base))
        .selectExpr("*", "avg_score - min_passing_score as _delta")
        .selectExpr(
            *base,
            f"{_status('avg_score', 'min_passing_score')} as threshold_status",
            f"{clamp('avg_score', '0D', '100D')} as avg_score_pos",
            f"{clamp('min_passing_score', '0D', '100D')} as min_score_pos",
            f"{round_even('_delta', 2)} as threshold_delta",
            # windows over the subjects of one school
            f"{_ratio('avg_score')} as avg_score_ratio",
            f"{_ratio('participants_cnt')} as participants_ratio",
            f"{_ratio('not_passed_pct', invert=True)} as not_passed_ratio",
            f"{_ratio('high_80_99_pct')} as high_80_99_ratio",
            f"{_ratio('score_100_pct')} as score_100_ratio",
        )
    )


def school_last_years(tables: Tables, wanted: DataFrame | None = None) -> DataFrame:
    """First, latest and second latest actual year per school, subjects or not."""
    years = tables["ege_school_year"].where(_IS_ACTUAL)
    if wanted is not None:
        years = years.join(wanted.select("school_id"), "school_id", "left_semi")
    # distinct years of a school: at most one per calendar year
    return (
        years.groupBy("school_id")
        .agg(F.expr("sort_array(collect_set(year), false) as _years"))
        .selectExpr(
            "school_id",
            "element_at(_years, -1) as first_year",
            "get(_years, 0) as latest_year",
            "get(_years, 1) as prev_year",
        )
    )


def subject_compare(year_stats: DataFrame, last_years: DataFrame) -> DataFrame:
    """Latest year against the school's previous year, per subject."""
    return (
        year_stats.select("school_id", "subject_id", "subject_name", "year", "year_avg")
        .join(last_years, "school_id")
        .where("year = latest_year or year = prev_year")
        .groupBy("school_id", "subject_id", "subject_name", "latest_year", "prev_year")
        .agg(
            F.expr("max(case when year = latest_year then year_avg end) as latest_score"),
            F.expr("max(case when year = prev_year then year_avg end) as prev_score"),
        )
        .where("latest_score is not null")
        .selectExpr("*", "latest_score - prev_score as _delta")
        .selectExpr("* except (_delta)", f"{round_even('_delta', 2)} as delta")
        .selectExpr("*", "max(abs(delta)) over (partition by school_id) as _peak")
        .selectExpr(
            "* except (_peak)",
            f"case when delta is null then 'na' when delta > {FLAT_DELTA}D then 'up' "
            f"when delta < -{FLAT_DELTA}D then 'down' else 'flat' end as delta_status",
            f"{clamp('latest_score', '0D', '100D')} as bar_width",
            "case when delta is not null then coalesce(abs(delta) / nullif(_peak, 0D), 0D) end as delta_ratio",
        )
    )


def subject_analytics(tables: Tables, wanted: DataFrame | None = None) -> dict[str, DataFrame]:
    """Heat table, comparison and covered years; for all schools or the wanted ones."""
    stats = subject_year_stats(tables, wanted)
    years = school_last_years(tables, wanted)
    return {
        "heat": subject_heat(stats).orderBy("school_id", "subject_name"),
        "compare": subject_compare(stats, years).orderBy("school_id", F.desc("latest_score"), "subject_name"),
        "years": years,
    }
