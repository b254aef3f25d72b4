"""Merging duplicate schools through every table that refers to them.

Only rows of schools in the merge map are re-keyed and regrouped, everything
else passes by.  Colliding rows take the larger value of each figure.  Ratings
and external keys of a duplicate are lost, as their own old row still occupies
the unique place while they are copied; ``preserve_keys`` keeps them instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edurank.operators.duplicates import merge_map
from edurank.plans.change import ChangePlan
from edurank.plans.materialize import materialize
from edurank.sources.store import Tables, conform

FIGURES = {
    "ege_school_year": ["graduates_total"],
    "ege_school_subject_stat": [
        "participants_cnt",
        "not_passed_cnt",
        "high_80_99_cnt",
        "score_100_cnt",
        "avg_score",
        "chosen_cnt",
    ],
    "school_admission_stat": ["applicants_cnt", "enrolled_cnt", "enrolled_avg_score"],
    "school_admission_detail": ["applicants_cnt", "enrolled_cnt", "avg_score"],
    "analytics_school_metric_value": ["raw_value", "norm_value", "weighted_value"],
}


class _OnUse(Mapping):
    """New contents of tables, each worked out when it is first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers, self._made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = conform(self._makers[name](), name)
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def rekey(rows: DataFrame, ids: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Rows with ``column`` replaced where the map knows it.

    ``_touched`` marks every row that may meet another one: moved rows and rows
    of the kept ids; ``_moved`` the moved ones, ``_old`` keeps the original id.
    """
    moved = ids.selectExpr(f"{old} as {column}", f"{new} as _target", "true as _moved")
    kept = ids.selectExpr(f"{new} as {column}", f"{new} as _target", "false as _moved").distinct()
    joined = rows.join(moved.unionByName(kept), column, "left")
    return joined.selectExpr(
        f"coalesce(_target, {column}) as {column}",
        *(c for c in rows.columns if c != column),
        "_target is not null as _touched",
        "coalesce(_moved, false) as _moved",
        f"{column} as _old",
    )


def collapse(rekeyed: DataFrame, keys: Sequence[str], figures: Sequence[str], identity: str | None) -> DataFrame:
    """One row per key among touched rows: largest figures, other columns of the kept or first row.

    Touched rows and others are read apart, so rows that are costly to work out should be written first.
    """
    plain = [c for c in rekeyed.columns if not c.startswith("_")]
    others = [c for c in plain if c not in keys and c not in figures]
    rank = f"struct(_moved, _old, {identity or '0'} as _id)"
    carried = ", ".join(others) or "0 as _none"
    merged = (
        rekeyed.where("_touched")
        .groupBy(*keys)
        .agg(
            *(F.expr(f"max({c}) as {c}") for c in figures),
            F.expr(f"min_by(struct({carried}), {rank}) as _first"),
        )
    )
    merged = merged.selectExpr(*(f"_first.{c} as {c}" if c in others else c for c in plain))
    return rekeyed.where("not _touched").select(*plain).unionByName(merged)


def merged_years(tables: Tables, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """School years after the merge and the (old, new) map of their ids.

    A year only the duplicate had keeps its id.
    """
    rekeyed = materialize(rekey(tables["ege_school_year"], ids, "school_id", "old_school_id", "new_school_id"))
    keys = ["school_id", "year", "kind"]
    merged = collapse(rekeyed, keys, FIGURES["ege_school_year"], "ege_school_year_id")
    survivors = merged.selectExpr(*keys, "ege_school_year_id as new_id")
    id_map = (
        rekeyed.where("_moved")
        .selectExpr(*keys, "ege_school_year_id as old_id")
        .join(survivors, keys)
        .where("old_id <> new_id")
        .select("old_id", "new_id")
    )
    return merged, id_map


def merged_stats(tables: Tables, year_ids: DataFrame) -> DataFrame:
    """Subject statistics under the merged school years."""
    name = "ege_school_subject_stat"
    rekeyed = materialize(rekey(tables[name], year_ids, "ege_school_year_id", "old_id", "new_id"))
    return collapse(rekeyed, ["ege_school_year_id", "subject_id"], FIGURES[name], f"{name}_id")


def merged_admissions(tables: Tables, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Admission rows after the merge and the (old, new) map of their ids."""
    rekeyed = materialize(rekey(tables["school_admission_stat"], ids, "school_id", "old_school_id", "new_school_id"))
    keys = ["school_id", "year"]
    merged = collapse(rekeyed, keys, FIGURES["school_admission_stat"], "adm_stat_id")
    id_map = (
        rekeyed.where("_moved")
        .selectExpr(*keys, "adm_stat_id as old_id")
        .join(merged.selectExpr(*keys, "adm_stat_id as new_id"), keys)
        .where("old_id <> new_id")
        .select("old_id", "new_id")
    )
    return merged, id_map


def merge_duplicate_schools(
    tables: Tables,
    region: str | None = None,
    limit_groups: int = 0,
    preserve_keys: bool = False,
    ids: DataFrame | None = None,
) -> ChangePlan:
    """Plan that moves everything of a duplicate to the kept school and drops the duplicate."""
    ids = materialize(merge_map(tables, region, limit_groups) if ids is None else ids)

    def moved(table: str) -> DataFrame:
        return rekey(tables[table], ids, "school_id", "old_school_id", "new_school_id")

    def first_only(table: str, keys: list[str], identity: str | None = None) -> DataFrame:
        return collapse(moved(table), keys, [], identity)

    def kept_only(table: str) -> DataFrame:
        return tables[table].join(
            ids.selectExpr("old_school_id as school_id"), "school_id", "left_anti"
        )

    years, year_ids = merged_years(tables, ids)
    year_ids = materialize(year_ids)
    admissions, admission_ids = merged_admissions(tables, ids)
    admission_ids = materialize(admission_ids)

    def merged_details() -> DataFrame:
        details = rekey(tables["school_admission_detail"], admission_ids, "adm_stat_id", "old_id", "new_id")
        return collapse(details, ["adm_stat_id", "program_id"], FIGURES["school_admission_detail"], "detail_id")

    def merged_metrics() -> DataFrame:
        name = "analytics_school_metric_value"
        return collapse(moved(name), ["run_id", "school_id", "metric_code"], FIGURES[name], None)

    def merged_filters() -> DataFrame:
        filters = tables["analytics_request_filter"]
        filter_keys = [c for c in filters.columns if c != "filter_id"]
        school_filters = rekey(
            filters.where("school_id is not null"), ids, "school_id", "old_school_id", "new_school_id"
        )
        # grouping treats null columns of a filter row as equal, as its unique rule does
        return collapse(school_filters, filter_keys, [], "filter_id").unionByName(
            filters.where("school_id is null"), allowMissingColumns=True
        )

    changed = _OnUse(
        {
            "school": lambda: kept_only("school"),
            "school_profile_link": lambda: first_only("school_profile_link", ["school_id", "profile_id"]),
            "school_external_key": lambda: (
                first_only("school_external_key", ["school_id", "source_name"], "ext_key_id")
                if preserve_keys
                else kept_only("school_external_key")
            ),
            "ege_school_year": lambda: years,
            "ege_school_subject_stat": lambda: merged_stats(tables, year_ids),
            "school_admission_stat": lambda: admissions,
            "school_admission_detail": merged_details,
            "prof_event": lambda: moved("prof_event"),
            "analytics_run_school": lambda: first_only("analytics_run_school", ["run_id", "school_id"]),
            "analytics_school_card": lambda: first_only("analytics_school_card", ["run_id", "school_id"], "card_id"),
            "analytics_school_metric_value": merged_metrics,
            "analytics_school_rating": lambda: (
                first_only("analytics_school_rating", ["run_id", "school_id"])
                if preserve_keys
                else kept_only("analytics_school_rating")
            ),
            "analytics_school_selection": lambda: first_only("analytics_school_selection", ["request_id", "school_id"]),
            "analytics_school_report": lambda: moved("analytics_school_report"),
            "analytics_request_filter": merged_filters,
        }
    )
    reports = {"merge_map": ids, "year_map": year_ids, "admission_map": admission_ids}
    return ChangePlan(changed, reports, base=tables.version, touched=_touched(changed, ids, year_ids, admission_ids))


def _touched(names: Iterable[str], ids: DataFrame, years: DataFrame, admissions: DataFrame) -> dict[str, tuple[str, DataFrame]]:
    """Schools, school years and admission rows that were moved or moved to, per table."""

    def either(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array(*pairs.columns)).alias("id")).distinct()

    others = {"ege_school_subject_stat": ("ege_school_year_id", either(years)), "school_admission_detail": ("adm_stat_id", either(admissions))}
    schools = ("school_id", either(ids))
    return {name: others.get(name, schools) for name in names}


def remaining_duplicates(tables: Tables, plan: ChangePlan) -> DataFrame:
    """Merged schools that would still be present; empty after a complete merge."""
    old = plan.reports["merge_map"].selectExpr("old_school_id as school_id")
    return plan.tables["school"].join(old, "school_id", "left_semi")
