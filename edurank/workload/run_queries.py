"""Queries over the run log that a search and a rating of the test data produce."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from edurank.operators import merging, rating, regions, runs, search
from edurank.plans.materialize import materialize
from edurank.plans.params import Page, SchoolFilters
from edurank.sources.exports import cell_safe, flatten
from edurank.workload.analytics_queries import RATINGS
from edurank.workload.oracle_text import ids, round_even
from edurank.workload.quality_queries import DUPLICATE_CTES
from edurank.workload.rating_oracle import RATING_VIEWS, rating_ctes, rating_select
from edurank.workload.registry import register
from edurank.workload.views import with_views

NOW = datetime(2024, 5, 1, 12, 0, tzinfo=timezone.utc)
LOGGED = "rate_program_scope"
_FILTERS, _WEIGHTS = RATINGS[LOGGED]
_SEARCH = SchoolFilters(region_id=1, profile_ids=(2, 3))
_PAGE = Page(1, 20)


def logged(tables):
    """Tables after saving one search (request 1) and one rating (request 2, run 1)."""
    return tables.stored("run_log", _log)


def _log(tables):
    found = materialize(search.search_page(tables, _SEARCH, _PAGE))
    total = search.matching_schools(tables, _SEARCH).count()
    tables = runs.save_search(tables, _SEARCH, found, total, _PAGE, "analyst", NOW).plan.preview(tables)
    ranked = rating.rate_by_reference(tables, _FILTERS, _WEIGHTS)
    saved = runs.save_rating(tables, _FILTERS, _WEIGHTS, ranked, "analyst", NOW)
    # Cards hold the names of all their programs; they are put together from written parts when read.
    changed = saved.plan.changed(tables)
    log = tables.with_tables({name: df if name == "analytics_school_card" else materialize(df) for name, df in changed.items()})
    log.shared = {"analytics_school_card": saved.cards}  # the only cards there are
    return log


def _rated_sql(select: str, *more: str) -> str:
    """A statement over ``rated``, the rating that was saved, and ``more`` views."""
    head, rated = with_views(rating_select(_FILTERS), *RATING_VIEWS, *more, ctes=rating_ctes(_FILTERS, _WEIGHTS)).rsplit("\nselect ", 1)
    return f"{head}, rated as (select {rated}) {select}"


_SHARES = runs.metric_weights(_WEIGHTS)
_RAW_NORM = {
    "avg_graduates": ("avg_graduates", "norm_graduates"),
    "avg_score": ("avg_score_for_rating", "norm_avg_score"),
    "match_share": ("match_share", "match_share"),
    "threshold_share": ("threshold_share", "threshold_share"),
}


def _pivot_columns() -> str:
    parts = []
    for (name, (raw, norm)), share in zip(_RAW_NORM.items(), _SHARES.values(), strict=True):
        parts.append(f"{round_even(raw, 2)} as {name}_raw")
        parts.append(f"{round_even(norm, 6)} as {name}_norm")
        parts.append(f"{round_even(f'{norm} * {share!r}::double', 6)} as {name}_weighted")
    return ", ".join(parts)


@register("run_metric_pivot", _rated_sql(f"select 1::bigint as run_id, school_id, {_pivot_columns()} from rated"))
def _pivot(tables):
    return runs.run_metric_pivot(logged(tables)["analytics_school_metric_value"])


@register(
    "run_export_ranking",
    _rated_sql(
        "select rank_pos, school_id, full_name, region_name, municipality_name, rating_score as total_score, "
        "cast(round_even(avg_graduates, 0) as bigint) as students_cnt, avg_score_for_rating as ege_avg_all, "
        f"{_pivot_columns()}, matched_programs from rated"
    ),
)
def _run_export(tables):
    return runs.run_export(logged(tables), 1)["ranking"]


@register(
    "run_schools",
    _rated_sql(
        "select school_id, full_name, municipality_name, region_name, rank_pos, rating_score as total_score from rated"
    ),
)
def _run_schools(tables):
    return runs.run_schools(logged(tables), 1)


@register(
    "run_selection_scores",
    _rated_sql(f"select 2::bigint as request_id, school_id, {round_even('rating_score * 100e0', 2)} as match_score from rated"),
)
def _selection(tables):
    rows = logged(tables)["analytics_school_selection"].where("request_id = 2")
    return rows.select("request_id", "school_id", "match_score")


@register(
    "run_filters_weights",
    _rated_sql(
        "select 'filter' as part, name, institute_id::bigint as value, false as flag, "
        f"(select count(*) from f_program p where p.institute_id = i.institute_id) as rows_behind from f_institute i where institute_id in {ids(_FILTERS.institute_ids)} "
        "union all select 'weight', code, weight, weight = max(weight) over (), (select count(*) from rated) from "
        "(select code, greatest(1, least(10, cast(round_even(10 * w / (fsum(w) over ()), 0) as bigint))) as weight from (values "
        + ", ".join(f"('{code}', {w!r}::double)" for code, w in zip(runs.METRIC_CODES, (_WEIGHTS.graduates, _WEIGHTS.avg_score, _WEIGHTS.match_share, _WEIGHTS.threshold_share), strict=True))
        + ") t(code, w))",
        "f_institute",
    ),
)
def _filters_weights(tables):
    log = logged(tables)
    sheets = runs.run_export(log, 1)
    behind = tables["study_program"].groupBy("institute_id").agg(F.count("*").alias("rows_behind"))
    filters = (
        sheets["filters"].select("institute_id").join(tables["institute"].select("institute_id", "name"), "institute_id").join(behind, "institute_id")
    )
    values = log["analytics_school_metric_value"].groupBy("metric_code").agg(F.count("*").alias("rows_behind"))
    weights = sheets["weights"].join(values, "metric_code")
    return filters.selectExpr("'filter' as part", "name", "institute_id as value", "false as flag", "rows_behind").unionByName(
        weights.selectExpr("'weight' as part", "metric_code as name", "cast(weight as bigint) as value", "is_primary as flag", "rows_behind")
    )


@register(
    "calc_history",
    _rated_sql(
        "select 1::bigint as request_id, 'search' as scenario, "
        "(select count(*) from (select distinct s.school_id from f_school s join f_municipality m using (municipality_id) "
        "join f_profile_link l on l.school_id = s.school_id and l.profile_id in (2, 3) where m.region_id = 1 limit 20) p) "
        "as selected_cnt, 'region:1, school_profile:2' as filter_summary, null::bigint as run_id, 0::bigint as rated_cnt "
        f"union all select 2, 'selection', count(*), 'institute:{len(_FILTERS.institute_ids)}', 1, count(*) from rated"
    ),
)
def _history(tables):
    history = runs.calc_history(logged(tables))
    return history.select("request_id", "scenario", "selected_cnt", "filter_summary", "run_id", "rated_cnt")


@register(
    "rating_runs",
    _rated_sql(
        "select 1::bigint as run_id, 2::bigint as request_id, 'final' as stage, "
        "cast((select max(last_year) filter (where rank_pos = 1) from rated) as bigint) as year_basis, "
        "count(*) as rated_cnt, count(*) as reports_cnt from rated"
    ),
)
def _rating_runs(tables):
    tables = logged(tables)
    _, plan = runs.create_reports(tables, 1, "analyst", now=NOW)
    listed = runs.rating_runs(plan.preview(tables))
    return listed.select("run_id", "request_id", "stage", "year_basis", "rated_cnt", "reports_cnt")


# fields of the stored document: (path in the document, statement for the checking engine)
_DOCUMENT = {
    "run.run_id": "'1'",
    "run.request_name": f"'{runs.RATING_REQUEST_NAME}'",
    "run.algorithm_version": "'v1'",
    "school.full_name": "full_name",
    "school.region_name": "region_name",
    "school.municipality_name": "municipality_name",
    "card.school_info.profile_names": "profile_names",
    "card.conclusions.matched_programs": "matched_programs",
    "generated_by": "'analyst'",
}
_DOCUMENT_NUMBERS = {
    "run.year_basis": "max(last_year) filter (where rank_pos = 1) over ()",
    "rating.rank_pos": "rank_pos",
    "rating.total_score": "rating_score",
    "rating.students_cnt": "round_even(avg_graduates, 0)",
    "rating.ege_avg_all": "avg_score_for_rating",
    "card.ege_summary.avg_graduates": round_even("avg_graduates", 2),
    "card.ege_summary.avg_score_all": "avg_score_all",
    "card.ege_summary.avg_score_metric": "avg_score_for_rating",
    "card.ege_summary.ege_years": "ege_years",
    "card.ege_summary.last_year": "last_year",
    "card.conclusions.programs_total": "programs_total",
    "card.conclusions.programs_matched": "programs_matched",
    "card.conclusions.rating_score": round_even("rating_score", 6),
    "card.conclusions.threshold_share": round_even("threshold_share", 6),
}
for (_name, (_raw, _norm)), (_code, _share) in zip(_RAW_NORM.items(), _SHARES.items(), strict=True):
    _DOCUMENT_NUMBERS[f"metrics.{_code}.raw_value"] = round_even(_raw, 2)
    _DOCUMENT_NUMBERS[f"metrics.{_code}.norm_value"] = round_even(_norm, 6)
    _DOCUMENT_NUMBERS[f"metrics.{_code}.weighted_value"] = round_even(f"{_norm} * {_share!r}::double", 6)


@register(
    "report_payloads",
    _rated_sql(
        "select school_id, 'detailed' as report_type, 'json' as report_format, "
        + ", ".join(f'{sql} as "{path}"' for path, sql in _DOCUMENT.items())
        + ", "
        + ", ".join(f'cast({sql} as double) as "{path}"' for path, sql in _DOCUMENT_NUMBERS.items())
        + " from rated"
    ),
)
def _report_payloads(tables):
    fresh, _ = runs.create_reports(logged(tables), 1, "analyst", "detailed", "json", now=NOW)
    field = {path: F.get_json_object("report_payload", f"$.{path}") for path in (*_DOCUMENT, *_DOCUMENT_NUMBERS)}
    return fresh.select(
        "school_id",
        "report_type",
        "report_format",
        *(field[path].alias(path) for path in _DOCUMENT),
        *(field[path].cast("double").alias(path) for path in _DOCUMENT_NUMBERS),
    )


@register(
    "report_flattened",
    _rated_sql(
        "select school_id, rank_pos as \"rating.rank_pos\", full_name as \"school.full_name\", "
        "programs_matched as \"card.conclusions.programs_matched\", "
        f"{round_even('avg_graduates', 2)} as \"card.ege_summary.avg_graduates\", "
        "1::bigint as \"run.run_id\" from rated"
    ),
)
def _report_flattened(tables):
    documents = runs.report_payloads(logged(tables), 1, "analyst")
    flat = cell_safe(flatten(documents.select("school_id", "payload"), "payload"))
    wanted = [
        "rating.rank_pos",
        "school.full_name",
        "card.conclusions.programs_matched",
        "card.ege_summary.avg_graduates",
        "run.run_id",
    ]
    return flat.select("school_id", *(F.col(f"`{name}`") for name in wanted))


@register(
    "report_archive",
    _rated_sql(
        "select school_id, rank_pos, full_name, municipality_name, region_name, 'standard' as report_type, "
        "'xlsx' as report_format from rated"
    ),
)
def _archive(tables):
    tables = logged(tables)
    _, plan = runs.create_reports(tables, 1, "analyst", "standard", "xlsx", now=NOW)
    archive = runs.report_archive(plan.preview(tables))
    return archive.select(
        "school_id", "rank_pos", "full_name", "municipality_name", "region_name", "report_type", "report_format"
    )


@register(
    "orphan_runs",
    _rated_sql("select 1::bigint as run_id, count(*) as lost_ratings from rated"),
)
def _orphans(tables):
    tables = logged(tables)
    emptied = {
        name: tables[name].limit(0)
        for name in (
            "analytics_school_rating",
            "analytics_school_metric_value",
            "analytics_school_card",
            "analytics_school_report",
        )
    }
    lost = tables["analytics_school_rating"].groupBy("run_id").agg(F.expr("count(*) as lost_ratings"))
    orphans = regions.orphan_runs(tables.with_tables(emptied)).select("run_id")
    return orphans.join(lost, "run_id")


# --- the log after a deletion and a merge --------------------------------------------------------

_PER_SCHOOL = {
    "analytics_run_school": 1,
    "analytics_school_card": 1,
    "analytics_school_metric_value": len(runs.METRIC_CODES),
    "analytics_school_rating": 1,
    "analytics_school_selection": 1,
}


@register(
    "delete_region_runs",
    _rated_sql(
        " union all ".join(
            f"select '{table}' as table_name, {n} * count(*) as deleted from rated where region_id = 2"
            for table, n in _PER_SCHOOL.items()
        )
    ),
)
def _delete_region_runs(tables):
    log = logged(tables)
    name = tables["region"].where("region_id = 2").first()["name"]
    counts = regions.deleted_counts(log, regions.delete_region(log, name))
    return counts.where("table_name like 'analytics%' and deleted > 0")


@register(
    "merge_run_log",
    _rated_sql(
        "".join(f", {name} as ({sql})" for name, sql in DUPLICATE_CTES)
        + " select 'analytics_run_school' as table_name, school_id, count(*) as rows_left from "
        "(select distinct coalesce(new_id, school_id) as school_id from rated left join map on old_id = school_id) group by school_id "
        "union all select 'analytics_school_metric_value', school_id, 4 * count(*) from "
        "(select distinct coalesce(new_id, school_id) as school_id from rated left join map on old_id = school_id) group by school_id "
        "union all select 'analytics_school_rating', school_id, 1 from rated where school_id not in (select old_id from map)"
    ),
)
def _merge_run_log(tables):
    log = logged(tables)
    merged = merging.merge_duplicate_schools(log).preview(log)
    parts = [
        merged[table].where("run_id = 1").groupBy("school_id").agg(F.count("*").alias("rows_left")).withColumn("table_name", F.lit(table))
        for table in ("analytics_run_school", "analytics_school_metric_value", "analytics_school_rating")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("table_name", "school_id", "rows_left")
