"""Queries over a planned change: its integrity and its dry run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edurank.operators import integrity
from edurank.workload.quality_queries import _BROKEN, _PLACES, _YEAR_CTES, _merged
from edurank.workload.registry import register
from edurank.workload.views import with_views

_VIEWS = (*_PLACES, "f_profile", "f_profile_link", "f_external_key", "f_subject", "f_institute", "f_year", "f_stat", "f_admission", "f_event")
_MOVED = "(select new_id from map)"
# The merged tables, each row marked if the merge touched it.
_AFTER = [
    ("m_school", f"select *, school_id in {_MOVED} as touched from f_school where school_id not in (select old_id from map)"),
    (
        "m_link",
        f"select distinct coalesce(new_id, school_id) as school_id, profile_id, coalesce(new_id, school_id) in {_MOVED} as touched "
        "from f_profile_link left join map on old_id = school_id",
    ),
    ("m_key", f"select *, school_id in {_MOVED} as touched from f_external_key where school_id not in (select old_id from map)"),
    ("m_year", f"select *, school_id in {_MOVED} as touched from years"),
    (
        "m_stat",
        "select new_id as ege_school_year_id, subject_id, first(s.ege_school_year_id order by new_id <> s.ege_school_year_id, s.ege_school_year_id) * 20 + subject_id as stat_id, "
        "max(participants_cnt) as participants_cnt, max(not_passed_cnt) as not_passed_cnt, max(high_80_99_cnt) as high_80_99_cnt, "
        "max(score_100_cnt) as score_100_cnt, max(avg_h) as avg_h, max(chosen_cnt) as chosen_cnt, "
        "new_id in (select new_id from year_map where old_id <> new_id) as touched "
        "from f_stat s join year_map m on m.old_id = s.ege_school_year_id group by new_id, subject_id",
    ),
    (
        "m_admission",
        "select first(adm_stat_id order by new_id is not null, school_id) as adm_stat_id, coalesce(new_id, school_id) as school_id, yr, "
        f"max(applicants_cnt) as applicants_cnt, max(enrolled_cnt) as enrolled_cnt, coalesce(new_id, school_id) in {_MOVED} as touched "
        "from f_admission left join map on old_id = school_id group by coalesce(new_id, school_id), yr",
    ),
    (
        "m_event",
        f"select * replace (coalesce(new_id, school_id) as school_id), coalesce(new_id, school_id) in {_MOVED} as touched "
        "from f_event left join map on old_id = school_id",
    ),
]
_SOURCES = {
    "school": "m_school", "school_profile_link": "m_link", "school_external_key": "m_key", "ege_school_year": "m_year",
    "ege_school_subject_stat": "m_stat", "school_admission_stat": "m_admission", "prof_event": "m_event",
}
_UNIQUE = {
    "school": [("primary_key", "school_id"), ("unique:municipality_id,full_name", "municipality_id, full_name")],
    "school_profile_link": [("primary_key", "school_id, profile_id")],
    "school_external_key": [("unique:school_id,source_name", "school_id, source_name"), ("unique:source_name,external_key", "source_name, external_key")],
    "ege_school_year": [("primary_key", "ege_school_year_id"), ("unique:school_id,year,kind", "school_id, yr, kind")],
    "ege_school_subject_stat": [("unique:ege_school_year_id,subject_id", "ege_school_year_id, subject_id")],
    "school_admission_stat": [("primary_key", "adm_stat_id"), ("unique:school_id,year", "school_id, yr")],
    "prof_event": [("primary_key", "event_id")],
}
_PARENTS = {
    "school": {"municipality_id": "f_municipality"},
    "school_profile_link": {"school_id": "m_school", "profile_id": "f_profile"},
    "school_external_key": {"school_id": "m_school"},
    "ege_school_year": {"school_id": "m_school"},
    "ege_school_subject_stat": {"ege_school_year_id": "m_year", "subject_id": "f_subject"},
    "school_admission_stat": {"school_id": "m_school"},
    "prof_event": {"school_id": "m_school", "institute_id": "f_institute"},
}


def _change_sql() -> str:
    parts = []
    for table, source in _SOURCES.items():
        for rule, columns in _UNIQUE[table]:
            key = " || '|' || ".join(f"{c}::varchar" for c in columns.split(", "))
            parts.append(f"select '{table}' as table_name, '{rule}' as rule, {key} as row_key, count(*) as row_count from {source} group by {columns} having count(*) > 1 and bool_or(touched)")
        for column, parent in _PARENTS[table].items():
            parts.append(
                f"select '{table}', 'fk:{column}', {column}::varchar, count(*) from {source} where {column} is not null "
                f"and {column} not in (select {column} from {parent}) group by {column} having bool_or(touched)"
            )
        for rule, _, key, broken in _BROKEN.get(table, []):
            own = "stat_id" if table == "ege_school_subject_stat" else key
            parts.append(f"select '{table}', 'check:{rule}', {own}::varchar, 1::bigint from {source} where touched and ({broken})")
    return " union all ".join(parts)


@register("integrity_of_merge", with_views(_change_sql(), *_VIEWS, ctes=[*_YEAR_CTES, *_AFTER]))
def _integrity_of_merge(tables):
    return integrity.check_change(tables, _merged(tables))


_COUNTED = {
    "school": "f_school", "school_profile_link": "f_profile_link", "school_external_key": "f_external_key", "ege_school_year": "f_year",
    "ege_school_subject_stat": "f_stat", "school_admission_stat": "f_admission", "prof_event": "f_event",
}


@register(
    "dry_run_counts",
    with_views(
        " union all ".join(
            f"select '{table}' as table_name, (select count(*) from {view}) as rows_before, (select count(*) from {_SOURCES[table]}) as rows_after"
            for table, view in _COUNTED.items()
        )
        + " union all select unnest(['school_admission_detail', 'analytics_run_school', 'analytics_school_card', 'analytics_school_metric_value', "
        "'analytics_school_rating', 'analytics_school_selection', 'analytics_school_report', 'analytics_request_filter']), 0, 0",
        *_VIEWS,
        ctes=[*_YEAR_CTES, *_AFTER],
    ),
)
def _dry_run(tables):
    counts = _merged(tables).row_counts(tables)
    rows = [
        tables.spark.range(1).select(F.lit(name).alias("table_name"), F.lit(before).cast("bigint").alias("rows_before"), F.lit(after).cast("bigint").alias("rows_after"))
        for name, (before, after) in counts.items()
    ]
    return reduce(DataFrame.unionByName, rows)
