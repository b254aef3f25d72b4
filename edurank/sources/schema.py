"""Tables of the data model, their types and their integrity rules.

Identity keys are ``bigint``; counts are ``int``.  Spark does not enforce the
rules below, :mod:`edurank.operators.integrity` reports what breaks them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Allowed words.
DATASET_KINDS = ("actual", "plan")
SCHOOL_SOURCES = ("EGE", "ONE_C", "BITRIX24")
SCENARIOS = ("selection", "search")
NORMALIZATIONS = ("minmax", "zscore", "rank")
RUN_STAGES = ("prelim", "final")
REPORT_TYPES = ("standard", "detailed", "comparison", "timeline")
REPORT_FORMATS = ("json", "pdf", "xlsx")
METRIC_CATEGORIES = ("ege", "admission", "prof_orientation", "school_info")
REQUIREMENT_ROLES = ("required", "choice")
FILTER_COLUMNS = {
    "region": "region_id",
    "municipality": "municipality_id",
    "institute": "institute_id",
    "school_profile": "profile_id",
    "program": "program_id",
    "subject": "subject_id",
    "school": "school_id",
}

SCHEMAS: dict[str, str] = {
    "region": "region_id bigint, name string",
    "municipality": "municipality_id bigint, region_id bigint, name string",
    "school": "school_id bigint, municipality_id bigint, full_name string, is_active boolean",
    "school_profile": "profile_id bigint, name string",
    "school_profile_link": "school_id bigint, profile_id bigint",
    "school_external_key": (
        "ext_key_id bigint, school_id bigint, source_name string, external_key string, normalized_name string"
    ),
    "ege_subject": "subject_id bigint, name string, min_passing_score decimal(3,0)",
    "institute": "institute_id bigint, name string",
    "study_program": "program_id bigint, institute_id bigint, code string, name string, is_active boolean",
    "program_ege_requirement": "req_id bigint, program_id bigint, subject_id bigint, role string, weight int",
    "ege_school_year": "ege_school_year_id bigint, school_id bigint, year int, kind string, graduates_total int",
    "ege_school_subject_stat": (
        "ege_school_subject_stat_id bigint, ege_school_year_id bigint, subject_id bigint, participants_cnt int, "
        "not_passed_cnt int, high_80_99_cnt int, score_100_cnt int, avg_score decimal(5,2), chosen_cnt int"
    ),
    "school_admission_stat": (
        "adm_stat_id bigint, school_id bigint, year int, applicants_cnt int, enrolled_cnt int, "
        "enrolled_avg_score decimal(5,2), external_key string"
    ),
    "school_admission_detail": (
        "detail_id bigint, adm_stat_id bigint, program_id bigint, applicants_cnt int, enrolled_cnt int, "
        "avg_score decimal(5,2)"
    ),
    "prof_event": (
        "event_id bigint, school_id bigint, institute_id bigint, event_date date, coverage_cnt int, "
        "event_type string, external_key string"
    ),
    "analytics_request": (
        "request_id bigint, created_at timestamp, created_by string, request_name string, scenario string, "
        "year_basis int, only_active boolean, min_students int, max_students int, notes string"
    ),
    "analytics_request_filter": (
        "filter_id bigint, request_id bigint, filter_type string, region_id bigint, municipality_id bigint, "
        "institute_id bigint, profile_id bigint, program_id bigint, subject_id bigint, school_id bigint, min_score int"
    ),
    "analytics_rating_run": (
        "run_id bigint, request_id bigint, calculated_at timestamp, calculated_by string, run_name string, "
        "stage string, algorithm_version string, normalization string, comment string"
    ),
    "analytics_metric": (
        "metric_code string, name_ru string, category string, unit string, description string, is_active boolean"
    ),
    "analytics_run_metric": "run_id bigint, metric_code string, weight int, is_primary boolean",
    "analytics_run_school": "run_id bigint, school_id bigint, selected_at timestamp",
    "analytics_school_selection": (
        "request_id bigint, school_id bigint, selected_at timestamp, match_score decimal(5,2)"
    ),
    "analytics_school_rating": (
        "run_id bigint, school_id bigint, rank_pos int, total_score decimal(12,6), year_basis int, "
        "students_cnt int, ege_avg_all decimal(5,2)"
    ),
    "analytics_school_metric_value": (
        "run_id bigint, school_id bigint, metric_code string, raw_value decimal(5,2), "
        "norm_value decimal(10,6), weighted_value decimal(10,6)"
    ),
    "analytics_school_card": (
        "card_id bigint, run_id bigint, school_id bigint, generated_at timestamp, "
        "school_info struct<school_id: bigint, full_name: string, region_name: string, municipality_name: string, "
        "profile_names: string>, "
        "ege_summary struct<avg_graduates: decimal(5,2), avg_score_all: decimal(5,2), "
        "avg_score_for_rating: decimal(5,2), avg_score_metric: decimal(5,2), ege_years: int, last_year: int>, "
        "admission_summary map<string, string>, prof_summary map<string, string>, "
        "conclusions struct<rating_score: decimal(10,6), programs_total: int, programs_matched: int, "
        "match_share: decimal(10,6), threshold_share: decimal(10,6), matched_programs: string>"
    ),
    "analytics_school_report": (
        "report_id bigint, run_id bigint, school_id bigint, report_type string, generated_at timestamp, "
        "report_format string, report_payload string"
    ),
}


def struct_type(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str


PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "region": ("region_id",),
    "municipality": ("municipality_id",),
    "school": ("school_id",),
    "school_profile": ("profile_id",),
    "school_profile_link": ("school_id", "profile_id"),
    "school_external_key": ("ext_key_id",),
    "ege_subject": ("subject_id",),
    "institute": ("institute_id",),
    "study_program": ("program_id",),
    "program_ege_requirement": ("req_id",),
    "ege_school_year": ("ege_school_year_id",),
    "ege_school_subject_stat": ("ege_school_subject_stat_id",),
    "school_admission_stat": ("adm_stat_id",),
    "school_admission_detail": ("detail_id",),
    "prof_event": ("event_id",),
    "analytics_request": ("request_id",),
    "analytics_request_filter": ("filter_id",),
    "analytics_rating_run": ("run_id",),
    "analytics_metric": ("metric_code",),
    "analytics_run_metric": ("run_id", "metric_code"),
    "analytics_run_school": ("run_id", "school_id"),
    "analytics_school_selection": ("request_id", "school_id"),
    "analytics_school_rating": ("run_id", "school_id"),
    "analytics_school_metric_value": ("run_id", "school_id", "metric_code"),
    "analytics_school_card": ("card_id",),
    "analytics_school_report": ("report_id",),
}

UNIQUE_KEYS: dict[str, tuple[tuple[str, ...], ...]] = {
    "region": (("name",),),
    "municipality": (("region_id", "name"),),
    "school": (("municipality_id", "full_name"),),
    "school_profile": (("name",),),
    "school_external_key": (("school_id", "source_name"), ("source_name", "external_key")),
    "ege_subject": (("name",),),
    "institute": (("name",),),
    "study_program": (("code",),),
    "program_ege_requirement": (("program_id", "subject_id"),),
    "ege_school_year": (("school_id", "year", "kind"),),
    "ege_school_subject_stat": (("ege_school_year_id", "subject_id"),),
    "school_admission_stat": (("school_id", "year"),),
    "school_admission_detail": (("adm_stat_id", "program_id"),),
    "analytics_school_rating": (("run_id", "rank_pos"),),
    "analytics_school_card": (("run_id", "school_id"),),
}

FOREIGN_KEYS: dict[str, tuple[ForeignKey, ...]] = {
    "municipality": (ForeignKey("region_id", "region", "region_id"),),
    "school": (ForeignKey("municipality_id", "municipality", "municipality_id"),),
    "school_profile_link": (
        ForeignKey("school_id", "school", "school_id"),
        ForeignKey("profile_id", "school_profile", "profile_id"),
    ),
    "school_external_key": (ForeignKey("school_id", "school", "school_id"),),
    "study_program": (ForeignKey("institute_id", "institute", "institute_id"),),
    "program_ege_requirement": (
        ForeignKey("program_id", "study_program", "program_id"),
        ForeignKey("subject_id", "ege_subject", "subject_id"),
    ),
    "ege_school_year": (ForeignKey("school_id", "school", "school_id"),),
    "ege_school_subject_stat": (
        ForeignKey("ege_school_year_id", "ege_school_year", "ege_school_year_id"),
        ForeignKey("subject_id", "ege_subject", "subject_id"),
    ),
    "school_admission_stat": (ForeignKey("school_id", "school", "school_id"),),
    "school_admission_detail": (
        ForeignKey("adm_stat_id", "school_admission_stat", "adm_stat_id"),
        ForeignKey("program_id", "study_program", "program_id"),
    ),
    "prof_event": (
        ForeignKey("school_id", "school", "school_id"),
        ForeignKey("institute_id", "institute", "institute_id"),
    ),
    "analytics_request_filter": (
        ForeignKey("request_id", "analytics_request", "request_id"),
        ForeignKey("region_id", "region", "region_id"),
        ForeignKey("municipality_id", "municipality", "municipality_id"),
        ForeignKey("institute_id", "institute", "institute_id"),
        ForeignKey("profile_id", "school_profile", "profile_id"),
        ForeignKey("program_id", "study_program", "program_id"),
        ForeignKey("subject_id", "ege_subject", "subject_id"),
        ForeignKey("school_id", "school", "school_id"),
    ),
    "analytics_rating_run": (ForeignKey("request_id", "analytics_request", "request_id"),),
    "analytics_run_metric": (
        ForeignKey("run_id", "analytics_rating_run", "run_id"),
        ForeignKey("metric_code", "analytics_metric", "metric_code"),
    ),
    "analytics_run_school": (
        ForeignKey("run_id", "analytics_rating_run", "run_id"),
        ForeignKey("school_id", "school", "school_id"),
    ),
    "analytics_school_selection": (
        ForeignKey("request_id", "analytics_request", "request_id"),
        ForeignKey("school_id", "school", "school_id"),
    ),
    "analytics_school_rating": (
        ForeignKey("run_id", "analytics_rating_run", "run_id"),
        ForeignKey("school_id", "school", "school_id"),
    ),
    "analytics_school_metric_value": (
        ForeignKey("run_id", "analytics_rating_run", "run_id"),
        ForeignKey("school_id", "school", "school_id"),
        ForeignKey("metric_code", "analytics_metric", "metric_code"),
    ),
    "analytics_school_card": (
        ForeignKey("run_id", "analytics_rating_run", "run_id"),
        ForeignKey("school_id", "school", "school_id"),
    ),
    "analytics_school_report": (
        ForeignKey("run_id", "analytics_rating_run", "run_id"),
        ForeignKey("school_id", "school", "school_id"),
    ),
}


def _words(column: str, allowed) -> str:
    return f"{column} in ({', '.join(repr(w) for w in allowed)})"


def _one_filter_column() -> str:
    """Exactly the column of the row's filter type is set; a minimum score only on subjects."""
    branches = []
    for kind, column in FILTER_COLUMNS.items():
        others = [c for c in FILTER_COLUMNS.values() if c != column]
        parts = [f"filter_type = '{kind}'", f"{column} is not null", *(f"{c} is null" for c in others)]
        if kind != "subject":
            parts.append("min_score is null")
        branches.append("(" + " and ".join(parts) + ")")
    return " or ".join(branches)


# rule name -> SQL condition; a row breaks the rule when the condition is FALSE
# (an unknown condition is accepted, as in SQL CHECK constraints).
CHECKS: dict[str, dict[str, str]] = {
    "analytics_metric": {"category": _words("category", METRIC_CATEGORIES)},
    "analytics_request": {
        "scenario": _words("scenario", SCENARIOS),
        "students": (
            "coalesce(min_students, 0) >= 0 and coalesce(max_students, 0) >= 0 "
            "and (min_students is null or max_students is null or min_students <= max_students)"
        ),
        "year_basis": "year_basis between 2000 and 2100",
    },
    "analytics_rating_run": {
        "normalization": _words("normalization", NORMALIZATIONS),
        "stage": _words("stage", RUN_STAGES),
    },
    "analytics_run_metric": {"weight": "weight between 1 and 10"},
    "ege_subject": {"min_score": "min_passing_score between 0 and 100"},
    "analytics_school_rating": {"rank_pos": "rank_pos >= 1"},
    "analytics_school_report": {
        "format": _words("report_format", REPORT_FORMATS),
        "type": _words("report_type", REPORT_TYPES),
    },
    "ege_school_year": {
        "year": "year between 2000 and 2100",
        "kind": _words("kind", DATASET_KINDS),
        "graduates": "graduates_total >= 0",
    },
    "ege_school_subject_stat": {
        "participants": "participants_cnt >= 0",
        "chosen": "chosen_cnt >= 0",
        "not_passed": "not_passed_cnt >= 0",
        "high_80_99": "high_80_99_cnt >= 0",
        "score_100": "score_100_cnt >= 0",
        "not_passed_le_participants": "not_passed_cnt <= participants_cnt",
        "high_80_99_le_participants": "high_80_99_cnt <= participants_cnt",
        "score_100_le_participants": "score_100_cnt <= participants_cnt",
        "avg_score": "avg_score between 0 and 100",
    },
    "prof_event": {"coverage": "coverage_cnt >= 0"},
    "school_external_key": {"source": _words("source_name", SCHOOL_SOURCES)},
    "school_admission_stat": {
        "year": "year between 2000 and 2100",
        "applicants": "applicants_cnt >= 0",
        "enrolled": "enrolled_cnt >= 0",
        "enrolled_le_applicants": "enrolled_cnt <= applicants_cnt",
        "enrolled_avg_score": "enrolled_avg_score between 0 and 100",
    },
    "school_admission_detail": {
        "applicants": "applicants_cnt >= 0",
        "enrolled": "enrolled_cnt >= 0",
        "enrolled_le_applicants": "enrolled_cnt <= applicants_cnt",
        "avg_score": "avg_score between 0 and 100",
    },
    "analytics_request_filter": {
        "type": _words("filter_type", FILTER_COLUMNS),
        "min_score": "min_score between 0 and 100",
        "payload": _one_filter_column(),
    },
    "program_ege_requirement": {
        "role": _words("role", REQUIREMENT_ROLES),
        "weight": "weight in (1, 2, 3)",
        "weight1_required": "weight <> 1 or role = 'required'",
    },
}

RUN_TABLES = (
    "analytics_school_report",
    "analytics_school_card",
    "analytics_school_metric_value",
    "analytics_school_rating",
    "analytics_run_school",
    "analytics_run_metric",
    "analytics_rating_run",
    "analytics_school_selection",
    "analytics_request_filter",
    "analytics_request",
)
