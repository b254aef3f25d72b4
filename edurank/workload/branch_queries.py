"""Queries that take the rarer ways: unknown and missing parts of sheets, seeded dictionaries, codes before names."""

from __future__ import annotations

from pyspark.sql import functions as F

from edurank.functions.text import SUBJECTS
from edurank.ingest import directory, exam, programs
from edurank.operators import regions, runs
from edurank.plans.materialize import materialize
from edurank.sources import seeds
from edurank.sources.cells import exam_columns
from edurank.workload.ingest_queries import _DIRECTORY_VIEWS, exam_cells, program_cells
from edurank.workload.registry import register
from edurank.workload.run_queries import _FILTERS, _rated_sql, logged
from edurank.workload.views import with_views

# --- program sheets --------------------------------------------------------------------------

_TITLES = list(programs.HEADINGS.values())


@register(
    "program_headings_missing",
    with_views(
        "select 'sheet ' || institute_id as sheet, h as heading from f_institute, unnest([" + ", ".join(f"'{t}'" for t in _TITLES) + "]) t(h) "
        "where h = ([" + ", ".join(f"'{t}'" for t in _TITLES) + "])[institute_id % 8]",
        "f_institute",
    ),
)
def _missing_headings(tables):
    """Every sheet lacks one heading, some none; spelling and spaces of the others differ."""
    titles = F.array(*map(F.lit, _TITLES))
    cells = tables["institute"].select(
        F.lit("programs.xlsx").alias("file"),
        F.concat(F.lit("sheet "), "institute_id").alias("sheet"),
        F.lit(0).alias("row_idx"),
        F.col("institute_id"),
        F.posexplode(titles).alias("col_idx", "title"),
    )
    kept = cells.where("col_idx + 1 <> institute_id % 8").select("file", "sheet", "row_idx", "col_idx", F.concat(F.lit("  "), F.upper("title")).alias("value"))
    return programs.missing_columns(kept).select("sheet", "heading")


@register(
    "program_unknown_subjects",
    with_views(
        "select name, is_new, count(*) filter (where role = 'required') as programs from "
        "(select case when program_id % 5 = 0 and subject_id = last then 'Черчение ' || (program_id % 3) else s.name end as name, "
        "program_id % 5 = 0 and subject_id = last as is_new, role from "
        "(select *, max(subject_id) filter (where role = 'required') over (partition by program_id) as last from f_requirement) "
        "join (values " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(SUBJECTS, 1)) + ") s(id, name) on s.id = subject_id) "
        "group by name, is_new",
        "f_requirement",
    ),
)
def _unknown_subjects(tables):
    """The last required subject of every fifth program is one the dictionary has not got."""
    cells = program_cells(tables)
    program = "(row_idx - 1) div 4"
    strange = f"row_idx > 0 and col_idx = 5 and {program} % 5 = 0"
    changed = cells.withColumn("value", F.expr(f"if({strange}, concat('Черчение ', {program} % 3), value)"))
    names = ("institute", "ege_subject", "study_program", "program_ege_requirement")
    empty = tables.with_tables({name: tables[name].limit(0) for name in names})
    loaded = programs.load_programs(empty, materialize(changed), create_missing=True).tables
    rows = loaded["program_ege_requirement"].join(loaded["ege_subject"], "subject_id")
    return rows.groupBy("name", F.expr(f"subject_id > {len(SUBJECTS)}").alias("is_new")).agg(F.expr("count_if(role = 'required') as programs"))


# --- dictionaries ----------------------------------------------------------------------------

_SEEDED = ", ".join(f"({i}, '{n}', {seeds.PASS_MARKS.get(n, seeds.DEFAULT_PASS_MARK)})" for i, n in enumerate(SUBJECTS, 1))


@register(
    "pass_marks_stored_or_seeded",
    with_views(
        "select id::bigint as subject_id, case when id % 5 <> 0 and id % 3 <> 0 then coalesce(f.name, s.name) else s.name end as name, "
        "cast(case when id % 5 <> 0 and id % 4 <> 0 then coalesce(f.min_passing_score + 7, mark) else mark end as bigint) as min_passing_score "
        f"from (values {_SEEDED}) s(id, name, mark) left join f_subject f on f.subject_id = id",
        "f_subject",
    ),
)
def _pass_marks(tables):
    stored = tables["ege_subject"].where("subject_id % 5 <> 0").selectExpr(
        "subject_id", "if(subject_id % 3 = 0, '', name) as name", "cast(if(subject_id % 4 = 0, null, min_passing_score + 7) as decimal(3,0)) as min_passing_score"
    )
    return seeds.pass_marks(tables.with_tables({"ege_subject": stored}))


@register(
    "dictionary_seeding",
    with_views(
        "select name, institute_id as known_id from (select case when institute_id <= 4 then n[institute_id] else name end as name, institute_id + 100 as institute_id "
        "from f_institute, (select [" + ", ".join(f"'{n}'" for n in seeds.INSTITUTES) + "] as n)) "
        "union all select n, null from unnest([" + ", ".join(f"'{n}'" for n in seeds.INSTITUTES) + "]) t(n) where n not in "
        "(select ([" + ", ".join(f"'{n}'" for n in seeds.INSTITUTES) + "])[institute_id] from f_institute where institute_id <= 4)",
        "f_institute",
    ),
)
def _seeding(tables):
    """A dictionary that holds some of the seeded names, and others, gets the rest under new keys."""
    names = F.array(*map(F.lit, seeds.INSTITUTES))
    own = tables["institute"].select(
        (F.col("institute_id") + 100).alias("institute_id"),
        F.when(F.col("institute_id") <= 4, F.get(names, F.col("institute_id").cast("int") - 1)).otherwise(F.col("name")).alias("name"),
    )
    grown = seeds.seeded(tables.with_tables({"institute": own}), "institute", seeds.institute_seed(tables.spark), "institute_id")
    known = own.select("institute_id", F.lit(True).alias("_known"))
    return grown.join(known, "institute_id", "left").selectExpr("name", "if(_known, institute_id, null) as known_id")


# --- directories and exam sheets -------------------------------------------------------------


@register(
    "directory_code_match",
    with_views(
        "select distinct municipality_id, case when school_id % 2 = 0 then full_name else '(' || (school_id % 20) || ') Гимназия' end as full_name, "
        "case when region_id = 0 or school_id % 2 = 0 then min(school_id) over (partition by municipality_id, school_id % 20) end as school_id "
        "from f_school join f_municipality using (municipality_id)",
        *_DIRECTORY_VIEWS,
    ),
)
def _code_match(tables):
    """Half of the names are others than the stored ones: in one region the code before them tells the school."""
    places = tables["municipality"].withColumnRenamed("name", "municipality").join(
        tables["region"].selectExpr("region_id", "if(region_id = 0, 'Приморский край', name) as region"), "region_id"
    )
    wanted = tables["school"].selectExpr(
        "municipality_id", "if(school_id % 2 = 0, full_name, concat('(', school_id % 20, ') Гимназия')) as full_name"
    ).distinct()
    found = directory.find_schools(places, wanted, tables["school"])
    return wanted.join(found, ["municipality_id", "full_name"], "left")


@register(
    "exam_rows_without_totals",
    with_views(
        "select 'directories_' || r.name || '_' || (yr + 5) || '.xlsx' as file, y.kind || ' ' || (yr + 5) as sheet, count(*) as rows_kept, "
        "sum(graduates_total)::bigint as graduates from f_year y join f_school using (school_id) join f_municipality m using (municipality_id) "
        "join f_region r on r.region_id = m.region_id where y.kind = 'actual' group by all",
        "f_region",
        "f_municipality",
        "f_school",
        "f_year",
    ),
)
def _without_totals(tables):
    """Rows of totals, and schools named by digits alone, stand between the others and are left out."""
    cells = materialize(exam_cells(tables).where("sheet like 'actual%'"))
    columns = materialize(exam_columns(cells, "actual"))
    names = "case when row_idx % 3 = 0 and col_idx = 0 then 'ВСЕГО по району' when row_idx % 3 = 1 and col_idx = 1 then 'Итого: всего' when row_idx % 3 = 2 and col_idx = 1 then ' 0123 ' else value end"
    body = "row_idx >= 10 and col_idx < 3"
    extra = cells.where(body).selectExpr("file", "sheet", "row_idx + 10000000 as row_idx", "col_idx", f"{names} as value")
    rows = exam.exam_rows(cells.unionByName(extra), columns, "actual")
    return rows.groupBy("file", "sheet").agg(F.expr("count(*) as rows_kept"), F.expr("sum(graduates_total) as graduates"))


# --- the run log -----------------------------------------------------------------------------

_SHOWN = (
    "(select count(*) from (select distinct s.school_id from f_school s join f_municipality m using (municipality_id) "
    "join f_profile_link l on l.school_id = s.school_id and l.profile_id in (2, 3) where m.region_id = 1 limit 20) p)"
)
_LOG_ROWS = {
    "analytics_request": "2",
    "analytics_request_filter": str(3 + len(_FILTERS.institute_ids)),
    "analytics_rating_run": "1",
    "analytics_run_metric": str(len(runs.METRIC_CODES)),
    "analytics_run_school": "count(*)",
    "analytics_school_selection": f"count(*) + {_SHOWN}",
    "analytics_school_rating": "count(*)",
    "analytics_school_metric_value": f"{len(runs.METRIC_CODES)} * count(*)",
    "analytics_school_card": "count(*)",
    "analytics_school_report": "0",
}


@register(
    "clear_run_log",
    _rated_sql(" union all ".join(f"select '{t}' as table_name, {n} as rows_before, 0::bigint as rows_after from rated group by ()" for t, n in _LOG_ROWS.items())),
)
def _clear(tables):
    log = logged(tables)
    counts = regions.clear_analytics(log).row_counts(log)
    values = ", ".join(f"('{name}', {before}L, {after}L)" for name, (before, after) in counts.items())
    return tables.spark.sql(f"select * from values {values} as t(table_name, rows_before, rows_after)")


@register(
    "orphan_requests_left",
    _rated_sql(f"select 1::bigint as request_id, 'search' as scenario, {_SHOWN} as lost_schools from rated group by ()"),
)
def _orphan_requests(tables):
    """A request whose schools and filters went, and that never was rated, is left without anything."""
    log = logged(tables)
    rated = log["analytics_rating_run"].select("request_id")
    lost = log["analytics_school_selection"].join(rated, "request_id", "left_anti")
    emptied = {name: log[name].join(rated, "request_id", "left_semi") for name in ("analytics_school_selection", "analytics_request_filter")}
    orphans = regions.orphan_requests(log.with_tables(emptied)).select("request_id", "scenario")
    return orphans.join(lost.groupBy("request_id").agg(F.expr("count(*) as lost_schools")), "request_id")
