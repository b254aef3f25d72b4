"""Loading queries: the test tables written as spreadsheet cells and loaded back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edurank.functions import text
from edurank.ingest import directory, exam, programs
from edurank.operators.schools import with_place
from edurank.plans.joins import join_few_keys
from edurank.plans.materialize import dealt, materialize
from edurank.plans.ordered import forward_fill
from edurank.sources import seeds
from edurank.sources.cells import SHEET, drop_empty, exam_columns, header_rows, subject_cells, wide_to_long
from edurank.workload.oracle_text import half_up
from edurank.workload.registry import register
from edurank.workload.views import with_views

# --- exam sheets -----------------------------------------------------------------------------
# One file per region and year, one sheet per kind; the row of a school is its id plus 10.
# Years are moved by five, as sheet names only tell years from 2000 on.

_METRIC_TITLES = {
    "participants_cnt": "приняли участие, чел.",
    "not_passed_cnt": "не преодолели порог",
    "high_80_99_cnt": "80-99 баллов",
    "score_100_cnt": "100 баллов",
    "avg_score": "Средний балл",
}
_FIRST_ROW = 10


def _stack(items: list[tuple[str, str, str]]) -> str:
    return "inline(array(" + ", ".join(f"struct({r} as row_idx, {c} as col_idx, {v} as value)" for r, c, v in items) + "))"


def _exam_header(kind: str) -> list[tuple[str, str, str]]:
    items = [
        ("0", "0", "'Сведения о результатах'"),
        ("1", "3", "'по школам'"),
        ("2", "0", "'Муниципальное образование'"),
        ("2", "1", "'Образовательная организация (школа)'"),
        ("2", "2", "'Всего выпускников, сдававших ЕГЭ'"),
    ]
    for i, subject in enumerate(text.SUBJECTS):
        if kind == "plan":
            items.append(("2", str(3 + i), f"'{subject}, чел.'"))
            continue
        # the subject stands over its first metric only, as in a merged cell
        items.append(("2", str(3 + 5 * i), f"'{subject}'"))
        items += [("3", str(3 + 5 * i + j), f"'{title}'") for j, title in enumerate(_METRIC_TITLES.values())]
    return items


def exam_cells(tables) -> DataFrame:
    """Cells of exam sheets for every school year."""
    school = tables["school"].selectExpr("school_id", "municipality_id", "full_name")
    municipality = tables["municipality"].selectExpr("municipality_id", "region_id", "name as municipality")
    region = tables["region"].selectExpr("region_id", "name as region")
    periods = (
        tables["ege_school_year"]
        .join(school, "school_id")
        .join(municipality, "municipality_id")
        .join(region, "region_id")
        .selectExpr(
            "ege_school_year_id",
            "concat('directories_', region, '_', year + 5, '.xlsx') as file",
            "concat(kind, ' ', year + 5) as sheet",
            "kind",
            f"cast(school_id + {_FIRST_ROW} as int) as row_idx",
            "municipality",
            "full_name",
            "graduates_total",
        )
    )
    names = periods.selectExpr(
        "file",
        "sheet",
        "row_idx",
        "inline(array(struct(0 as col_idx, municipality as value), struct(1 as col_idx, full_name as value), "
        "struct(2 as col_idx, concat(graduates_total, ',0') as value)))",
    )
    # One join for both kinds: a row becomes the cell of a plan, or the cells of its metrics.
    stats = tables["ege_school_subject_stat"].join(
        periods.select("ege_school_year_id", "file", "sheet", "kind", "row_idx"), "ege_school_year_id"
    )
    plan = "struct(cast(2 + subject_id as int) as col_idx, cast(chosen_cnt as string) as value)"
    metrics = ", ".join(
        f"struct(cast(3 + 5 * (subject_id - 1) + {j} as int) as col_idx, "
        + (f"replace(cast({m} as string), '.', ',')" if m == "avg_score" else f"cast({m} as string)")
        + " as value)"
        for j, m in enumerate(_METRIC_TITLES)
    )
    figures = stats.selectExpr("file", "sheet", "row_idx", f"inline(if(kind = 'plan', array({plan}), array({metrics})))")
    sheets = periods.select("file", "sheet", "kind").distinct()
    headers = None
    for kind in ("plan", "actual"):
        rows = sheets.where(F.col("kind") == kind).selectExpr("file", "sheet", _stack(_exam_header(kind)))
        headers = rows if headers is None else headers.unionByName(rows)
    return names.unionByName(figures).unionByName(headers)


_EXAM_VIEWS = ("f_region", "f_municipality", "f_school", "f_year", "f_stat")
_SHEETS = (
    "sheets",
    "select y.ege_school_year_id, y.school_id, y.yr, y.kind, y.graduates_total, "
    "'directories_' || r.name || '_' || (yr + 5) || '.xlsx' as file, y.kind || ' ' || (yr + 5) as sheet, "
    f"y.school_id + {_FIRST_ROW} as row_idx, min(s.school_id) over (partition by s.municipality_id, "
    "s.school_id % 20) as target from f_year y join f_school s using (school_id) "
    "join f_municipality m using (municipality_id) join f_region r on r.region_id = m.region_id",
)
_TARGETS = (
    "targets",
    "select school_id, min(school_id) over (partition by municipality_id, school_id % 20) as target from f_school",
)


def _exam_tables(tables):
    """Only the years are dropped: the sheets have to bring them back."""
    return tables.with_tables(
        {
            "ege_subject": seeds.subject_seed(tables.spark),
            "ege_school_year": tables["ege_school_year"].limit(0),
            "ege_school_subject_stat": tables["ege_school_subject_stat"].limit(0),
        }
    )


def _cells(tables) -> DataFrame:
    """The staged cells as they would lie in storage."""
    return tables.stored("exam_cells", lambda t: materialize(exam_cells(t)))


def _loaded_exams(tables):
    def load(t):
        cells = _cells(t)
        return exam.load_exam_stats(_exam_tables(t), cells, _settings(cells))

    return tables.stored("exam_load", load)


def _settings(cells: DataFrame) -> DataFrame:
    plan = exam.sheet_settings(cells.where("sheet like 'plan%'"), "план")
    return plan.unionByName(exam.sheet_settings(cells.where("sheet like 'actual%'"), "Фактические данные"))


@register(
    "exam_header_rows",
    with_views(
        "select distinct file, sheet, 2::bigint as header_row from sheets", *_EXAM_VIEWS, ctes=[_SHEETS]
    ),
)
def _headers(tables):
    return header_rows(_cells(tables))


_TITLE_VALUES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(text.SUBJECTS, 1))


@register(
    "exam_columns",
    with_views(
        "select distinct file, sheet, case kind when 'plan' then 4 else 5 end::bigint as first_row, "
        "0::bigint as mun_col, 1::bigint as school_col, 2::bigint as grads_col, title as subject, metric, "
        "case kind when 'plan' then 2 + s.i else 3 + 5 * (s.i - 1) + m.j end::bigint as col_idx "
        "from sheets join used u using (file, sheet) join subj s on s.i = u.subject_id "
        "join metrics m on (kind = 'plan') = (m.j = 5)",
        *_EXAM_VIEWS,
        ctes=[
            _SHEETS,
            ("subj", f"select * from (values {_TITLE_VALUES}) t(i, title)"),
            (
                "metrics",
                "select * from (values (0, 'participants_cnt'), (1, 'not_passed_cnt'), (2, 'high_80_99_cnt'), "
                "(3, 'score_100_cnt'), (4, 'avg_score'), (5, 'chosen_cnt')) t(j, metric)",
            ),
            ("used", "select distinct file, sheet, subject_id from sheets join f_stat using (ege_school_year_id)"),
        ],
    ),
)
def _columns(tables):
    cells = _cells(tables)
    plan = exam_columns(cells.where("sheet like 'plan%'"), "plan")
    return plan.unionByName(exam_columns(cells.where("sheet like 'actual%'"), "actual"))


@register(
    "exam_long_rows",
    with_views(
        "select file, sheet, row_idx, title as subject, "
        + ", ".join(
            f"{c} as {c}" for c in ("participants_cnt", "not_passed_cnt", "high_80_99_cnt", "score_100_cnt")
        )
        + ", cast(avg_h as double) / 100 as avg_score from sheets join f_stat t using (ege_school_year_id) "
        f"join (values {_TITLE_VALUES}) s(i, title) on s.i = t.subject_id where sheets.kind = 'actual'",
        *_EXAM_VIEWS,
        ctes=[_SHEETS],
    ),
)
def _long_rows(tables):
    cells = _cells(tables).where("sheet like 'actual%'")
    rows = exam.row_figures(subject_cells(cells, exam_columns(cells, "actual")))
    return rows.drop("chosen_cnt")


@register(
    "exam_wide_to_long",
    with_views(
        "select ege_school_year_id, title as subject, metric, value from (select ege_school_year_id, subject_id, "
        "unnest(['participants_cnt', 'chosen_cnt']) as metric, unnest([participants_cnt, chosen_cnt])::varchar as value "
        f"from f_stat) t join (values {_TITLE_VALUES}) s(i, title) on s.i = t.subject_id where value is not null",
        *_EXAM_VIEWS,
    ),
)
def _wide_long(tables):
    names = seeds.subject_seed(tables.spark).select("subject_id", "name")
    # A subject holds a fixed part of all rows: joined by its key, few tasks would take them.
    wide = (
        join_few_keys(tables["ege_school_subject_stat"], names, ["subject_id"], F.col("ege_school_year_id"))
        .groupBy("ege_school_year_id")
        .agg(
            *(
                F.expr(f"max(if(name = '{s}', {m}, null)) as `{m}__{s}`")
                for s in text.SUBJECTS
                for m in ("participants_cnt", "chosen_cnt")
            )
        )
    )
    return wide_to_long(wide, ["ege_school_year_id"])


@register(
    "exam_match_ladder",
    with_views(
        "select file, sheet, row_idx, target as school_id, 'matched' as status, graduates_total from sheets",
        *_EXAM_VIEWS,
        ctes=[_SHEETS],
    ),
)
def _match_ladder(tables):
    plan = _loaded_exams(tables)
    return plan.reports["rows"].select(*SHEET, "row_idx", "school_id", "status", "graduates_total")


@register(
    "exam_load_years",
    with_views(
        "select target as school_id, cast(yr + 5 as bigint) as year, kind, "
        "cast(sum(graduates_total) as bigint) as graduates_total from f_year join targets using (school_id) "
        "group by 1, 2, 3",
        *_EXAM_VIEWS,
        ctes=[_TARGETS],
    ),
)
def _load_years(tables):
    plan = _loaded_exams(tables)
    return plan.tables["ege_school_year"].drop("ege_school_year_id")


_WEIGHT = "case when participants_cnt > 0 then participants_cnt else 1 end"
_LOADED = (
    "loaded",
    "select target as school_id, cast(yr + 5 as bigint) as year, y.kind, subject_id, "
    "cast(sum(participants_cnt) as bigint) as p, cast(sum(not_passed_cnt) as bigint) as n, "
    "cast(sum(high_80_99_cnt) as bigint) as h, cast(sum(score_100_cnt) as bigint) as s, "
    f"{half_up(f'sum(avg_h * {_WEIGHT})', f'sum(case when avg_h is not null then {_WEIGHT} end)')} as a, "
    "cast(sum(case when y.kind = 'plan' then chosen_cnt else participants_cnt end) as bigint) as c "
    "from f_year y join targets using (school_id) join f_stat t using (ege_school_year_id) group by 1, 2, 3, 4",
)


@register(
    "exam_load_stats",
    with_views(
        "select school_id, year, kind, subject_id, coalesce(p, greatest(n, h, s)) as participants_cnt, "
        "least(n, p) as not_passed_cnt, least(h, p) as high_80_99_cnt, least(s, p) as score_100_cnt, "
        "case when a = 0 and p <= 0 then null else cast(a as double) / 100 end as avg_score, "
        "case when p is null then c else least(c, p) end as chosen_cnt from loaded",
        *_EXAM_VIEWS,
        ctes=[_TARGETS, _LOADED],
    ),
)
def _load_stats(tables):
    plan = _loaded_exams(tables)
    years = plan.tables["ege_school_year"].select("ege_school_year_id", "school_id", "year", "kind")
    stats = plan.tables["ege_school_subject_stat"].drop("ege_school_subject_stat_id")
    return stats.join(years, "ege_school_year_id").drop("ege_school_year_id")


def _raw_figures(tables) -> DataFrame:
    """Statistics with figures taken away or doubled, so that there is something to correct."""
    return tables["ege_school_subject_stat"].selectExpr(
        "ege_school_year_id",
        "subject_id",
        "if(subject_id % 3 = 0, null, participants_cnt) as participants_cnt",
        "not_passed_cnt * 2 as not_passed_cnt",
        "high_80_99_cnt",
        "score_100_cnt",
        "chosen_cnt + 1 as chosen_cnt",
        "if(subject_id % 2 = 0, 0.00, avg_score) as avg_score",
    )


_RAW = (
    "raw",
    "select ege_school_year_id, subject_id, case when subject_id % 3 = 0 then null else participants_cnt end as p, "
    "not_passed_cnt * 2 as n, high_80_99_cnt as h, score_100_cnt as s, chosen_cnt + 1 as c, "
    "case when subject_id % 2 = 0 then 0 else avg_h end as a from f_stat",
)
_BASED = ("based", "select *, coalesce(p, greatest(n, h, s)) as b from raw")


@register(
    "exam_sanitize",
    with_views(
        "select ege_school_year_id, subject_id, b as participants_cnt, "
        + ", ".join(
            f"case when {x} > b then b else {x} end as {name}"
            for x, name in (
                ("n", "not_passed_cnt"),
                ("h", "high_80_99_cnt"),
                ("s", "score_100_cnt"),
                ("c", "chosen_cnt"),
            )
        )
        + ", case when a = 0 and coalesce(b, 0) <= 0 and coalesce(n, 0) <= 0 and coalesce(h, 0) <= 0 "
        "and coalesce(s, 0) <= 0 and coalesce(c, 0) <= 0 then null else cast(a as double) / 100 end as avg_score, "
        "cast(p is null and b is not null as bigint) as restored, "
        "cast(coalesce(n > b, false) as bigint) + cast(coalesce(h > b, false) as bigint) "
        "+ cast(coalesce(s > b, false) as bigint) + cast(coalesce(c > b, false) as bigint) as clamped, "
        "cast(coalesce(a = 0 and coalesce(b, 0) <= 0 and coalesce(n, 0) <= 0 and coalesce(h, 0) <= 0 "
        "and coalesce(s, 0) <= 0 and coalesce(c, 0) <= 0, false) as bigint) as avg_nullified from based",
        "f_stat",
        ctes=[_RAW, _BASED],
    ),
)
def _sanitize(tables):
    return exam.sanitize(_raw_figures(tables), corrections=True)


@register(
    "exam_aggregate",
    with_views(
        "select school_id, subject_id, cast(sum(participants_cnt) as bigint) as participants_cnt, "
        "cast(sum(not_passed_cnt) as bigint) as not_passed_cnt, cast(sum(high_80_99_cnt) as bigint) as high_80_99_cnt, "
        "cast(sum(score_100_cnt) as bigint) as score_100_cnt, cast(sum(chosen_cnt) as bigint) as chosen_cnt, "
        f"cast({half_up(f'sum(avg_h * {_WEIGHT})', f'sum(case when avg_h is not null then {_WEIGHT} end)')} as double) "
        "/ 100 as avg_score from f_year join f_stat using (ege_school_year_id) group by 1, 2",
        "f_year",
        "f_stat",
    ),
)
def _aggregate(tables):
    figures = tables["ege_school_subject_stat"].join(
        tables["ege_school_year"].select("ege_school_year_id", "school_id"), "ege_school_year_id"
    )
    return exam.sum_figures(figures, ["school_id", "subject_id"])


# Spellings of a region's place in file names: whole, in other case, cut at both ends, with more around it, unknown.
_SPELLINGS = {
    "lower": "lower(r.name)",
    "around": "concat('directories_', upper(r.name), '_', yr)",
    "inner": "substr(r.name, 2, length(r.name) - 2)",
    "first": "substr(r.name, 1, 2)",
    "single": "substr(r.name, 1, 1)",
    "two": "concat(r.name, ' и ', (select min(name) from f_region))",
    "unknown": "concat('?', substr(r.name, 2, 3), '?')",
}
_SPELLED = " union ".join(
    f"select {sql} as region from f_year join f_school using (school_id) join f_municipality m using (municipality_id) "
    "join f_region r on r.region_id = m.region_id"
    for sql in _SPELLINGS.values()
)


@register(
    "region_resolution",
    with_views(
        "select region, coalesce((select min(name) from f_region where lower(name) = lower(region)), "
        "(select if(count(distinct name) = 1, min(name), null) from f_region "
        "where contains(lower(name), lower(region)) or contains(lower(region), lower(name)))) as region_name from spelled where region <> ''",
        "f_region",
        "f_municipality",
        "f_school",
        "f_year",
        ctes=[("spelled", _SPELLED)],
    ),
)
def _region_resolution(tables):
    years = with_place(tables).join(tables["ege_school_year"].selectExpr("school_id", "year as yr"), "school_id")
    first = tables["region"].select(F.min("name")).scalar()
    named = years.withColumn("_first", first).selectExpr("region_name", "yr", "_first").distinct()
    forms = [sql.replace("r.name", "region_name").replace("(select min(name) from f_region)", "_first") for sql in _SPELLINGS.values()]
    names = named.selectExpr(f"explode(array({', '.join(forms)})) as region").distinct()
    return exam.resolve_regions(tables, names)


@register(
    "ffill_blocks",
    "select event_id, user_id, last_value(case when event_type = 'purchase' then event_type || event_id end "
    "ignore nulls) over (partition by user_id order by event_id) as last_purchase from events",
)
def _ffill(tables):
    events = tables.view("f_event").selectExpr(
        "event_id",
        "school_id as user_id",
        "if(event_type = 'purchase', concat(event_type, event_id), null) as last_purchase",
    )
    return forward_fill(events, ["user_id"], "event_id", ["last_purchase"], block=64)


# --- directories -----------------------------------------------------------------------------

_DIRECTORY_HEADER = [
    ("0", "1", "'Перечень школ'"),
    ("1", "0", "'Муниципальное  образование'"),
    ("1", "1", "'Образовательная организация (школа)'"),
    ("1", "2", "'Профиль (при наличии)'"),
]


def directory_cells(tables) -> DataFrame:
    """One sheet per region listing every school with its profiles."""
    schools = tables["school"].join(tables["municipality"], "municipality_id").join(
        tables["region"].withColumnRenamed("name", "region"), "region_id"
    )
    listed = (
        tables["school_profile_link"]
        .join(tables["school_profile"], "profile_id")
        .groupBy("school_id")
        .agg(F.expr("listagg(name, '; ') within group (order by name) as profiles"))
    )
    rows = schools.join(listed, "school_id", "left").selectExpr(
        "concat('directories_', region, '.xlsx') as file",
        "'Лист1' as sheet",
        f"cast(school_id + {_FIRST_ROW} as int) as row_idx",
        "inline(array(struct(0 as col_idx, concat('  ', name) as value), struct(1 as col_idx, full_name as value), "
        "struct(2 as col_idx, concat(lower(profiles), ', x - отсутствует') as value)))",
    )
    sheets = rows.select("file", "sheet").distinct()
    return rows.unionByName(sheets.selectExpr("file", "sheet", _stack(_DIRECTORY_HEADER)))


_DIRECTORY_TABLES = ("region", "municipality", "school", "school_profile", "school_profile_link")
_DIRECTORY_VIEWS = ("f_region", "f_municipality", "f_school", "f_profile", "f_profile_link")
# both spellings of a name fold to one school: lower names are compared, "ого" equals "ий"
_LISTED = (
    "listed",
    "select s.school_id, m.name as municipality, r.name as region, s.school_id % 20 as k, "
    "case when s.school_id % 3 = 0 then 'ПРИМОРСКОГО' else 'ПРИМОРСКИЙ' end as ending from f_school s "
    "join f_municipality m using (municipality_id) join f_region r on r.region_id = m.region_id",
)


@register(
    "directory_load_schools",
    with_views(
        "select region, municipality, min(k || ' МБОУ СОШ № ' || k || ' ' || ending) as full_name, true as is_active "
        "from listed group by region, municipality, k",
        *_DIRECTORY_VIEWS,
        ctes=[_LISTED],
    ),
)
def _directory_schools(tables):
    plan = _loaded_directory(tables)
    places = plan.tables["municipality"].selectExpr("municipality_id", "region_id", "name as municipality").join(
        plan.tables["region"].selectExpr("region_id", "name as region"), "region_id"
    )
    schools = plan.tables["school"].join(places, "municipality_id")
    return schools.select("region", "municipality", "full_name", "is_active")


def _loaded_directory(tables):
    return tables.stored(
        "directory_load",
        lambda t: directory.load_school_directory(_empty_directory(t), materialize(directory_cells(t))),
    )


def _empty_directory(tables):
    return tables.with_tables({name: tables[name].limit(0) for name in _DIRECTORY_TABLES})


@register(
    "directory_load_profiles",
    with_views(
        "select distinct region, municipality, k::bigint as k, lower(p.name) as profile from listed "
        "join f_profile_link l using (school_id) join f_profile p using (profile_id)",
        *_DIRECTORY_VIEWS,
        ctes=[_LISTED],
    ),
)
def _directory_profiles(tables):
    plan = _loaded_directory(tables)
    loaded = plan.tables
    places = loaded["municipality"].selectExpr("municipality_id", "region_id", "name as municipality").join(
        loaded["region"].selectExpr("region_id", "name as region"), "region_id"
    )
    return (
        loaded["school_profile_link"]
        .join(loaded["school_profile"].withColumnRenamed("name", "profile"), "profile_id")
        .join(loaded["school"], "school_id")
        .join(places, "municipality_id")
        .selectExpr("region", "municipality", "cast(split(full_name, ' ')[0] as bigint) as k", "profile")
    )


@register(
    "directory_reload",
    with_views(
        "select count(*) as schools, 0::bigint as added from f_school", *_DIRECTORY_VIEWS
    ),
)
def _directory_reload(tables):
    """Loading the directory of known schools adds none (they match by folded name)."""
    known = tables.with_tables(
        {"school": materialize(dealt(tables["school"], "school_id").withColumn("full_name", text.standard_school_name(F.col("full_name"))))}
    )
    plan = directory.load_school_directory(known, materialize(directory_cells(tables)))
    before = known["school"].selectExpr("count(*) as schools").scalar()
    return plan.tables["school"].select(F.count(F.lit(1)).alias("_all")).select(
        before.alias("schools"), (F.col("_all") - before).alias("added")
    )


@register(
    "profile_tokens",
    "select c_custkey as school_id, place::bigint as place, token from (select c_custkey, unnest(tokens) as token, "
    "generate_subscripts(tokens, 1) as place from (select c_custkey, case c_custkey % 4 "
    "when 0 then ['физико-математический', lower(c_mktsegment)] when 1 then [lower(c_mktsegment), 'универсальный'] "
    "when 2 then [] else [lower(c_mktsegment) || '-класс'] end as tokens from customer) a) b",
)
def _profile_tokens(tables):
    own = tables.view("f_segment")
    raw = dealt(own, "school_id").selectExpr(
        "school_id",
        "case school_id % 4 when 0 then concat('Физико математический; ', segment, ', х - отсутствует') "
        "when 1 then concat('«', segment, '»;универсальный , ', upper(segment)) "
        "when 2 then ' не  имеется' else concat(segment, ' – класс.') end as cell",
    )
    return raw.select("school_id", F.posexplode(text.profile_tokens(F.col("cell"))).alias("place", "token")).withColumn(
        "place", F.col("place") + 1
    )


# --- programs --------------------------------------------------------------------------------


def program_cells(tables) -> DataFrame:
    """One sheet with a block of four rows per program: code row, two choices, the word between."""
    subject = seeds.subject_seed(tables.spark).selectExpr("subject_id", "upper(name) as subject")
    needed = (
        tables["program_ege_requirement"]
        .join(subject, "subject_id")
        .groupBy("program_id")
        .agg(
            F.expr("min_by(subject, subject_id) filter (where role = 'required') as r1"),
            F.expr("max_by(subject, subject_id) filter (where role = 'required') as r2"),
            F.expr("min_by(subject, subject_id) filter (where role = 'choice') as c1"),
            F.expr("max_by(subject, subject_id) filter (where role = 'choice') as c2"),
        )
    )
    base = tables["study_program"].join(needed, "program_id").withColumn(
        "institute", F.element_at(F.array(*map(F.lit, seeds.INSTITUTES)), F.col("institute_id").cast("int"))
    )
    first = "cast(1 + 4 * program_id as int)"
    rows = base.selectExpr(
        "'programs.xlsx' as file",
        "'1' as sheet",
        _stack(
            [
                (first, "0", "lower(institute)"),
                (first, "1", "concat(' ', code)"),
                (first, "2", "name"),
                (first, "3", "r1"),
                (first, "4", "c1"),
                (first, "5", "r2"),
                (f"{first} + 1", "4", "'или'"),
                (f"{first} + 2", "4", "lower(c2)"),
            ]
        ),
    ).where("value is not null")
    header = rows.select("file", "sheet").distinct().selectExpr(
        "file", "sheet", _stack([("0", str(i), f"'{title}'") for i, title in enumerate(programs.HEADINGS.values())])
    )
    return rows.unionByName(header)


_PROGRAM_VIEWS = ("f_program", "f_requirement")


def _loaded_programs(tables):
    return tables.stored("program_load", _load_programs)


def _load_programs(tables):
    empty = tables.with_tables(
        {
            name: tables[name].limit(0)
            for name in ("institute", "ege_subject", "study_program", "program_ege_requirement")
        }
    )
    return programs.load_programs(empty, materialize(program_cells(tables)))


@register(
    "program_load",
    with_views("select institute_id, code, name, true as is_active from f_program", *_PROGRAM_VIEWS),
)
def _program_load(tables):
    return _loaded_programs(tables).tables["study_program"].drop("program_id")


@register(
    "requirement_merge",
    with_views(
        "select code, subject_id, case when bool_or(role = 'required') then 'required' else 'choice' end as role, "
        "cast(case when bool_or(role = 'required') then 1 else max(weight) end as bigint) as weight "
        "from f_requirement join f_program using (program_id) group by 1, 2",
        *_PROGRAM_VIEWS,
    ),
)
def _requirement_merge(tables):
    loaded = _loaded_programs(tables).tables
    return (
        loaded["program_ege_requirement"]
        .join(loaded["study_program"].select("program_id", "code"), "program_id")
        .select("code", "subject_id", "role", "weight")
    )


@register(
    "min_scores_update",
    with_views(
        "select subject_id, name, cast(case when subject_id <= 5 then 50 + subject_id else min_passing_score end "
        "as double) as min_passing_score from f_subject union all "
        "select subject_id + 100, 'New ' || name, 60 from f_subject where subject_id > 9",
        "f_subject",
    ),
)
def _min_scores(tables):
    """Marks by id, by name under a foreign id, and of new subjects."""
    own = tables["ege_subject"]
    scores = (
        own.where("subject_id <= 3")
        .selectExpr("subject_id", "name", "cast(50 + subject_id as string) as score")
        .unionByName(
            own.where("subject_id in (4, 5)").selectExpr(
                "subject_id + 50 as subject_id", "name", "cast(50 + subject_id as string) as score"
            )
        )
        .unionByName(
            own.where("subject_id > 9").selectExpr(
                "subject_id + 100 as subject_id", "concat('New ', name) as name", "'60' as score"
            )
        )
    )
    return programs.update_min_scores(tables, scores).tables["ege_subject"]


@register(
    "wide_without_empty",
    with_views("select school_id, graduates_total from f_year where yr < 1998", "f_year"),
)
def _wide_without_empty(tables):
    early = "if(year < 1998, {0}, null) as {0}"
    wide = tables["ege_school_year"].selectExpr(early.format("school_id"), early.format("graduates_total"), "cast(null as string) as remark")
    return drop_empty(wide)


# Every fourth school keeps its row as it is; the others lose the spelling of the municipality, the municipality, or the name.
_STEPS = [
    (
        "known",
        "select s.school_id, m.region_id, case when m.region_id = 0 then 'Приморский край' else r.name end as region_name, "
        "count(*) over pair as n_pair, min(s.school_id) over pair as pair_id, "
        "count(*) over alone as n_alone, min(s.school_id) over alone as alone_id from f_school s "
        "join f_municipality m using (municipality_id) join f_region r on r.region_id = m.region_id "
        "window pair as (partition by municipality_id, s.school_id % 20), alone as (partition by m.region_id, s.school_id % 20)",
    ),
    (
        "steps",
        "select school_id as row_id, region_name, case school_id % 4 when 0 then pair_id "
        "when 1 then case when n_pair = 1 then pair_id when region_id = 0 or n_alone = 1 then alone_id end "
        "when 2 then case when region_id = 0 or n_alone = 1 then alone_id end end as school_id from known",
    ),
]


@register(
    "exam_match_steps",
    with_views(
        "select row_id, region_name, school_id, case when school_id is not null then 'matched' when row_id % 4 = 3 then 'not_found' "
        "else 'ambiguous' end as status from steps",
        "f_region",
        "f_municipality",
        "f_school",
        ctes=_STEPS,
    ),
)
def _match_steps(tables):
    named = tables["region"].withColumn("name", F.when(F.col("region_id") == 0, "Приморский край").otherwise(F.col("name")))
    changed = tables.with_tables({"region": named})
    rows = with_place(changed).selectExpr(
        "school_id as row_id",
        "region_name",
        "case school_id % 4 when 1 then lower(municipality_name) when 2 then 'Нигде' else municipality_name end as municipality",
        "if(school_id % 4 = 3, 'Лицей № 777', full_name) as school",
    )
    return exam.match_schools(changed, rows).select("row_id", "region_name", "school_id", "status")
