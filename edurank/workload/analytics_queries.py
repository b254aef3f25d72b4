"""Rating, search, card and subject queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from edurank.operators import card, division, facts, options, rating, search, subjects
from edurank.plans.joins import join_few_keys
from edurank.plans.materialize import FOLDER, materialize, shared_folder
from edurank.plans.params import Page, RatingFilters, RatingWeights, SchoolFilters
from edurank.sources.colocated import colocate
from edurank.workload.oracle_text import half_up, ids, round_even, scaled
from edurank.workload.rating_oracle import (
    NAME_NORM,
    PLACED,
    PROFILE_NAMES,
    rating_part_sql,
    rating_select,
    rating_sql,
    school_condition,
)
from edurank.workload.registry import publish, register
from edurank.workload.views import with_views

RATINGS: dict[str, tuple[RatingFilters, RatingWeights]] = {
    "rate_default": (RatingFilters(enforce_subject_threshold=False), RatingWeights()),
    "rate_thresholds_all": (RatingFilters(), RatingWeights()),
    "rate_region_year_kind": (
        RatingFilters(region_id=2, year=1999, kind="actual", enforce_subject_threshold=False),
        RatingWeights(0.4, 0.3, 0.2, 0.3),
    ),
    "rate_name_profile": (
        RatingFilters(q="  МБОУ сош № 1", profile_ids=(1, 4), enforce_subject_threshold=False),
        RatingWeights(),
    ),
    "rate_subjects_enforced": (RatingFilters(subject_ids=(1, 2, 3)), RatingWeights()),
    "rate_subjects_relaxed": (
        RatingFilters(subject_ids=(1, 2), enforce_subject_threshold=False),
        RatingWeights(),
    ),
    "rate_program_scope": (RatingFilters(institute_ids=(1, 2, 3)), RatingWeights()),
    "rate_institute_and_subjects": (
        RatingFilters(institute_ids=(2, 5), subject_ids=(3, 4)),
        RatingWeights(),
    ),
    "rate_min_filters": (
        RatingFilters(program_ids=(1, 2, 3, 6, 13), min_graduates=20, min_avg_score=47.5, limit=500),
        RatingWeights(1, 1, 1, 0),
    ),
}



def laid_out(tables):
    """The domain tables with their facts bucketed by school, laid out once per session."""
    return tables.stored("colocated", _lay_out)


def _lay_out(tables):
    name = f"facts_{uuid.uuid4().hex}"
    return colocate(tables, name, location=f"{shared_folder(tables.spark)}/{FOLDER}/{name}")


for _name, (_filters, _weights) in RATINGS.items():

    @register(_name, rating_sql(_filters, _weights))
    def _rating(tables, filters=_filters, weights=_weights):
        return rating.rate_schools(laid_out(tables), filters, weights)


_SCOPE = RATINGS["rate_program_scope"][0]
_ALL = RatingFilters(enforce_subject_threshold=False)
_PART_NAMES = tuple(p.replace("score_part_", "") for p in rating.PARTS)


def _top_parts_sql() -> str:
    total = " + ".join(rating.PARTS)
    shares = ", ".join(
        f"case when score_total > 0 then score_part_{n} / score_total else 0 end as share_{n}" for n in _PART_NAMES
    )
    ranked = rating_sql(*RATINGS["rate_program_scope"])
    head, select = ranked.rsplit("\nselect ", 1)
    return (
        f"{head}, top as (select {select}), parts as (select rank_pos, full_name as name, "
        f"{', '.join(rating.PARTS)}, {round_even(total, 6)} as score_total from top where rank_pos <= 10) "
        f"select *, {shares}, score_total / max(score_total) over () as relative_to_top from parts"
    )


@register("rate_top_parts", _top_parts_sql())
def _top_parts(tables):
    return rating.rating_top_parts(rating.rate_schools(tables, *RATINGS["rate_program_scope"]))


def export_sql(columns: str = "*") -> str:
    head, select = rating_sql(*RATINGS["rate_program_scope"]).rsplit("\nselect ", 1)
    return (
        f"{head}, top as (select {select}), sheet as (select rank_pos, school_id, region_name, municipality_name, full_name, "
        "profile_names, cast(round_even(avg_graduates, 0) as bigint) as avg_graduates, avg_score_all, ege_years, "
        "last_year, programs_total, programs_matched, "
        "cast(round_even(potential_applicants_avg, 0) as bigint) as potential_applicants_avg, "
        f"{round_even('threshold_share * 100e0', 2)} as threshold_share_pct, rating_score, matched_programs from top) select {columns} from sheet"
    )


@register("rating_export", export_sql())
def _rating_export(tables):
    filters, weights = RATINGS["rate_program_scope"]
    return rating.rating_export(rating.rate_schools(tables, filters, weights), filters)


def _subjects(tables, filters=_ALL):
    return facts.school_subjects(facts.scoped_subject_rows(tables, filters))


@register(
    "school_subject_avg",
    rating_part_sql(
        f"select school_id, subject_id, {scaled('avg_h', 2)} as avg_score from school_subject where avg_h is not null", _ALL, "school_subject"
    ),
)
def _subject_avg(tables):
    return _subjects(tables).where(F.col("avg_score").isNotNull()).select("school_id", "subject_id", "avg_score")


@register(
    "school_subject_capacity",
    rating_part_sql(f"select school_id, subject_id, {scaled('size_h', 2)} as participants_avg from school_subject", _ALL, "school_subject"),
)
def _subject_capacity(tables):
    return _subjects(tables).select("school_id", "subject_id", "participants_avg")


@register(
    "subject_threshold_share",
    rating_part_sql(f"select school_id, {scaled('share_all', 4)} as threshold_share from shares", _ALL, "shares"),
)
def _threshold_share(tables):
    figures = rating.school_figures(tables, _subjects(tables), _ALL)
    return figures.where(F.col("averaged") > 0).select(
        "school_id", F.col("threshold_share_all").alias("threshold_share")
    )


def _scope_sets(tables):
    scope = rating.program_scope(tables, _SCOPE)
    return materialize(rating.school_sets(tables, _subjects(tables, _SCOPE), _SCOPE, scope.numbers)), scope


@register(
    "program_school_match",
    rating_part_sql(
        f"select school_id, program_id, {scaled('potential_h', 2)} as potential_applicants, "
        f"{scaled('share', 4)} as threshold_share from applicants where share > 0",
        _SCOPE,
        "applicants",
    ),
)
def _program_match(tables):
    return rating.program_matches(*_scope_sets(tables), publish)


@register(
    "program_school_summary",
    rating_part_sql(
        "select school_id, programs_total, programs_matched, "
        f"{scaled('potential_h', 2)} as potential_applicants_avg, {scaled('share', 4)} as threshold_share "
        "from chances where share > 0",
        _SCOPE,
        "chances",
    ),
)
def _program_summary(tables):
    summary = rating.program_summary(*_scope_sets(tables))
    return summary.withColumnRenamed("program_threshold_share", "threshold_share")


@register("matched_programs", rating_part_sql("select * from matched", _SCOPE, "matched"))
def _matched(tables):
    sets, scope = _scope_sets(tables)
    programs = scope.members.join(rating.selected_programs(tables, _SCOPE), "program_id")
    return rating.matched_program_names(rating.plan_matches(sets, scope), programs)


_EVERY = RatingFilters(institute_ids=tuple(range(1, 13)))


@register(
    "division_masks",
    rating_part_sql(
        "select school_id, program_id, needs_met as required_ok, options_met as choice_ok, "
        "len(needs) > 0 and list_has_all(suited, needs) and options_met = len(options) as complete "
        "from verdicts where needs_met + options_met > 0",
        _EVERY,
        "verdicts",
    ),
)
def _division_masks(tables):
    scope = rating.program_scope(tables, _EVERY)
    sets = materialize(rating.school_sets(tables, _subjects(tables, _EVERY), _EVERY, scope.numbers))
    judged = division.judged_plans(sets, scope.plans, scope.numbers).select("reached", "plan_id", "required_ok", "choice_ok", "complete")
    schools = division.dealt_schools(sets.select("school_id", "reached"), scope.plans)
    met = join_few_keys(schools, publish(judged), ["reached"], F.col("school_id"))
    programs = division.with_programs(met, scope.members)
    return programs.select("school_id", "program_id", "required_ok", "choice_ok", "complete")


# --- options -------------------------------------------------------------------------------


@register(
    "program_requirements",
    with_views(
        "select p.program_id, i.name as institute_name, p.code, p.name as program_name, role, "
        "cast(weight as bigint) as weight, subject_id, s.name as subject_name, "
        "cast(min_passing_score as double) as min_passing_score from f_program p "
        "join f_institute i using (institute_id) left join f_requirement q on q.program_id = p.program_id "
        "left join f_subject s using (subject_id) where p.is_active and p.institute_id in (1, 2, 3, 4)",
        "f_program",
        "f_institute",
        "f_requirement",
        "f_subject",
    ),
)
def _requirements(tables):
    return options.requirement_rows(tables, institute_ids=(1, 2, 3, 4))


@register(
    "programs_nested",
    with_views(
        "select p.program_id, i.name as institute_name, p.code, p.name, "
        "coalesce(string_agg(s.name || '/' || weight, ',' order by s.name) filter (where role = 'required'), '') "
        "as required_subjects, "
        "coalesce(string_agg(s.name || '/' || weight, ',' order by s.name) filter (where role = 'choice'), '') "
        "as choice_subjects from f_program p join f_institute i using (institute_id) "
        "left join f_requirement q on q.program_id = p.program_id left join f_subject s using (subject_id) "
        "where p.is_active and p.institute_id in (1, 2, 3, 4) group by 1, 2, 3, 4",
        "f_program",
        "f_institute",
        "f_requirement",
        "f_subject",
    ),
)
def _programs_nested(tables):
    def joined(name):
        return F.array_join(
            F.transform(name, lambda s: F.concat_ws("/", s["name"], s["weight"].cast("string"))), ","
        ).alias(name)

    nested = options.program_requirements(tables, institute_ids=(1, 2, 3, 4))
    return nested.select(
        "program_id", "institute_name", "code", "name", joined("required_subjects"), joined("choice_subjects")
    )


@register(
    "filter_years_kinds",
    with_views("select distinct cast(yr as bigint) as year, kind from f_year", "f_year"),
)
def _years_kinds(tables):
    lists = options.filter_options(tables)
    known = tables["ege_school_year"].select("year", "kind").distinct()
    return known.join(lists["years"], "year", "left_semi").join(lists["kinds"], "kind", "left_semi").select("year", "kind")


@register(
    "filter_lists",
    with_views(
        "select 'region' as list, region_id as id, name from f_region union all "
        "select 'municipality', municipality_id, name from f_municipality where region_id = 2 union all "
        "select 'profile', profile_id, name from f_profile union all "
        "select 'subject', subject_id, name from f_subject union all "
        "select 'institute', institute_id, name from f_institute union all "
        "select 'program', program_id, name from f_program where is_active and institute_id in (3, 7)",
        "f_region",
        "f_municipality",
        "f_profile",
        "f_subject",
        "f_institute",
        "f_program",
    ),
)
def _filter_lists(tables):
    lists = options.rating_filter_options(tables, region_id=2, institute_ids=(3, 7))
    result = None
    for name in ("regions", "municipalities", "profiles", "subjects", "institutes", "programs"):
        label = {"municipalities": "municipality"}.get(name, name[:-1])
        rows = lists[name].select(F.lit(label).alias("list"), F.col(f"{label}_id").alias("id"), "name")
        result = rows if result is None else result.unionByName(rows)
    return result


# --- search --------------------------------------------------------------------------------

_SEARCH_VIEWS = ("f_region", "f_municipality", "f_school", "f_profile", "f_profile_link", "f_year", "f_stat")


def _search_sql(f: SchoolFilters, page: Page | None = None, select: str | None = None) -> str:
    period = ["true"] + ([f"yr = {f.year}"] if f.year is not None else []) + ([f"kind = '{f.kind}'"] if f.kind else [])
    condition = school_condition(f)
    if f.subject_ids:
        condition += (
            " and s.school_id in (select y.school_id from f_year y join f_stat t using (ege_school_year_id) "
            f"where {' and '.join(period)} and t.subject_id in {ids(f.subject_ids)} group by y.school_id, "
            f"ege_school_year_id having count(distinct t.subject_id) = {len(f.subject_ids)})"
        )
    elif len(period) > 1:
        condition += f" and s.school_id in (select school_id from f_year where {' and '.join(period)})"
    ctes = [
        ("base", PLACED.format(condition=condition.replace("t.kind", "y.kind"))),
        ("names", PROFILE_NAMES),
        (
            "ys",
            f"select school_id, max(yr) as last_year, count(distinct yr) as ege_years, "
            f"{half_up('sum(graduates_total)', 'count(*)', 1)} as g from f_year group by 1",
        ),
        (
            "sc",
            f"select school_id, {half_up('sum(avg_h)', 'count(*)')} as h from f_year "
            "join f_stat using (ege_school_year_id) where avg_h is not null "
            "and coalesce(participants_cnt, chosen_cnt, 0) > 0 group by 1",
        ),
    ]
    columns = (
        "select school_id, full_name, cast(null as varchar) as short_name, is_active, region_id, region_name, "
        "municipality_id, municipality_name, coalesce(profile_names, '') as profile_names, "
        f"cast(last_year as bigint) as last_year, ege_years, coalesce({scaled('g', 1)}, 0) as avg_graduates, "
        f"{scaled('h', 2)} as avg_score from base left join names using (school_id) "
        "left join ys using (school_id) left join sc using (school_id)"
    )
    if page is not None:
        columns += f" order by full_name, school_id limit {page.limit} offset {page.offset}"
    return with_views(select or columns, *_SEARCH_VIEWS, ctes=ctes)


SEARCHES: dict[str, SchoolFilters] = {
    "search_name": SchoolFilters(q="№ 1%приморск"),
    "search_all_subjects": SchoolFilters(subject_ids=(1, 2, 5), year=1999, kind="actual"),
    "search_place_period": SchoolFilters(region_id=1, municipality_id=6, kind="plan"),
    "search_everything": SchoolFilters(),
}

for _name, _search_filters in SEARCHES.items():

    @register(_name, _search_sql(_search_filters).replace("kind = 'actual' and t.", "y.kind = 'actual' and t."))
    def _search(tables, filters=_search_filters):
        return search.search_all(tables, filters)


_PAGED = SchoolFilters(profile_ids=(2, 3), subject_ids=(1, 2))


@register("search_profiles_paged", _search_sql(_PAGED, Page(3, 25)))
def _search_paged(tables):
    return search.search_page(tables, _PAGED, Page(3, 25))


@register("search_total", _search_sql(_PAGED, select="select count(*) as total from base"))
def _search_total(tables):
    return search.matching_schools(tables, _PAGED).agg(F.count(F.lit(1)).alias("total"))


def _search_export_sql() -> str:
    head, select = _search_sql(SEARCHES["search_place_period"]).rsplit("\nselect ", 1)
    return (
        f"{head}, found as (select {select}) select school_id, region_name as region, municipality_name as municipality, "
        "full_name as school, short_name, profile_names as profiles, is_active, last_year as ege_last_year, ege_years, "
        "avg_graduates as ege_avg_graduates, avg_score as ege_avg_score from found"
    )


@register("search_export", _search_export_sql())
def _search_export(tables):
    return search.search_export(tables, SEARCHES["search_place_period"])


# --- cards ---------------------------------------------------------------------------------


@register(
    "school_card_header",
    with_views(
        "select school_id, full_name, is_active, municipality_id, municipality_name, region_id, region_name, "
        "coalesce(profile_names, '') as profiles from base left join names using (school_id)",
        "f_region",
        "f_municipality",
        "f_school",
        "f_profile",
        "f_profile_link",
        ctes=[("base", PLACED.format(condition="true")), ("names", PROFILE_NAMES)],
    ),
)
def _card_header(tables):
    return (
        card.card_header(tables)
        .withColumn("profiles", F.array_join("profiles", ", "))
        .drop("short_name", "address", "website")
    )


_SHOWN = (
    "case when avg_h = 0 and coalesce(participants_cnt, 0) <= 0 and coalesce(not_passed_cnt, 0) <= 0 "
    "and coalesce(high_80_99_cnt, 0) <= 0 and coalesce(score_100_cnt, 0) <= 0 and coalesce(chosen_cnt, 0) <= 0 "
    "then null else avg_h end"
)

# Nested documents are compared as one text per list, numbers in whole units.
_COUNTS = ("participants_cnt", "not_passed_cnt", "high_80_99_cnt", "score_100_cnt")
_SUBJECT_TEXT = "concat_ws(':', s.name, subject_id, " + ", ".join(
    f"coalesce(cast({c} as varchar), '-')" for c in ("cast(min_passing_score as int)", *_COUNTS, _SHOWN, "chosen_cnt")
) + ")"
_TIMELINE_CTES = [
    (
        "period_text",
        "select school_id, yr, y.kind, concat_ws('/', yr, y.kind, coalesce(cast(graduates_total as varchar), '-'), "
        f"coalesce(string_agg({_SUBJECT_TEXT}, ',' order by s.name, subject_id) filter (where subject_id is not null), '')) as line "
        "from f_year y left join f_stat t using (ege_school_year_id) left join f_subject s using (subject_id) "
        "group by school_id, yr, y.kind, graduates_total",
    ),
    ("timeline", "select school_id, string_agg(line, ';' order by yr desc, kind desc) as ege_timeline from period_text group by school_id"),
]


def _item_text(*values: str):
    return F.concat_ws(":", *(F.coalesce(F.expr(f"cast({v} as string)"), F.lit("-")) for v in values))


def _timeline_text(column: str = "ege_timeline"):
    hundredths = "cast(round(x.avg_score * 100) as bigint)"
    values = ["x.subject_name", "x.subject_id", "cast(x.min_passing_score as int)", *(f"x.{c}" for c in _COUNTS), hundredths, "x.chosen_cnt"]
    subject = "concat_ws(':', " + ", ".join(f"coalesce(cast({v} as string), '-')" for v in values) + ")"
    period = (
        "concat_ws('/', p.year, p.kind, coalesce(cast(p.graduates_total as string), '-'), "
        f"array_join(transform(p.subjects, x -> {subject}), ','))"
    )
    return F.expr(f"array_join(transform({column}, p -> {period}), ';')")


@register(
    "school_timeline",
    with_views("select * from timeline", "f_year", "f_stat", "f_subject", ctes=_TIMELINE_CTES),
)
def _timeline(tables):
    return card.school_timeline(tables).withColumn("ege_timeline", _timeline_text())


def _list_sql(source: str, order: str, *values: str) -> str:
    item = "concat_ws(':', " + ", ".join(f"coalesce(cast({v} as varchar), '-')" for v in values) + ")"
    return f"select school_id, string_agg({item}, ';' order by {order}) as items from {source} group by school_id"


def _list_text(column: str, *fields: str):
    item = "concat_ws(':', " + ", ".join(f"coalesce(cast(x.{f} as string), '-')" for f in fields) + ")"
    return F.expr(f"array_join(transform({column}, x -> {item}), ';')").alias(column)


@register(
    "school_cards",
    with_views(
        "select school_id, full_name, coalesce(ege_timeline, '') as ege_timeline, coalesce(a.items, '') as admission_stats, "
        "coalesce(e.items, '') as prof_events, coalesce(k.items, '') as external_keys "
        "from f_school left join timeline using (school_id) left join ("
        + _list_sql("f_admission", "yr desc", "yr", "applicants_cnt", "enrolled_cnt")
        + ") a using (school_id) left join ("
        + _list_sql(
            "(select school_id, year(event_date) as yr, count(*) as n, sum(coverage_cnt) as c from f_event group by all)",
            "yr desc",
            "yr",
            "n",
            "c",
        )
        + ") e using (school_id) left join ("
        + _list_sql("f_external_key", "source_name, external_key", "source_name", "external_key", "normalized_name")
        + ") k using (school_id)",
        "f_school",
        "f_year",
        "f_stat",
        "f_subject",
        "f_admission",
        "f_event",
        "f_external_key",
        ctes=_TIMELINE_CTES,
    ),
)
def _cards(tables):
    return card.school_cards(tables).select(
        "school_id",
        "full_name",
        _timeline_text().alias("ege_timeline"),
        _list_text("admission_stats", "year", "applicants_cnt", "enrolled_cnt"),
        _list_text("prof_events", "year", "events_cnt", "coverage_cnt"),
        _list_text("external_keys", "source_name", "external_key", "normalized_name"),
    )


CARD_SHEETS_SQL = (
    "select 'profiles' as sheet, school_id, name as item, null::bigint as number from f_profile_link join f_profile using (profile_id) "
    "union all select 'external_keys', school_id, source_name || ':' || external_key, null from f_external_key "
    "union all select 'admission', school_id, cast(yr as varchar), applicants_cnt from f_admission "
    "union all select 'prof_events', school_id, cast(year(event_date) as varchar), count(*) from f_event "
    "semi join f_school using (school_id) group by school_id, year(event_date) "
    "union all select 'ege_subjects', school_id, concat_ws(':', yr, y.kind, s.name), t.chosen_cnt from f_year y "
    "left join f_stat t using (ege_school_year_id) left join f_subject s using (subject_id) "
    "union all select 'ege_periods', school_id, concat_ws(':', yr, y.kind), graduates_total from f_year y "
    "union all select 'school', s.school_id, m.name || ':' || full_name, m.region_id from f_school s join f_municipality m using (municipality_id)"
)
CARD_VIEWS = (
    "f_school",
    "f_municipality",
    "f_profile",
    "f_profile_link",
    "f_external_key",
    "f_admission",
    "f_event",
    "f_year",
    "f_stat",
    "f_subject",
)


def card_items(sheets):
    """One row per row of every sheet of a card."""
    items = {
        "profiles": ("profile_name", "cast(null as bigint)"),
        "external_keys": ("concat(source_name, ':', external_key)", "cast(null as bigint)"),
        "admission": ("cast(year as string)", "applicants_cnt"),
        "prof_events": ("cast(year as string)", "events_cnt"),
        "ege_subjects": ("concat_ws(':', year, kind, subject_name)", "chosen_cnt"),
        "ege_periods": ("concat_ws(':', year, kind)", "graduates_total"),
        "school": ("concat(municipality_name, ':', school_name)", "region_id"),
    }
    parts = [
        sheets[name].selectExpr(f"'{name}' as sheet", "school_id", f"{item} as item", f"cast({number} as bigint) as number")
        for name, (item, number) in items.items()
    ]
    return reduce(lambda x, y: x.unionByName(y), parts)


@register("card_export_sheets", with_views(CARD_SHEETS_SQL, *CARD_VIEWS))
def _card_export(tables):
    return card_items(card.school_card_export(tables))



@register(
    "card_periods",
    with_views(
        "select school_id, cast(yr as bigint) as year, y.kind, graduates_total, count(subject_id) as subjects_cnt, "
        "cast(coalesce(sum(participants_cnt), 0) as bigint) as participants_total, "
        "cast(coalesce(sum(not_passed_cnt), 0) as bigint) as not_passed_total, "
        "cast(coalesce(sum(high_80_99_cnt), 0) as bigint) as high_80_99_total, "
        "cast(coalesce(sum(score_100_cnt), 0) as bigint) as score_100_total, "
        "cast(coalesce(sum(chosen_cnt), 0) as bigint) as chosen_total, "
        + round_even(f"sum({_SHOWN})::double / (100 * count({_SHOWN}))", 2)
        + " as avg_score_mean from f_year y left join f_stat t using (ege_school_year_id) "
        "group by school_id, yr, y.kind, graduates_total",
        "f_year",
        "f_stat",
    ),
)
def _card_periods(tables):
    return card.card_periods(tables)


@register(
    "card_subject_rows",
    with_views(
        "select school_id, cast(yr as bigint) as year, y.kind, graduates_total, subject_id, s.name as subject_name, "
        "cast(min_passing_score as double) as min_passing_score, participants_cnt, not_passed_cnt, high_80_99_cnt, "
        f"score_100_cnt, {scaled(_SHOWN, 2)} as avg_score, chosen_cnt from f_year y "
        "left join f_stat t using (ege_school_year_id) left join f_subject s using (subject_id)",
        "f_year",
        "f_stat",
        "f_subject",
    ),
)
def _card_subject_rows(tables):
    return card.card_subject_rows(tables)


@register(
    "prof_events_by_year",
    with_views(
        "select school_id, cast(year(event_date) as bigint) as year, count(*) as events_cnt, "
        "cast(sum(coverage_cnt) as bigint) as coverage_cnt from f_event group by 1, 2",
        "f_event",
    ),
)
def _prof_events(tables):
    return card.prof_events_by_year(tables)


# --- subject analytics -----------------------------------------------------------------------

_YEAR_STATS = (
    "select school_id, subject_id, s.name as subject_name, yr, min_passing_score, participants_cnt as participants, "
    f"not_passed_cnt as not_passed, high_80_99_cnt as high_80_99, score_100_cnt as score_100, {_SHOWN} as h "
    "from f_year y join f_stat t using (ege_school_year_id) join f_subject s using (subject_id) where y.kind = 'actual'"
)
_SUBJECT_VIEWS = ("f_year", "f_stat", "f_subject")


@register(
    "subject_year_stats",
    with_views(
        "select school_id, subject_id, subject_name, cast(yr as bigint) as year, "
        "cast(min_passing_score as double) as min_passing_score, participants, not_passed, high_80_99, score_100, "
        f"{scaled('h', 2)} as year_avg from ys",
        *_SUBJECT_VIEWS,
        ctes=[("ys", _YEAR_STATS)],
    ),
)
def _year_stats(tables):
    return subjects.subject_year_stats(tables)


def _heat_sql() -> str:
    def pct(part):
        return round_even(f"avg({part} * 100e0 / participants) filter (where participants > 0)", 2)

    def ratio(x):
        return (
            f"case when {x} is null then null when max({x}) over w > min({x}) over w "
            f"then ({x} - min({x}) over w) / (max({x}) over w - min({x}) over w) else 1e0 end"
        )

    means = (
        "select school_id, subject_id, subject_name, cast(max(min_passing_score) as double) as min_passing_score, "
        + round_even("sum(participants)::double / count(*)", 1)
        + " as participants_cnt, "
        + round_even("sum(h)::double / (100 * count(h))", 2)
        + f" as avg_score, {pct('not_passed')} as not_passed_pct, {pct('high_80_99')} as high_80_99_pct, "
        f"{pct('score_100')} as score_100_pct from ys group by 1, 2, 3"
    )
    return with_views(
        "select *, case when avg_score is null then 'na' when avg_score >= min_passing_score + 5 then 'green' "
        "when avg_score >= min_passing_score then 'yellow' else 'red' end as threshold_status, "
        "avg_score as avg_score_pos, min_passing_score as min_score_pos, "
        f"{round_even('avg_score - min_passing_score', 2)} as threshold_delta, "
        f"{ratio('avg_score')} as avg_score_ratio, {ratio('participants_cnt')} as participants_ratio, "
        f"1e0 - ({ratio('not_passed_pct')}) as not_passed_ratio, {ratio('high_80_99_pct')} as high_80_99_ratio, "
        f"{ratio('score_100_pct')} as score_100_ratio from means window w as (partition by school_id)",
        *_SUBJECT_VIEWS,
        ctes=[("ys", _YEAR_STATS), ("means", means)],
    )


@register("subject_heat", _heat_sql())
def _heat(tables):
    return subjects.subject_heat(subjects.subject_year_stats(tables))


def _compare_sql() -> str:
    years = (
        "select school_id, max(yr) filter (where place = 1) as latest, max(yr) filter (where place = 2) as prev from "
        "(select school_id, yr, row_number() over (partition by school_id order by yr desc) as place from "
        "(select distinct school_id, yr from f_year where kind = 'actual') d) p group by 1"
    )
    return with_views(
        "select school_id, subject_id, subject_name, cast(latest as bigint) as latest_year, "
        "cast(prev as bigint) as prev_year, latest_score, prev_score, delta, "
        "case when delta is null then 'na' when delta > 0.2e0 then 'up' when delta < -0.2e0 then 'down' "
        "else 'flat' end as delta_status, latest_score as bar_width, "
        "case when delta is not null then case when max(abs(delta)) over w > 0 "
        "then abs(delta) / max(abs(delta)) over w else 0 end end as delta_ratio "
        "from deltas window w as (partition by school_id)",
        *_SUBJECT_VIEWS,
        ctes=[
            ("ys", _YEAR_STATS),
            ("lasts", years),
            (
                "pairs",
                "select a.school_id, a.subject_id, a.subject_name, l.latest, l.prev, "
                f"{scaled('a.h', 2)} as latest_score, {scaled('b.h', 2)} as prev_score from ys a "
                "join lasts l on l.school_id = a.school_id and l.latest = a.yr left join ys b "
                "on b.school_id = a.school_id and b.subject_id = a.subject_id and b.yr = l.prev where a.h is not null",
            ),
            ("deltas", f"select *, {round_even('latest_score - prev_score', 2)} as delta from pairs"),
        ],
    )


@register("subject_compare", _compare_sql())
def _compare(tables):
    return subjects.subject_compare(subjects.subject_year_stats(tables), subjects.school_last_years(tables))


__all__ = ["NAME_NORM", "RATINGS", "rating_select"]
