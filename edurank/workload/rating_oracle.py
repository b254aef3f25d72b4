"""The rating stated by its rules for the checking engine.

A school is described by lists of subjects (present, averaged, passed), a program
by the list of subjects it needs and its lists of alternatives; the rules are
predicates on these lists.  Every qualified school meets every program, so this
also proves that working from hits alone loses nothing.  Weights and flags are
worked out here from the raw request.
"""

from __future__ import annotations

from edurank.plans.params import RatingFilters, RatingWeights
from edurank.workload.oracle_text import half_up, ids, round_even, scaled
from edurank.workload.views import with_views

RATING_VIEWS = (
    "f_region",
    "f_municipality",
    "f_school",
    "f_profile",
    "f_profile_link",
    "f_subject",
    "f_program",
    "f_requirement",
    "f_year",
    "f_stat",
)

NAME_NORM = "lower(replace(replace(regexp_replace(coalesce(full_name, ''), '\\s+', ' ', 'g'), 'Ё', 'Е'), 'ё', 'е'))"


def school_condition(f) -> str:
    parts = []
    sought = " ".join(f.q.split()).lower().replace("ё", "е")
    if sought:
        parts.append(f"{NAME_NORM} like '%{sought}%'")
    if f.region_id is not None:
        parts.append(f"r.region_id = {f.region_id}")
    if f.municipality_id is not None:
        parts.append(f"m.municipality_id = {f.municipality_id}")
    if f.profile_ids:
        parts.append(f"s.school_id in (select school_id from f_profile_link where profile_id in {ids(f.profile_ids)})")
    return " and ".join(parts) or "true"


PLACED = (
    "select s.school_id, s.full_name, s.is_active, m.municipality_id, m.name as municipality_name, r.region_id, "
    "r.name as region_name from f_school s join f_municipality m on m.municipality_id = s.municipality_id "
    "join f_region r on r.region_id = m.region_id where {condition}"
)

PROFILE_NAMES = (
    "select school_id, string_agg(name, ', ' order by name) as profile_names from f_profile_link "
    "join f_profile using (profile_id) group by school_id"
)


def _listed(values) -> str:
    return "[" + ", ".join(f"{v}::bigint" for v in values) + "]"


def _program_ctes(f: RatingFilters) -> list[tuple[str, str]]:
    """Offered programs and what each asks for: ``needs`` and ``options``, lists of subjects."""
    by_program = bool(f.institute_ids or f.program_ids)
    asked = []
    if by_program:
        rules = ["is_active", *([f"institute_id in {ids(f.institute_ids)}"] if f.institute_ids else [])]
        rules += [f"program_id in {ids(f.program_ids)}"] if f.program_ids else []
        offered = f"select program_id, code, name from f_program where {' and '.join(rules)}"
        asked.append("select program_id, subject_id, role, weight from f_requirement semi join offered using (program_id)")
    else:
        offered = f"select 0 as program_id, null as code, 'selected_subjects' as name where {'true' if f.subject_ids else 'false'}"
    if f.subject_ids:
        everywhere = (
            f"select program_id, subject_id from offered, (select subject_id from f_subject where subject_id in {ids(f.subject_ids)})"
        )
        if by_program:
            everywhere += " except select program_id, subject_id from f_requirement where role = 'required'"
        asked.append(f"select program_id, subject_id, 'required' as role, null as weight from ({everywhere})")
    return [
        ("offered", offered),
        ("asked", " union all ".join(asked) or "select 0 as program_id, 0 as subject_id, '' as role, 0 as weight where false"),
        (
            "alternatives",
            "select program_id, list(subjects) as options from (select program_id, list(subject_id) as subjects from asked "
            "where role = 'choice' and weight is not null group by program_id, weight) group by program_id",
        ),
        (
            "wishes",
            "select program_id, coalesce(list(subject_id) filter (where role = 'required'), []) as needs, "
            "coalesce(any_value(options), []) as options from asked left join alternatives using (program_id) group by program_id",
        ),
    ]


def rating_ctes(f: RatingFilters, weights: RatingWeights) -> list[tuple[str, str]]:
    scope = bool(f.subject_ids or f.institute_ids or f.program_ids)
    least_h = None if f.min_avg_score is None else int(round(f.min_avg_score * 100))
    high = "avg_h is not null" if least_h is None else f"coalesce(avg_h >= {least_h}, false)"
    reached = f"({high} and avg_h >= 100 * coalesce(min_passing_score, 0))"
    if f.enforce_subject_threshold:
        fits = reached
    else:
        fits = "true" if least_h is None else high
    wanted = _listed(f.subject_ids)
    rules = []
    if f.subject_ids:
        rules.append(f"list_has_all({'passed' if f.enforce_subject_threshold else 'present'}, {wanted})")
        rules.append(f"list_has_all(present, {wanted})")
    elif f.enforce_subject_threshold and not scope:
        rules.append("len(averaged) > 0 and len(passed) = len(averaged)")
    when = [f"yr = {f.year}"] if f.year is not None else []
    when += [f"kind = '{f.kind}'"] if f.kind else []
    rated_h = "admission_h" if scope else "all_h"
    stays = ["coalesce(potential_h, 0) > 0"] if scope else []
    if f.min_graduates is not None:
        stays.append(f"coalesce(graduates_t, 0) >= {10 * f.min_graduates}")
    if least_h is not None:
        stays.append(f"coalesce({rated_h}, 0) >= {least_h}")
    counted = f"subject_id in {ids(f.subject_ids)}" if f.subject_ids else "subject_id in (select subject_id from asked)"
    raw = [weights.graduates, weights.avg_score, weights.match_share if scope else 0.0, weights.threshold_share]
    positive = ", ".join(f"greatest({float(w)!r}::double, 0e0) as w{i}" for i, w in enumerate(raw))

    def of_top(value: str) -> str:
        own = f"cast(coalesce(remaining.{value}, 0) as double)"
        return f"case when peak.{value} > 0 then {own} / peak.{value} else 0e0 end"

    return [
        ("places", PLACED.format(condition=school_condition(f))),
        ("kept_years", f"select * from f_year semi join places using (school_id) where {' and '.join(when) or 'true'}"),
        (
            "answers",
            "select school_id, subject_id, avg_h, coalesce(participants_cnt, chosen_cnt) as people from kept_years "
            "join f_stat using (ege_school_year_id) where coalesce(participants_cnt, chosen_cnt) > 0",
        ),
        (
            "school_subject",
            f"select school_id, subject_id, {half_up('sum(avg_h)', 'count(avg_h)')} as avg_h, "
            f"{half_up('sum(people)', 'count(*)', 2)} as size_h from answers group by school_id, subject_id",
        ),
        (
            "profile_of_school",
            "select school_id, list(subject_id) as present, "
            "coalesce(list(subject_id) filter (where avg_h is not null), []) as averaged, "
            f"coalesce(list(subject_id) filter (where {reached}), []) as passed, "
            f"coalesce(list(subject_id) filter (where {fits}), []) as suited, map(list(subject_id), list(size_h)) as sizes "
            "from school_subject left join f_subject using (subject_id) group by school_id",
        ),
        (
            "shares",
            f"select school_id, {half_up('len(passed)', 'len(averaged)', 4)} as share_all from profile_of_school where len(averaged) > 0",
        ),
        (
            "qualified",
            "select places.*, suited, sizes from places left join profile_of_school using (school_id) "
            f"where {' and '.join(rules) or 'true'}",
        ),
        *_program_ctes(f),
        (
            "verdicts",
            "select school_id, program_id, needs, options, sizes, suited, "
            "len(list_intersect(needs, suited)) as needs_met, "
            "len(list_filter(options, lambda o: list_has_any(o, suited))) as options_met "
            "from (select * replace (coalesce(suited, []) as suited) from qualified), wishes",
        ),
        (
            "applicants",
            f"select school_id, program_id, coalesce({half_up('needs_met + options_met', 'len(needs) + len(options)', 4)}, 0) as share, "
            "case when len(needs) > 0 and needs_met = len(needs) and options_met = len(options) then list_min(list_concat("
            "list_transform(needs, lambda s: map_extract_value(sizes, s)), list_transform(options, lambda o: "
            "list_max(list_transform(list_intersect(o, suited), lambda s: map_extract_value(sizes, s)))))) else 0 end as potential_h "
            "from verdicts",
        ),
        (
            "chances",
            "select school_id, count(*) as programs_total, count_if(potential_h > 0) as programs_matched, "
            f"{half_up('sum(potential_h)', 'count(*)')} as potential_h, "
            "case when max(potential_h) > 0 then max(share) filter (where potential_h > 0) else max(share) end as share "
            "from applicants group by school_id",
        ),
        (
            "matched",
            "select school_id, string_agg(concat_ws(' ', nullif(code, ''), name), '; ' order by name, program_id) as matched_programs "
            f"from applicants join offered using (program_id) where potential_h > 0 and {'true' if f.institute_ids or f.program_ids else 'false'} "
            "group by school_id",
        ),
        (
            "figures",
            "select * from qualified join (select school_id, "
            f"{half_up('sum(graduates_total)', 'count(graduates_total)', 1)} as graduates_t, "
            "max(yr) as last_year, count(distinct yr) as ege_years from kept_years group by school_id) using (school_id) "
            f"left join (select school_id, {half_up('sum(avg_h)', 'count(avg_h)')} as all_h from answers where avg_h is not null "
            "group by school_id) using (school_id) "
            f"left join (select school_id, {half_up('sum(avg_h)', 'count(avg_h)')} as admission_h from school_subject "
            f"where avg_h is not null and {counted} group by school_id) using (school_id) "
            "left join chances using (school_id) left join shares using (school_id)",
        ),
        ("remaining", f"select * from figures where {' and '.join(stays) or 'true'}"),
        (
            "peak",
            f"select max(coalesce(graduates_t, 0)) as graduates_t, max(coalesce({rated_h}, 0)) as {rated_h}, "
            "max(coalesce(potential_h, 0)) as potential_h from remaining",
        ),
        ("importance", f"select w0 / t as w_g, w1 / t as w_s, w2 / t as w_p, w3 / t as w_t from (select *, list_aggregate([w0, w1, w2, w3], 'fsum') as t from (select {positive}))"),
        (
            "normed",
            f"select remaining.*, {of_top('graduates_t')} as n_g, {of_top(rated_h)} as n_s, "
            + (of_top("potential_h") if scope else "0e0")
            + f" as n_p, {scaled('coalesce(share, 0)' if scope else 'coalesce(share_all, 0)', 4)} as n_t from remaining, peak",
        ),
        ("weighed", "select normed.*, w_g * n_g as p_g, w_s * n_s as p_s, w_p * n_p as p_p, w_t * n_t as p_t from normed, importance"),
        (
            "ordered",
            "select *, row_number() over (order by rating_score desc, "
            f"coalesce({rated_h}, 0) desc, coalesce(graduates_t, 0) desc, lower(full_name), school_id) as rank_pos "
            f"from (select *, {round_even('p_g + p_s + p_p + p_t', 6)} as rating_score from weighed)",
        ),
        ("profiles", PROFILE_NAMES),
        ("ranked", "select * from ordered left join matched using (school_id) left join profiles using (school_id)"),
    ]


def rating_select(f: RatingFilters) -> str:
    scope = bool(f.subject_ids or f.institute_ids or f.program_ids)
    potential = scaled("potential_h", 2) if scope else "cast(null as double)"
    admission = scaled("admission_h", 2) if scope else "cast(null as double)"
    for_rating = admission if scope else scaled("all_h", 2)
    return (
        "select rank_pos, school_id, full_name, is_active, region_id, region_name, municipality_id, "
        "municipality_name, coalesce(profile_names, '') as profile_names, "
        f"{scaled('graduates_t', 1)} as avg_graduates, cast(last_year as bigint) as last_year, ege_years, "
        f"{scaled('all_h', 2)} as avg_score_all, {admission} as admission_subject_avg, "
        f"{for_rating} as avg_score_for_rating, "
        + ("programs_total, programs_matched, " if scope else "0::bigint as programs_total, 0::bigint as programs_matched, ")
        + f"{potential} as potential_applicants_avg, n_t as threshold_share, "
        "coalesce(matched_programs, '') as matched_programs, "
        f"{round_even('n_g', 4)} as norm_graduates, {round_even('n_s', 4)} as norm_avg_score, "
        f"{round_even('n_p', 4)} as norm_potential_applicants, {round_even('n_p', 4)} as match_share, "
        f"{round_even('p_g', 6)} as score_part_graduates, {round_even('p_s', 6)} as score_part_avg_score, "
        f"{round_even('p_p', 6)} as score_part_potential, {round_even('p_t', 6)} as score_part_threshold, "
        "rating_score from ranked" + ("" if f.limit is None else f" where rank_pos <= {f.limit}")
    )


def rating_sql(f: RatingFilters, weights: RatingWeights | None = None) -> str:
    return with_views(rating_select(f), *RATING_VIEWS, ctes=rating_ctes(f, weights or RatingWeights()))


def rating_part_sql(select: str, f: RatingFilters, upto: str) -> str:
    """A statement over the inner relations of the rating, up to and including ``upto``."""
    ctes = rating_ctes(f, RatingWeights())
    last = [name for name, _ in ctes].index(upto)
    return with_views(select, *RATING_VIEWS, ctes=ctes[: last + 1])
