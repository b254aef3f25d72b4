"""School rating: weighted sum of size, results, admission potential and passed thresholds.

Shape of the job: one pass over the exam facts down to a school x subject table,
conditional aggregates per school, admission matches built from *hits* only (a
school that has the subject), exact maxima over the surviving schools, and
names looked up for the returned rows alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edurank.functions.numeric import exact_avg, exact_ratio, round_even, to_int_even
from edurank.operators import division, facts
from edurank.operators.schools import narrows_schools, profile_names, schools_in_scope, with_place
from edurank.plans.joins import join_few_keys
from edurank.plans.materialize import materialize
from edurank.plans.paging import with_row_number
from edurank.plans.params import RatingFilters, RatingWeights
from edurank.plans.texts import REF, ByReference, attach_texts
from edurank.sources.store import Tables

RATING_COLUMNS = (
    "rank_pos school_id full_name is_active region_id region_name municipality_id municipality_name profile_names "
    "avg_graduates last_year ege_years avg_score_all admission_subject_avg avg_score_for_rating programs_total "
    "programs_matched potential_applicants_avg threshold_share matched_programs norm_graduates norm_avg_score "
    "norm_potential_applicants match_share score_part_graduates score_part_avg_score score_part_potential "
    "score_part_threshold rating_score"
).split()


# --- admission scope -------------------------------------------------------------------------


def selected_programs(tables: Tables, filters: RatingFilters) -> DataFrame:
    """Active programs of the scope, or one stand-in program for chosen subjects."""
    if filters.has_programs:
        programs = tables["study_program"].where(F.col("is_active").eqNullSafe(True))
        if filters.institute_ids:
            programs = programs.where(F.col("institute_id").isin(*filters.institute_ids))
        if filters.program_ids:
            programs = programs.where(F.col("program_id").isin(*filters.program_ids))
        return programs.select("program_id", "code", F.col("name").alias("program_name"), "institute_id")
    stand_in = tables.spark.range(1 if filters.has_subjects else 0)
    return stand_in.select(
        F.lit(0).cast("bigint").alias("program_id"),
        F.lit(None).cast("string").alias("code"),
        F.lit("selected_subjects").alias("program_name"),
        F.lit(None).cast("bigint").alias("institute_id"),
    )


def scope_requirements(tables: Tables, filters: RatingFilters) -> DataFrame:
    """Subjects each program of the scope asks for; chosen subjects are required everywhere."""
    programs = selected_programs(tables, filters).select("program_id")
    subjects = tables["ege_subject"].select("subject_id", "min_passing_score")
    branches = []
    stored = tables["program_ege_requirement"]
    if filters.has_programs:
        own = stored.join(programs, "program_id").join(subjects, "subject_id", "left")
        branches.append(own.select("program_id", "subject_id", "role", "weight", "min_passing_score"))
    if filters.has_subjects:
        chosen = subjects.where(F.col("subject_id").isin(*filters.subject_ids))
        ids = F.array(*(F.lit(i).cast("bigint") for i in filters.subject_ids))
        added = programs.withColumn("subject_id", F.explode(ids)).withColumn("role", F.lit("required"))
        if filters.has_programs:
            added = added.join(
                stored.where(F.col("role") == "required"), ["program_id", "subject_id"], "left_anti"
            )
        added = added.join(chosen, "subject_id").withColumn("weight", F.lit(None).cast("int"))
        branches.append(added.select("program_id", "subject_id", "role", "weight", "min_passing_score"))
    result = branches[0]
    for branch in branches[1:]:
        result = result.unionByName(branch)
    return result


@dataclass(frozen=True)
class ProgramScope:
    """Programs of a rating as plans of subject masks."""

    numbers: tuple[int, ...]
    plans: DataFrame
    members: DataFrame

    @property
    def total(self) -> int:
        """Programs that ask for anything, as a one-value subquery."""
        return self.plans.select(F.coalesce(F.sum("programs"), F.lit(0))).scalar()


def program_scope(tables: Tables, filters: RatingFilters) -> ProgramScope:
    requirements = materialize(scope_requirements(tables, filters))
    numbers = division.subject_numbers(requirements)
    plans, members = division.requirement_plans(requirements, numbers)
    return ProgramScope(numbers, materialize(plans), members)


def school_sets(tables: Tables, subjects: DataFrame, filters: RatingFilters, numbers: Sequence[int]) -> DataFrame:
    """Per school the mask of subjects that count for admission, and the people behind each."""
    return facts.with_pass_marks(tables, subjects).groupBy("school_id").agg(*_set_aggregates(filters, numbers))


def _admits(filters: RatingFilters) -> str:
    return facts.reaches("avg_score", "min_passing_score" if filters.enforce_subject_threshold else None, filters.min_avg_score)


def _set_aggregates(filters: RatingFilters, numbers: Sequence[int]) -> list[Column]:
    number, admits = division.number_of("subject_id", numbers), f"coalesce({_admits(filters)}, false)"
    counted = f"{admits} and {number} >= 0"
    return [
        F.expr(f"{division.set_aggregate(number, admits, division.words(numbers))} as reached"),
        F.expr(f"map_from_entries(collect_list(if({counted}, struct({number}, participants_avg), null))) as people"),
    ]


def plan_matches(sets: DataFrame, scope: ProgramScope) -> DataFrame:
    """Potential applicants and threshold share per school and requirement plan.

    Only pairs with at least one satisfied subject appear; every other pair has
    zero in both figures and is accounted for by its absence.
    """
    return division.divided(sets, division.judged_plans(sets, scope.plans, scope.numbers))


def program_matches(sets: DataFrame, scope: ProgramScope, shown: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Potential applicants and threshold share per school and program (pairs with a hit); ``sets`` are written.

    ``shown`` gives the figures another form, worked out once for all programs of a plan.
    """
    judged = plan_matches(division.dealt_schools(sets, scope.plans), scope).drop("programs")
    return division.with_programs(judged if shown is None else shown(judged), scope.members).select(
        "school_id", "program_id", "potential_applicants", "threshold_share"
    )


def program_summary(sets: DataFrame, scope: ProgramScope, judged: DataFrame | None = None) -> DataFrame:
    """Admission figures per school over all programs of the scope.

    What depends on the set of subjects alone is summed per set; only plans that
    a school completes are worked out for the school.
    """
    judged = division.judged_plans(sets, scope.plans, scope.numbers) if judged is None else judged
    per_set = judged.groupBy("reached").agg(
        F.expr("coalesce(sum(if(complete, programs, 0)), 0) as programs_matched"),
        F.expr("coalesce(max(case when complete then threshold_share end), max(threshold_share)) as program_threshold_share"),
    )
    drawn = (
        division.divided(sets, judged.where("complete"))
        .groupBy("school_id")
        .agg(F.expr("sum(potential_applicants * programs) as potential_sum"))
    )
    return (
        join_few_keys(sets.select("school_id", "reached"), per_set, ["reached"], F.col("school_id"))
        .join(drawn, "school_id", "left")
        .withColumn("programs_total", scope.total)
        .selectExpr(
            "school_id",
            "programs_matched",
            "program_threshold_share",
            "programs_total",
            f"{exact_ratio('coalesce(potential_sum, 0)', 'programs_total', 2)} as potential_applicants_avg",
        )
    )


PROGRAM_LABEL = "case when coalesce(code, '') = '' then program_name else concat(code, ' ', program_name) end"


def matched_plans(matches: DataFrame) -> DataFrame:
    """The plans that each school (school_id) can fill, as a sorted list ``plans``."""
    return (
        matches.where("potential_applicants > 0")
        .groupBy("school_id")
        .agg(F.expr("array_sort(collect_list(plan_id)) as plans"))
    )


def plan_names(filled: DataFrame, programs: DataFrame) -> DataFrame:
    """Names of the programs of every different list of plans, in name order; ``programs`` carry their plan."""
    asked = filled.select("plans").distinct().selectExpr("plans", "explode(plans) as plan_id")
    names = (
        join_few_keys(asked, programs, ["plan_id"], F.xxhash64("plans"))
        .selectExpr("*", f"{PROGRAM_LABEL} as label")
        .groupBy("plans")
        .agg(
            F.expr("listagg(label, '; ') within group (order by program_name, program_id)").alias("matched_programs")
        )
    )
    return materialize(names)


def _named_plans(filled: DataFrame, programs: DataFrame) -> ByReference:
    """Schools of ``filled`` lists of plans that have any program, with the reference of its names."""
    ref = f"sha2(array_join(plans, ','), 256) as {REF}"
    texts = plan_names(filled, programs).selectExpr(ref, "matched_programs as _text")
    named = join_few_keys(filled.selectExpr("school_id", ref), texts.select(REF), [REF], F.xxhash64("school_id"))
    return ByReference(named, texts)


def matched_program_names(matches: DataFrame, programs: DataFrame) -> DataFrame:
    """Names of the matched programs per school, in name order.

    ``matches`` are schools and plans, ``programs`` carry plan_id, code and
    program_name.  Schools that can fill the same plans share one text.
    """
    named, texts = _named_plans(materialize(matched_plans(matches)), programs)
    return attach_texts(named, texts, REF).selectExpr("school_id", "_text as matched_programs")


# --- school figures --------------------------------------------------------------------------


def school_figures(
    tables: Tables, subjects: DataFrame, filters: RatingFilters, numbers: Sequence[int] | None = None
) -> DataFrame:
    """All score based figures of a school from one conditional aggregation.

    ``numbers`` are the subjects of a program scope: they make the school's set
    and, where no subjects are chosen, the admission average.
    """
    marked = facts.with_pass_marks(tables, subjects)
    passed = f"avg_score is not null and {facts.reaches('avg_score', 'min_passing_score', filters.min_avg_score)}"
    counted = chosen = f"subject_id in ({', '.join(map(str, filters.subject_ids))})" if filters.has_subjects else "false"
    if numbers is not None and not filters.has_subjects:
        counted = f"{division.number_of('subject_id', numbers)} >= 0"
    relevant = f"case when {counted} then avg_score end"
    return (
        marked.groupBy("school_id")
        .agg(
            F.expr(f"{facts.MEAN_SCORE} as avg_score_all"),
            F.expr("count(avg_score) as averaged"),
            F.expr(f"count_if({passed}) as passed"),
            F.expr(f"count_if({chosen}) as chosen_present"),
            F.expr(f"count_if({chosen} and {passed}) as chosen_passed"),
            F.expr(f"count_if({chosen} and {_admits(filters)}) as chosen_admitted"),
            F.expr(f"min(case when {chosen} then participants_avg end) as chosen_people"),
            F.expr(f"{exact_avg(relevant, 2)} as admission_subject_avg"),
            *([] if numbers is None else _set_aggregates(filters, numbers)),
        )
        .selectExpr("*", f"{exact_ratio('passed', 'averaged', 4)} as threshold_share_all")
    )


def _eligible(figures: DataFrame, filters: RatingFilters) -> DataFrame:
    """Chosen subjects present (and passed); without a scope, every averaged subject passed."""
    wanted = len(filters.subject_ids)
    if filters.has_subjects:
        figures = figures.where(f"chosen_present = {wanted}")
        if filters.enforce_subject_threshold:
            figures = figures.where(f"chosen_passed = {wanted}")
    if filters.all_thresholds:
        figures = figures.where("averaged > 0 and passed = averaged")
    return figures


@dataclass(frozen=True)
class Candidates:
    """Schools that take part in a rating; with programs also their sets and the scope."""

    rows: DataFrame
    sets: DataFrame | None = None
    scope: ProgramScope | None = None
    judged: DataFrame | None = None


def rating_candidates(tables: Tables, filters: RatingFilters) -> Candidates:
    """Schools that take part in the rating with their figures, before scoring."""
    schools = schools_in_scope(tables, filters)
    wanted = schools if narrows_schools(filters) else None
    school_years = facts.periods(tables, filters, wanted)
    subjects = facts.school_subjects(facts.scoped_subject_rows(tables, filters, wanted))
    scope = program_scope(tables, filters) if filters.has_programs else None
    figures = _eligible(school_figures(tables, subjects, filters, scope and scope.numbers), filters)
    # subject conditions need a figures row; otherwise a school without results stays
    how = "inner" if filters.has_subjects or filters.all_thresholds else "left"
    rows = facts.period_summary(school_years).join(figures, "school_id", how)
    sets = judged = None
    if filters.has_scope:
        if scope is not None:
            rows = materialize(rows)
            sets = rows.where("reached is not null").select("school_id", "reached", "people")
            judged = division.judged_plans(sets, scope.plans, scope.numbers)
            rows = rows.drop("reached", "people").join(program_summary(sets, scope, judged), "school_id")
        else:
            # The chosen subjects are one program, and all of them were found: it is met whole or not at all.
            rows = rows.where(f"chosen_admitted = {len(filters.subject_ids)}").selectExpr(
                "*",
                "1L as programs_total",
                "1L as programs_matched",
                "cast(chosen_people as decimal(14,2)) as potential_applicants_avg",
                "cast(1 as decimal(16,4)) as program_threshold_share",
            )
        rows = rows.where("potential_applicants_avg > 0")
        scoped = [
            "admission_subject_avg",
            "admission_subject_avg as avg_score_for_rating",
            "programs_total",
            "programs_matched",
            "potential_applicants_avg",
            "program_threshold_share as threshold_share",
        ]
    else:
        scoped = [
            "cast(null as decimal(14,2)) as admission_subject_avg",
            "avg_score_all as avg_score_for_rating",
            "0L as programs_total",
            "0L as programs_matched",
            "cast(0 as decimal(14,2)) as potential_applicants_avg",
            "cast(coalesce(threshold_share_all, 0) as decimal(16,4)) as threshold_share",
        ]
    rows = rows.selectExpr("school_id", "avg_graduates", "last_year", "ege_years", "avg_score_all", *scoped)
    if filters.min_graduates is not None:
        rows = rows.where(f"coalesce(avg_graduates, 0) >= {int(filters.min_graduates)}")
    if filters.min_avg_score is not None:
        rows = rows.where(facts.reaches("coalesce(avg_score_for_rating, 0)", None, filters.min_avg_score))
    rows = rows.join(schools.select("school_id", "full_name"), "school_id")
    return Candidates(rows, sets, scope, judged)


# --- scoring ---------------------------------------------------------------------------------


def _share_of_max(value: str, top: str) -> str:
    """``value / max`` in exact numerics, zero for a non-positive maximum, as a double."""
    exact = f"cast(coalesce({value}, 0) as decimal(18,8)) / nullif({top}, 0)"
    return f"cast(case when {top} > 0 then {exact} else 0 end as double)"


def score_schools(candidates: DataFrame, filters: RatingFilters, weights: RatingWeights) -> DataFrame:
    """Norms, weighted parts and the total score of every candidate.

    The maxima are one row, read as a scalar subquery; a window over all schools
    would put every school into one task.
    """
    used = weights.effective(filters.has_scope)
    peaks = candidates.selectExpr(
        "struct(cast(max(coalesce(avg_graduates, 0)) as decimal(11,1)) as graduates, "
        "cast(max(coalesce(avg_score_for_rating, 0)) as decimal(8,2)) as score, "
        "cast(max(coalesce(potential_applicants_avg, 0)) as decimal(12,2)) as potential)"
    ).scalar()
    potential = _share_of_max("potential_applicants_avg", "_peaks.potential") if filters.has_scope else "0D"
    parts = (
        candidates.withColumn("_peaks", peaks)
        .selectExpr(
            "* except (_peaks)",
            f"{_share_of_max('avg_graduates', '_peaks.graduates')} as _g",
            f"{_share_of_max('avg_score_for_rating', '_peaks.score')} as _s",
            f"{potential} as _p",
            "cast(threshold_share as double) as _t",
        )
        .selectExpr(
            "*",
            f"{used.graduates!r}D * _g as _pg",
            f"{used.avg_score!r}D * _s as _ps",
            f"{used.match_share!r}D * _p as _pp",
            f"{used.threshold_share!r}D * _t as _pt",
        )
        .selectExpr("*", "_pg + _ps + _pp + _pt as _total")
    )
    doubles = ("avg_graduates", "avg_score_all", "admission_subject_avg", "avg_score_for_rating")
    return parts.selectExpr(
        "school_id",
        "full_name",
        "last_year",
        "ege_years",
        "programs_total",
        "programs_matched",
        *(f"cast({name} as double) as {name}" for name in doubles),
        f"cast({'potential_applicants_avg' if filters.has_scope else 'null'} as double) as potential_applicants_avg",
        "_t as threshold_share",
        f"{round_even('_g', 4)} as norm_graduates",
        f"{round_even('_s', 4)} as norm_avg_score",
        f"{round_even('_p', 4)} as norm_potential_applicants",
        f"{round_even('_pg', 6)} as score_part_graduates",
        f"{round_even('_ps', 6)} as score_part_avg_score",
        f"{round_even('_pp', 6)} as score_part_potential",
        f"{round_even('_pt', 6)} as score_part_threshold",
        f"{round_even('_total', 6)} as rating_score",
    )


def rank_schools(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """Schools with their place, the best ``limit`` of them if given; no task sees all rows."""
    order = (
        F.col("rating_score").desc(),
        F.coalesce("avg_score_for_rating", F.lit(0.0)).desc(),
        F.coalesce("avg_graduates", F.lit(0.0)).desc(),
        F.lower("full_name").asc(),
        F.col("school_id").asc(),
    )
    ranked = with_row_number(scored, order, "rank_pos")
    return ranked if limit is None else ranked.where(F.col("rank_pos") <= limit)


def rate_by_reference(tables: Tables, filters: RatingFilters, weights: RatingWeights | None = None) -> ByReference:
    """Ranked schools with the reference of the names of their matched programs in place of these."""
    weights = weights or RatingWeights()
    found = rating_candidates(tables, filters)
    candidates = materialize(found.rows)
    best = rank_schools(score_schools(candidates, filters, weights), filters.limit)
    ids = best.select("school_id")
    places = with_place(tables, tables["school"].join(ids, "school_id", "left_semi")).drop("full_name")
    result = best.join(places, "school_id").join(profile_names(tables, ids), "school_id", "left")
    none = tables.spark.range(1).selectExpr(f"sha2('', 256) as {REF}", "'' as _text")
    if filters.has_programs:
        wanted = found.sets.join(ids, "school_id", "left_semi")
        matched = division.divided(wanted, found.judged.where("complete"))
        programs = found.scope.members.join(selected_programs(tables, filters), "program_id")
        named, texts = _named_plans(materialize(matched_plans(matched)), programs)
        result = result.join(named, "school_id", "left")
        texts = texts.selectExpr(REF, "coalesce(_text, '') as _text").unionByName(none)
    else:
        result, texts = result.withColumn(REF, F.lit(None).cast("string")), none
    rows = result.withColumns(
        {
            "profile_names": F.expr("coalesce(profile_names, '')"),
            "match_share": F.col("norm_potential_applicants"),
            REF: F.expr(f"coalesce({REF}, sha2('', 256))"),
        }
    )
    return ByReference(rows.select(*(c for c in RATING_COLUMNS if c != "matched_programs"), REF), texts)


def rate_schools(tables: Tables, filters: RatingFilters, weights: RatingWeights | None = None) -> DataFrame:
    """Ranked schools, best first; by the names of their programs where these are very long in all (``plans/texts``)."""
    rows, texts = rate_by_reference(tables, filters, weights)
    if not filters.has_programs:
        return rows.withColumn("matched_programs", F.lit("")).select(*RATING_COLUMNS).orderBy("rank_pos")
    return attach_texts(materialize(rows), texts, REF, [F.col("rank_pos")]).withColumnRenamed("_text", "matched_programs").select(*RATING_COLUMNS)


# --- derived reports -------------------------------------------------------------------------

PARTS = ("score_part_graduates", "score_part_avg_score", "score_part_potential", "score_part_threshold")


def rating_top_parts(ranked: DataFrame, top: int = 10) -> DataFrame:
    """Score parts of the best schools, their share of the school's total and of the best total."""
    total = " + ".join(f"coalesce({p}, 0D)" for p in PARTS)
    return (
        ranked.where(F.col("rank_pos") <= top)
        .selectExpr("rank_pos", "full_name as name", *PARTS, f"{total} as _total")
        .selectExpr("* except (_total)", f"{round_even('_total', 6)} as score_total")
        .selectExpr(
            "*",
            *(
                f"case when score_total > 0 then {p} / nullif(score_total, 0) else 0D end as "
                + p.replace("score_part", "share")
                for p in PARTS
            ),
            # at most `top` rows in this window
            "score_total / nullif(max(score_total) over (partition by 1), 0) as relative_to_top",
        )
        .orderBy("rank_pos")
    )


def rating_export(ranked: DataFrame, filters: RatingFilters) -> DataFrame:
    """Columns of the rating sheet; potential applicants only with a scope."""
    potential = (
        [f"{to_int_even('potential_applicants_avg')} as potential_applicants_avg"] if filters.has_scope else []
    )
    return ranked.selectExpr("*", "threshold_share * 100D as _pct").selectExpr(
        "rank_pos",
        "school_id",
        "region_name",
        "municipality_name",
        "full_name",
        "profile_names",
        f"{to_int_even('avg_graduates')} as avg_graduates",
        "avg_score_all",
        "ege_years",
        "last_year",
        "programs_total",
        "programs_matched",
        *potential,
        f"{round_even('_pct', 2)} as threshold_share_pct",
        "rating_score",
        "matched_programs",
    )
