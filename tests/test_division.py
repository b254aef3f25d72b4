"""Subject masks against plain sets, and the facts bucketed by school."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from edurank.operators import division, rating, search
from edurank.plans.params import RatingFilters, RatingWeights, SchoolFilters
from edurank.sources.colocated import colocate, drop_colocated, open_colocated
from test_operators import make


def judged_plainly(sets, programs):
    """Per school and program with a hit: satisfied requirements and choices, completeness, people."""
    found = {}
    for school, people in sets.items():
        for program, needs in programs.items():
            required = {s for s, role, _ in needs if role == "required"}
            groups = {}
            for s, role, weight in needs:
                if role == "choice":
                    groups.setdefault(weight, set()).add(s)
            counted = [g for w, g in groups.items() if w is not None]
            if not any(s in people for s, *_ in needs):
                continue
            required_ok, choice_ok = len(required & set(people)), sum(bool(g & set(people)) for g in counted)
            complete = bool(required) and required_ok == len(required) and choice_ok == len(counted)
            potential = Decimal(0)
            if complete:
                best = [max((people[s] for s in g if s in people), default=None) for g in groups.values()]
                potential = min([people[s] for s in required] + [b for b in best if b is not None])
            found[school, program] = (required_ok, choice_ok, complete, potential)
    return found


@pytest.mark.parametrize("subjects", [9, 150])
def test_division_equals_plain_sets(spark, subjects):
    rng = random.Random(subjects)
    ids = [10 * i + 7 for i in range(subjects)]
    programs = {}
    for p in range(60):
        chosen = rng.sample(ids, rng.randint(1, 6))
        needs = [(s, "required" if rng.random() < 0.5 else "choice", rng.choice([2, 3, 3, None])) for s in chosen]
        programs[p] = [(s, role, 1 if role == "required" else w) for s, role, w in needs]
    programs[60] = programs[5]
    sets = {}
    for school in range(40):
        some = rng.sample(ids, rng.randint(0, min(subjects, 60)))
        sets[school] = {s: Decimal(rng.randint(100, 999)) / 100 for s in some}
    sets[40] = dict(sets[3])
    requirements = spark.createDataFrame(
        [(p, *n) for p, needs in programs.items() for n in needs], "program_id bigint, subject_id bigint, role string, weight int"
    )
    numbers = division.subject_numbers(requirements)
    plans, members = division.requirement_plans(requirements, numbers)
    number = division.number_of("subject_id", numbers)
    rows = spark.createDataFrame(
        [(school, s, v) for school, people in sets.items() for s, v in people.items()] or [], "school_id bigint, subject_id bigint, people decimal(14,2)"
    )
    schools = rows.groupBy("school_id").agg(
        F.expr(f"{division.set_aggregate(number, 'true', division.words(numbers))} as reached"),
        F.expr(f"map_from_entries(collect_list(if({number} >= 0, struct({number}, people), null))) as people"),
    )
    judged = division.judged_sets(schools, plans, numbers)
    met = schools.select("school_id", "reached").join(judged, "reached").join(members, "plan_id")
    verdicts = {(r.school_id, r.program_id): (r.required_ok, r.choice_ok, r.complete) for r in met.collect()}
    drawn = division.divided(schools, judged).join(members, "plan_id").collect()
    potential = {(r.school_id, r.program_id): r.potential_applicants for r in drawn}
    expected = judged_plainly(sets, programs)
    assert verdicts == {k: v[:3] for k, v in expected.items()}
    assert potential == {k: v[3] for k, v in expected.items()}
    assert {v[2] for v in expected.values()} == {True, False}
    assert plans.count() < len(programs)


def test_masks_of_several_words(spark):
    row = spark.range(1).selectExpr("array(-1L, 5L) as a", "array(shiftleft(1L, 63), 4L) as b")
    got = row.selectExpr(
        f"{division.common('a', 'b', 2)} as n", f"{division.holds('a', 'b', 2)} as holds", f"{division.holds('b', 'a', 2)} as back",
        f"{division.meets('a', 'b', 2)} as meets", f"{division.members('b', 67)} as items",
    ).first()
    assert tuple(got) == (2, True, False, True, [63, 66])


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    years = [(10 * s + y, s, 2020 + y, k, rng.randint(5, 60)) for s in range(1, 31) for y, k in ((0, "actual"), (1, "actual"), (2, "plan"))]
    stats, n = [], 0
    for year in years:
        for subject in rng.sample(range(1, 6), rng.randint(0, 4)):
            n += 1
            stats.append((n, year[0], subject, rng.randint(0, 9), 0, 0, 0, Decimal(rng.randint(3000, 9000)) / 100, rng.choice([None, 3])))
    return make(
        spark,
        region=[(1, "Край")],
        municipality=[(1, 1, "город А"), (2, 1, "город Б")],
        school=[(s, 1 + s % 2, f"Школа {s}", True) for s in range(1, 33)],
        school_profile=[(1, "P"), (2, "Q")],
        school_profile_link=[(s, 1 + s % 2) for s in range(1, 31)],
        ege_subject=[(i, f"S{i}", Decimal(40 + i)) for i in range(1, 6)],
        institute=[(1, "I")],
        study_program=[(1, 1, "P1", "Program", True), (2, 1, "P2", "Other", True)],
        program_ege_requirement=[(1, 1, 1, "required", 1), (2, 1, 2, "choice", 2), (3, 1, 3, "choice", 2), (4, 2, 4, "required", 1)],
        ege_school_year=years,
        ege_school_subject_stat=stats,
    )


@pytest.fixture(scope="module")
def located(spark, tables, tmp_path_factory):
    yield colocate(tables, "test_facts", 4, f"file:{tmp_path_factory.mktemp('bucketed')}")
    drop_colocated(spark, "test_facts")


FILTERS = [
    RatingFilters(enforce_subject_threshold=False),
    RatingFilters(),
    RatingFilters(municipality_id=2, kind="actual", year=2021),
    RatingFilters(subject_ids=(1, 2)),
    RatingFilters(subject_ids=(1, 2), enforce_subject_threshold=False, min_avg_score=50.5),
    RatingFilters(institute_ids=(1,)),
    RatingFilters(institute_ids=(1,), subject_ids=(3,), enforce_subject_threshold=False),
]


@pytest.mark.parametrize("filters", FILTERS)
def test_the_layout_gives_the_same_rating(tables, located, filters):
    plain = rating.rate_schools(tables, filters, RatingWeights()).collect()
    assert rating.rate_schools(located, filters, RatingWeights()).collect() == plain
    assert plain


def test_grouping_by_school_needs_no_shuffle(tables, located):
    plan = rating.rating_candidates(located, FILTERS[0]).rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Bucketed: true" in plan
    plain = rating.rating_candidates(tables, FILTERS[0]).rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plain


def test_a_layout_is_found_again_and_left_when_its_tables_change(spark, tables, located):
    again = open_colocated(tables, "test_facts")
    assert again["school"].count() == 32 and again.subject_facts.count() == tables["ege_school_subject_stat"].count()
    assert located.with_tables({"region": tables["region"]}).subject_facts is not None
    other = located.with_tables({"ege_school_year": tables["ege_school_year"].where("year = 2020")})
    assert other.subject_facts is None and other["ege_school_year"].count() == 30


def test_search_by_all_subjects(tables):
    found = search.schools_with_subjects(tables, SchoolFilters(subject_ids=(2, 4))).distinct().collect()
    by_year = {}
    for r in tables["ege_school_subject_stat"].collect():
        by_year.setdefault(r.ege_school_year_id, set()).add(r.subject_id)
    assert {r.school_id for r in found} == {y // 10 for y, s in by_year.items() if {2, 4} <= s}
