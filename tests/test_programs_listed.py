"""Schools meet the programs of their plans in lists, dealt by the rows that come out."""

from decimal import Decimal

from edurank.operators import division, rating


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scope_of(spark, members):
    """Subjects 7 and 9 are numbers 0 and 1: plan 0 asks for the first, plan 5 for both, plan 6 for a choice of both."""
    asked = {0: [(7, "required", 1)], 5: [(7, "required", 1), (9, "required", 1)], 6: [(9, "choice", 2), (7, "choice", 2)]}
    rows = [(program, *need) for program, plan in members for need in asked[plan]]
    requirements = spark.createDataFrame(rows, "program_id bigint, subject_id bigint, role string, weight int")
    numbers = division.subject_numbers(requirements)
    plans, own = division.requirement_plans(requirements, numbers)
    return rating.ProgramScope(numbers, plans, own)


def test_programs_come_in_lists(spark, monkeypatch):
    monkeypatch.setattr(division, "LIST_PROGRAMS", 10)
    judged = spark.createDataFrame([(1, 0, "a"), (1, 0, "a"), (2, 5, None), (None, 0, "n"), (3, None, "x"), (4, 8, "y")], "school_id bigint, plan_id bigint, what string")
    members = spark.createDataFrame([(p, 0) for p in range(95)] + [(-(1 << 60), 5), (7, None)], "program_id bigint, plan_id bigint")
    found = division.with_programs(judged, members)
    # The order of the columns is free.
    got = sorted(map(str, found.select("school_id", "plan_id", "what", "program_id").collect()))
    assert got == sorted(map(str, judged.join(members, "plan_id").select("school_id", "plan_id", "what", "program_id").collect()))
    assert "Generate explode(_programs" in plan_of(found)
    assert len(got) == 3 * 95 + 1


def test_matches_are_dealt_by_their_rows(spark, monkeypatch):
    members = [(p, 0) for p in range(30)] + [(100, 5), (101, 5), (200, 6)]
    scope = scope_of(spark, members)
    people = [(1, [3], {0: Decimal(8), 1: Decimal(5)}), (2, [1], {0: Decimal(4)}), (3, [0], {}), (4, [2], {1: Decimal(2)})]
    sets = spark.createDataFrame(people, "school_id bigint, reached array<bigint>, people map<int, decimal(14,2)>")
    expected = {}
    for school, _, held in people:
        for program, plan in members:
            needs, options = {0: ([0], []), 5: ([0, 1], []), 6: ([], [0, 1])}[plan]
            hits = [n for n in (*needs, *options) if n in held]
            if hits:
                whole = bool(needs) and len(hits) == len(needs)
                share = Decimal(1) if options else Decimal(len(hits)) / len(needs)
                expected[school, program] = (min(held[n] for n in needs) if whole else Decimal(0), share)
    tasks = []
    monkeypatch.setattr(division, "TASK_ROWS", 10)
    deal = division.dealt_schools
    monkeypatch.setattr(division, "dealt_schools", lambda *given: tasks.append(deal(*given).rdd.getNumPartitions()) or deal(*given))
    found = rating.program_matches(sets, scope, lambda rows: rows.withColumn("threshold_share", rows["threshold_share"].cast("double")))
    assert dict(found.dtypes)["threshold_share"] == "double"
    rows = found.collect()
    assert {(r.school_id, r.program_id): (r.potential_applicants, Decimal(r.threshold_share)) for r in rows} == expected
    # Four schools and 33 programs are 132 rows at most.
    assert len(rows) == len(expected) and tasks == [14]


def test_rows_of_a_list_lie_together(spark, tmp_path):
    """Written, a list of programs costs less for every further school."""
    members = spark.range(60_000).selectExpr("id * 7919 % 100003 as program_id", "id % 2 as plan_id")
    sizes = {}
    for schools in (10, 40):
        judged = spark.range(schools * 2).selectExpr("id div 2 as school_id", "id % 2 as plan_id").repartition(1, "school_id")
        found = division.with_programs(judged, members)
        assert found.count() == schools * 60_000 and found.distinct().count() == schools * 60_000
        found.write.parquet(str(tmp_path / str(schools)))
        sizes[schools] = sum(p.stat().st_size for p in (tmp_path / str(schools)).glob("*.parquet"))
    # 1,800,000 more rows: more than a byte each if all programs of a school came before the next school.
    assert sizes[40] - sizes[10] < 1_000_000, sizes
