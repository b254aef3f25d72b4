from datetime import datetime, timezone
from decimal import Decimal

import pytest

from edurank.ingest import directory, exam, programs
from edurank.operators import integrity, merging, rating, regions, runs, search
from edurank.plans.params import Page, RatingFilters, RatingWeights, SchoolFilters
from edurank.sources.cells import CELL_SCHEMA, exam_columns
from edurank.sources.exports import filter_sheet, write_sheets
from edurank.sources.schema import struct_type
from edurank.sources.seeds import pass_marks, subject_seed
from edurank.sources.store import Tables


def make(spark, **rows) -> Tables:
    frames = {}
    for name, values in rows.items():
        fields = struct_type(name).fieldNames()
        frames[name] = spark.createDataFrame(
            [tuple(v) + (None,) * (len(fields) - len(v)) for v in values], struct_type(name)
        )
    return Tables(spark, frames)


def d(x):
    return None if x is None else Decimal(x)


@pytest.fixture
def small(spark):
    """Schools 1 and 2 with results, school 3 without; programs 1 (two required, one choice) and 2 (choice only)."""
    return make(
        spark,
        region=[(1, "Край")],
        municipality=[(1, 1, "город А")],
        school=[(1, 1, "Школа 1", True), (2, 1, "Школа 2", True), (3, 1, "Школа 3", False)],
        ege_subject=[(i, f"S{i}", d(40)) for i in range(1, 5)],
        institute=[(1, "I")],
        study_program=[(1, 1, "P1", "Program", True), (2, 1, "P2", "Other", True)],
        program_ege_requirement=[
            (1, 1, 1, "required", 1),
            (2, 1, 2, "required", 1),
            (3, 1, 3, "choice", 2),
            (4, 1, 4, "choice", 2),
            (5, 2, 3, "choice", 2),
        ],
        ege_school_year=[(1, 1, 2022, "actual", 30), (2, 2, 2022, "actual", 20), (3, 2, 2021, "actual", 10)],
        ege_school_subject_stat=[
            (1, 1, 1, 80, 0, 0, 0, d("60.00"), 80),
            (2, 1, 2, 60, 0, 0, 0, d("60.00"), 60),
            (3, 1, 3, 40, 0, 0, 0, d("50.00"), 40),
            (4, 1, 4, 50, 0, 0, 0, d("50.00"), 50),
            (5, 2, 1, 10, 0, 0, 0, d("70.00"), 10),
            (6, 3, 2, 10, 0, 0, 0, d("39.99"), 10),
        ],
    )


def test_potential_is_bounded_by_the_best_choice(small):
    rows = rating.rate_schools(small, RatingFilters(program_ids=(1, 2)), RatingWeights()).collect()
    assert [r.school_id for r in rows] == [1]
    top = rows[0]
    # required 80 and 60, best choice 50 -> 50; the choice-only program gives 0
    assert (top.programs_total, top.programs_matched, top.potential_applicants_avg) == (2, 1, 25.0)
    assert top.matched_programs == "P1 Program" and top.rank_pos == 1


def test_failed_choice_drops_the_school(small):
    low = small["ege_school_subject_stat"].selectExpr(
        "* except (avg_score)", "if(subject_id in (3, 4), 10.00, avg_score) as avg_score"
    )
    tables = small.with_tables({"ege_school_subject_stat": low})
    assert rating.rate_schools(tables, RatingFilters(program_ids=(1,))).collect() == []


def test_rating_without_scope(small):
    rows = rating.rate_schools(small, RatingFilters(enforce_subject_threshold=False)).collect()
    assert [r.school_id for r in rows] == [1, 2]  # school 3 has no period
    assert all(r.potential_applicants_avg is None and r.score_part_potential == 0 for r in rows)
    assert abs(sum(getattr(rows[0], p) for p in rating.PARTS) - rows[0].rating_score) < 1e-5
    strict = rating.rate_schools(small, RatingFilters()).collect()
    assert [r.school_id for r in strict] == [1]  # 39.99 is below the pass mark


def test_search_and_rating_divide_differently(small):
    """Subjects 1 and 2 of school 2 lie in different years: no search hit, but a rating row."""
    both = (1, 2)
    found = search.search_schools(small, SchoolFilters(subject_ids=both), Page(5, 20))
    assert [r.school_id for r in found.rows.collect()] == [1] and found.total == 1 and found.page.number == 1
    rated = rating.rate_schools(small, RatingFilters(subject_ids=both, enforce_subject_threshold=False))
    assert sorted(r.school_id for r in rated.collect()) == [1, 2]


def test_save_and_delete(spark, small, tmp_path):
    filters, weights = RatingFilters(program_ids=(1,), region_id=1), RatingWeights()
    ranked = rating.rate_schools(small, filters, weights)
    saved = runs.save_rating(small, filters, weights, ranked, " me ", datetime(2024, 1, 1, tzinfo=timezone.utc))
    tables = saved.plan.preview(small)
    assert (saved.request_id, saved.run_id, len(saved.plan.changed(small))) == (1, 1, 10)
    metrics = {r.metric_code: (r.weight, r.is_primary) for r in tables["analytics_run_metric"].collect()}
    assert metrics["avg_score_all"] == (4, True) and metrics["threshold_share"] == (1, False)
    fresh, plan = runs.create_reports(tables, 1, "me", report_format="pdf")
    assert '"matched_programs":"P1 Program"' in fresh.first().report_payload
    tables = plan.preview(tables)
    assert runs.calc_history(tables).first().filter_summary == "program:1, region:1"
    assert runs.report_archive(tables).count() == 1
    sheets = runs.run_export(tables, 1)
    assert sheets["ranking"].first().avg_graduates_raw == Decimal("30.00")
    write_sheets({**sheets, "settings": filter_sheet(spark, {"ids": (2, 1)})}, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out" / "ranking"), header=True).count() == 1
    left = regions.delete_region(tables, "Край").preview(tables)
    for name in ("school", "ege_school_subject_stat", "analytics_rating_run", "analytics_run_metric"):
        assert left[name].count() == 0, name
    assert left["analytics_request"].count() == 1  # its program filter is still there
    assert regions.delete_region(tables, "?") is None
    assert regions.clear_analytics(tables).preview(tables)["analytics_request"].count() == 0


def test_merge_keeps_the_larger_figures(spark):
    tables = make(
        spark,
        region=[(1, "Край")],
        municipality=[(1, 1, "А")],
        school=[(1, 1, "(5) Школа одного", False), (2, 1, "(5)  школа одний", True), (3, 1, "(5) ШКОЛА-одного", True)],
        school_external_key=[(1, 1, "EGE", "x"), (2, 3, "EGE", "y")],
        ege_school_year=[(1, 1, 2022, "actual", 7), (2, 2, 2022, "actual", 10), (3, 3, 2021, "plan", 4)],
        ege_school_subject_stat=[(1, 1, 1, 7, 5), (2, 2, 1, 10, None), (3, 3, 1, 1, 1)],
    )
    plan = merging.merge_duplicate_schools(tables)
    merged = plan.preview(tables)
    assert [r.school_id for r in merged["school"].collect()] == [2]  # active first, then the lowest id
    stats = {
        r.ege_school_year_id: (r.participants_cnt, r.not_passed_cnt) for r in merged["ege_school_subject_stat"].collect()
    }
    assert stats == {2: (10, 5), 3: (1, 1)}
    assert merged["school_external_key"].count() == 0
    kept = merging.merge_duplicate_schools(tables, preserve_keys=True).preview(tables)
    assert [r.external_key for r in kept["school_external_key"].collect()] == ["x"]
    assert merging.remaining_duplicates(tables, plan).count() == 0


def test_integrity(spark, small):
    assert integrity.check_integrity(small, ["school", "ege_school_year", "ege_school_subject_stat"]).count() == 0
    broken = make(
        spark,
        analytics_request_filter=[(1, 1, "region", None, 5), (2, 1, "subject", None, None, None, None, None, 3)],
        analytics_run_metric=[(1, "a", 11, True), (1, "b", 2, True)],
        program_ege_requirement=[(1, 1, 1, "choice", 1)],
    )
    names = ["analytics_request_filter", "analytics_run_metric", "program_ege_requirement"]
    rules = {r.rule for r in integrity.check_integrity(broken, names).collect()}
    assert {"check:payload", "check:weight", "one_primary_metric", "check:weight1_required", "fk:request_id"} <= rules


def cells_of(spark, file, sheet, grid):
    rows = [(file, sheet, r, c, v) for r, line in enumerate(grid) for c, v in enumerate(line) if v is not None]
    return spark.createDataFrame(rows, CELL_SCHEMA)


def test_exam_sheet(spark, small):
    tables = small.with_tables({"ege_subject": subject_seed(spark)})
    head = ["Муниципальное образование", "Образовательная организация (школа)", "Всего выпускников, ЕГЭ"]
    grid = [
        ["Отчёт", None, None, None, None],
        [*head, "Физика", None, "Химия"],
        [None, None, None, "приняли участие", "Средний балл", "приняли участие"],
        [None, None, None, "чел", "балл", "чел"],
        ["г. А", "Школа 1", "12,0", "10", "50", "-"],
        [None, "Школа 1", "3", None, "80", "nan"],
        [None, "Всего", "15", "10", None, None],
        [None, "777", "15", "10", None, None],
        [None, "Неизвестная", "1", "1", None, None],
    ]
    cells = cells_of(spark, "Край.xlsx", "факт 2023", grid)
    roles = {(r.subject, r.metric): r.col_idx for r in exam_columns(cells, "actual").collect()}
    assert roles == {("Физика", "participants_cnt"): 3, ("Физика", "avg_score"): 4, ("Химия", "participants_cnt"): 5}
    plan = exam.load_exam_stats(tables, cells, exam.sheet_settings(cells, "2"))
    statuses = sorted(r.status for r in plan.reports["rows"].collect())
    assert statuses == ["matched", "matched", "not_found"]
    year = plan.tables["ege_school_year"].where("year = 2023").first()
    assert (year.school_id, year.kind, year.graduates_total) == (1, "actual", 15)
    stat = plan.tables["ege_school_subject_stat"].where(f"ege_school_year_id = {year.ege_school_year_id}").collect()
    assert [(s.subject_id, s.participants_cnt, s.avg_score, s.chosen_cnt) for s in stat] == [(3, 10, Decimal("52.73"), 10)]


def test_region_names(spark, small):
    names = spark.createDataFrame([("край",), ("Край 2023",), ("ра",), ("?",)], "region string")
    got = {r.region: r.region_name for r in exam.resolve_regions(small, names).collect()}
    assert got == {"край": "Край", "Край 2023": "Край", "ра": "Край", "?": None}


def test_sanitize(spark):
    schema = "participants_cnt int, not_passed_cnt int, high_80_99_cnt int, score_100_cnt int, avg_score decimal(5,2), chosen_cnt int"
    rows = [(None, 3, 5, 1, d("50"), None), (4, 9, 0, 0, d("50"), 4), (0, 0, 0, None, d("0.00"), None)]
    got = [tuple(r)[:5] for r in exam.sanitize(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(5, 3, 5, 1, d("50.00")), (4, 4, 0, 0, d("50.00")), (0, 0, 0, None, None)]


def test_directory_sheet(spark):
    grid = [
        [None, "Список"],
        ["Муниципальное образование", "Образовательная организация (школа)", "Профиль (при наличии)"],
        ["г.Артем", "(7) Школа Ёлка", "универсальный; нет"],
        [None, "(7) школа елка", "Физико математический"],
        ["Всего", "2", None],
    ]
    cells = cells_of(spark, "Приморский_край.xlsx", "1", grid)
    first = directory.load_school_directory(Tables(spark), cells)
    tables = first.preview(Tables(spark))
    assert [r.name for r in tables["municipality"].collect()] == ["город Артем"]
    assert [r.full_name for r in tables["school"].collect()] == ["7 ШКОЛА ЕЛКА"]
    assert sorted(r.name for r in tables["school_profile"].collect()) == ["универсальный", "физико-математический"]
    again = directory.load_school_directory(tables, cells)
    assert all(before == after for before, after in again.row_counts(tables).values())


def test_program_sheet(spark):
    titles = list(programs.HEADINGS.values())
    grid = [
        titles,
        ["ИНТПМ", "01.03.02", "Прикладная математика", "Математика", "Физика", "Русский язык"],
        [None, None, None, None, "или", None],
        [None, None, None, None, "Информатика", None],
        [None, None, None, None, "математика", None],
        ["ПИ", "01.03.02", "Повтор", "История", None, None],
    ]
    cells = cells_of(spark, "p.xlsx", "1", grid)
    tables = programs.load_programs(Tables(spark), cells).preview(Tables(spark))
    program = tables["study_program"].first()
    assert (program.institute_id, program.name, program.is_active) == (4, "Прикладная математика", True)
    roles = {r.subject_id: (r.role, r.weight) for r in tables["program_ege_requirement"].collect()}
    required, choice = ("required", 1), ("choice", 2)
    assert roles == {2: required, 1: required, 3: choice, 6: choice, 5: required}
    with pytest.raises(ValueError, match="missing columns"):
        programs.load_programs(Tables(spark), cells.where("not (row_idx = 0 and col_idx = 1)"))
    bad = spark.createDataFrame([(1, "a", "x"), (2, "b", "101")], "subject_id int, name string, score string")
    rejected = programs.update_min_scores(tables, bad)
    assert not rejected.tables and rejected.reports["errors"].count() == 2
    assert [r.min_passing_score for r in pass_marks(tables).collect()][:3] == [40, 40, 41]
