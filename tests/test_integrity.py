"""Typed keys, and the integrity of a change against the full check."""

from datetime import date

import pytest

from edurank.operators import integrity, merging
from edurank.plans.change import ChangePlan
from edurank.sources.schema import struct_type
from test_operators import d, make


@pytest.fixture(scope="module")
def tables(spark):
    """Schools 1, 5 and 6 are one; school 6 brings what breaks rules, school 3 does so by itself."""
    return make(
        spark,
        region=[(1, "Край")],
        municipality=[(1, 1, "город А")],
        school=[(1, 1, "Школа 1", True), (2, 1, "Школа 2", True), (3, 1, "Школа 3", True), (5, 1, "школа 1", False), (6, 1, "ШКОЛА 1", False)],
        school_external_key=[(1, 1, "EGE", "a|b", "x"), (2, 2, "ONE_C", "k", "x"), (3, 3, "ONE_C", "k", "x"), (4, 3, "NONE", "z", "x")],
        school_profile=[(1, "P")],
        school_profile_link=[(5, 1), (6, 9), (3, 8)],
        ege_subject=[(1, "S", d(40))],
        institute=[(1, "I")],
        ege_school_year=[(1, 1, 2020, "actual", 10), (2, 6, 2020, "actual", 3), (3, 6, 1990, "plan", -4), (4, 3, 1980, "plan", 1), (5, 77, 2020, "plan", 1)],
        ege_school_subject_stat=[(1, 1, 1, 5, 9, 0, 0, d("50.00"), 1), (2, 2, 1, 6, 1, 0, 0, d("50.00"), 1), (3, 4, 1, 5, 9, 0, 0, d("50.00"), 1)],
        prof_event=[(1, 6, 44, date(2020, 1, 1), -1), (2, 3, 45, date(2020, 1, 1), -1), (3, 78, 1, None, 1)],
    )


def rows(df):
    return {(r.table_name, r.rule, r.row_key): r.row_count for r in df.collect()}


def test_keys_are_typed(spark):
    values = [(1, 1, "a|b", "c", "x"), (2, 2, "a", "b|c", "x"), (3, 3, "EGE", "q", "x"), (4, 4, "EGE", "q", "x")]
    found = rows(integrity.check_integrity(make(spark, school_external_key=values, school=[(i, 1, f"S{i}", True) for i in range(1, 5)]), ["school_external_key"]))
    assert found == {
        ("school_external_key", "unique:source_name,external_key", "EGE|q"): 2,
        ("school_external_key", "check:source", "1"): 1,
        ("school_external_key", "check:source", "2"): 1,
    }


def test_null_ids_of_a_filter_are_equal_and_empty_texts_are_no_nulls(spark):
    item = [(i, 7, "region", 3) for i in (1, 2)] + [(3, 7, "region", None), (4, 7, None, 3), (5, 7, "", 3)]
    found = rows(integrity.check_integrity(make(spark, analytics_request_filter=item), ["analytics_request_filter"]))
    repeated = {k[2]: n for k, n in found.items() if k[1] == "unique:item"}
    assert repeated == {"7|region|3||||||": 2}


def full_restricted(tables, plan, keys):
    """The full check of the new state, only of keys named by (table, rule) -> row keys."""
    return {k: n for k, n in rows(integrity.check_integrity(plan.preview(tables))).items() if k in keys}


def test_a_merge_is_judged_by_its_rows(tables):
    plan = merging.merge_duplicate_schools(tables)
    assert sorted(tuple(r) for r in plan.reports["merge_map"].collect()) == [(5, 1), (6, 1)]
    found = rows(integrity.check_change(tables, plan))
    whole = rows(integrity.check_integrity(plan.preview(tables)))
    # What school 3 and the rows without a school break is not the merge's doing.
    assert found == {
        ("school_profile_link", "fk:profile_id", "9"): 1,
        ("ege_school_year", "check:year", "3"): 1,
        ("ege_school_year", "check:graduates", "3"): 1,
        ("ege_school_subject_stat", "check:not_passed_le_participants", "1"): 1,
        ("prof_event", "fk:institute_id", "44"): 1,
        ("prof_event", "check:coverage", "1"): 1,
    }
    assert found.items() <= whole.items() and len(whole) > len(found)


def test_children_left_behind_are_found(spark, tables):
    school = tables["school"].where("school_id <> 3")
    plan = ChangePlan({"school": school})
    found = rows(integrity.check_change(tables, plan))
    assert found == {
        (t, "fk:school_id", "3"): n
        for t, n in (("school_external_key", 2), ("school_profile_link", 1), ("ege_school_year", 1), ("prof_event", 1))
    }
    named = ChangePlan({"school": school}, touched={"school": ("school_id", spark.range(3, 4))})
    assert rows(integrity.check_change(tables, named)) == found


def test_appended_rows_are_judged_against_all(spark, tables):
    more = spark.createDataFrame([(9, 1, "EGE", "new", "x"), (10, 2, "EGE", "a|b", "x"), (2, 3, "EGE", "new2", "x")], struct_type("school_external_key"))
    found = rows(integrity.check_change(tables, ChangePlan({}, appended={"school_external_key": more})))
    assert found == {
        ("school_external_key", "unique:source_name,external_key", "EGE|a|b"): 2,
        ("school_external_key", "unique:school_id,source_name", "1|EGE"): 2,
        ("school_external_key", "primary_key", "2"): 2,
    }


def test_large_changes_are_judged_alike(tables, monkeypatch):
    plan = merging.merge_duplicate_schools(tables)
    few = ChangePlan({n: plan.tables[n] for n in ("school", "school_profile_link")}, touched=plan.touched)
    small = rows(integrity.check_change(tables, few))
    monkeypatch.setattr(integrity, "BROADCAST_BYTES", 0)
    assert rows(integrity.check_change(tables, few)) == small and ("school_profile_link", "fk:profile_id", "9") in small


def test_dry_run_counts_in_one_job_a_table(spark, tables):
    plan = merging.merge_duplicate_schools(tables)
    tracker, group = spark.sparkContext.statusTracker(), "dry-run"
    spark.sparkContext.setJobGroup(group, "dry run")
    try:
        counts = ChangePlan({"school": plan.tables["school"]}).row_counts(tables)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts == {"school": (5, 3)}
    assert len(tracker.getJobIdsForGroup(group)) >= 1
    some = ("ege_school_year", "prof_event", "analytics_school_card")
    expected = {n: (tables[n].count(), plan.tables[n].count()) for n in some}
    assert ChangePlan({n: plan.tables[n] for n in some}).row_counts(tables) == expected
