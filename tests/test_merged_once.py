"""A merge cleans names once, in all tasks, and works out the rows it moves once."""

import pytest

from edurank.operators import duplicates, integrity, merging
from edurank.sources.schema import struct_type
from edurank.sources.store import Tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark):
    rows = {
        "region": [{"region_id": 1, "name": "R"}],
        "municipality": [{"municipality_id": 1, "region_id": 1, "name": "M"}],
        "school": [{"school_id": i, "municipality_id": 1, "full_name": "(1) School" if i < 3 else "(2) Other", "is_active": True} for i in (1, 2, 3)],
        "ege_school_year": [{"ege_school_year_id": 10 * i, "school_id": i, "year": 2020, "kind": "actual", "graduates_total": i} for i in (1, 2, 3)],
        "ege_school_subject_stat": [
            {"ege_school_subject_stat_id": n, "ege_school_year_id": y, "subject_id": 1, "participants_cnt": n} for n, y in enumerate((10, 20, 30, 30, None))
        ],
    }
    frames = {n: spark.createDataFrame([tuple(r.get(f) for f in struct_type(n).fieldNames()) for r in found], struct_type(n)) for n, found in rows.items()}
    return Tables(spark, frames)


def test_names_are_cleaned_once(tables):
    assert "regexp" not in plan_of(duplicates.merge_map(tables))
    assert duplicates.keyed_schools(tables).rdd.getNumPartitions() >= tables.spark.sparkContext.defaultParallelism


def test_moved_rows_are_worked_out_once(tables):
    plan = merging.merge_duplicate_schools(tables)
    stats = plan.tables["ege_school_subject_stat"]
    assert "Join" not in plan_of(stats) and "Join" not in plan_of(plan.tables["ege_school_year"])
    found = sorted(((r.ege_school_year_id or 0, r.participants_cnt) for r in stats.collect()))
    # Rows of schools that stay are kept as they are, repeated and without a key.
    assert found == [(0, 4), (10, 1), (30, 2), (30, 3)]
    assert plan.tables["ege_school_subject_stat"] is stats


def test_a_change_is_worked_out_once_for_its_check(tables, monkeypatch):
    made = []
    collapse = merging.collapse
    monkeypatch.setattr(merging, "collapse", lambda *given: made.append(given) or collapse(*given))
    plan = merging.merge_duplicate_schools(tables)
    eager = len(made)
    found = integrity.check_change(tables, plan)
    assert eager == 2 and "min_by" not in plan_of(found)
