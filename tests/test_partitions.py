"""Partitioned tables: what a change leaves alone, what it rewrites, and unfinished commits."""

import os
import shutil
from datetime import date

import pytest
from pyspark.sql import functions as F

from edurank.operators import merging, regions
from edurank.plans.change import ChangePlan
from edurank.sources.partitions import BY_PARENT, BY_SCHOOL, PartitionedStore, partition_columns
from edurank.sources.schema import SCHEMAS, struct_type
from test_operators import d, make


@pytest.fixture(scope="module")
def tables(spark):
    """Two regions with a pair of duplicates each; region 2 has a year of its own."""
    return make(
        spark,
        region=[(1, "Край"), (2, "Область"), (3, "Пустая")],
        municipality=[(1, 1, "город А"), (2, 2, "город Б")],
        school=[(i, 1 + (i > 3), f"Школа {i % 3}", i != 3) for i in (1, 2, 3)]
        + [(4, 2, "Школа 5", True), (5, 2, "школа 5", True), (6, 2, "Школа 6", True), (7, 1, "школа 1", True)],
        school_profile=[(1, "P")],
        school_profile_link=[(1, 1), (7, 1), (5, 1)],
        ege_subject=[(1, "S", d(40))],
        ege_school_year=[
            (1, 1, 2020, "actual", 10), (2, 7, 2020, "actual", 30), (3, 2, 2021, "actual", 5), (4, 4, 2020, "actual", 7),
            (5, 5, 2020, "actual", 9), (6, 6, 2022, "plan", 1), (7, 7, 2022, "actual", 3), (8, 99, 2020, "plan", 2),
        ],
        ege_school_subject_stat=[(i, i, 1, i, 0, 0, 0, d("50.00"), 1) for i in range(1, 8)],
        school_admission_stat=[(1, 1, 2020, 5, 1), (2, 7, 2020, 6, 2), (3, 4, 2021, 1, 0)],
        school_admission_detail=[(1, 1, 1, 1, 1), (2, 2, 1, 3, 1), (3, 3, 1, 1, 0)],
        prof_event=[(1, 7, None, date(2020, 1, 1), 4), (2, 1, None, None, 4), (3, 5, None, date(2021, 2, 2), 4)],
    )


def files(store) -> dict[str, int]:
    found = {}
    for folder, _, names in os.walk(store.root):
        for name in names:
            if name.startswith("part-"):
                path = os.path.join(folder, name)
                found[os.path.relpath(path, store.root)] = os.stat(path).st_mtime_ns
    return found


def content(tables):
    return {n: sorted(map(repr, map(tuple, tables[n].collect()))) for n in tables._frames if tables[n].take(1)}


@pytest.fixture(scope="module")
def written(spark, tables, tmp_path_factory):
    store = PartitionedStore(spark, str(tmp_path_factory.mktemp("partitions") / "store"))
    store.commit({name: tables[name] for name in tables._frames})
    return store


@pytest.fixture
def store(spark, written, tmp_path):
    shutil.copytree(written.root, tmp_path / "store")
    return PartitionedStore(spark, str(tmp_path / "store"))


def test_tables_come_back(store, tables):
    assert content(store.load()) == content(tables)
    assert all(partition_columns(n) for n in (*BY_SCHOOL, *BY_PARENT))
    own = store.only(2).load()
    assert sorted(r.school_id for r in own["school"].collect()) == [4, 5, 6]
    assert sorted(r.ege_school_subject_stat_id for r in own["ege_school_subject_stat"].collect()) == [4, 5, 6]
    plan = own["ege_school_year"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part_region" in plan


def test_a_merge_in_one_region_leaves_the_files_of_others(store, tables):
    before = files(store)
    plan = merging.merge_duplicate_schools(store.only(1).load())
    assert [tuple(r) for r in plan.reports["merge_map"].collect()] == [(7, 1)]
    touched = plan.apply(store.only(1))
    after = files(store)
    kept = set(before) & set(after)
    assert all(before[f] == after[f] for f in kept)
    assert {f for f in before if "part_region=1" not in f} <= kept
    # Of region 1, years without a moved school stay as well, and so do dictionaries.
    assert {f for f in before if "part_region=1/part_year=2021" in f and f.startswith("ege")} <= kept
    assert {os.path.dirname(f) for f in set(before) - kept} == {
        "school/part_region=1", "school_profile_link/part_region=1",
        *(f"{t}/part_region=1/part_year=2020" for t in ("ege_school_year", "ege_school_subject_stat", "prof_event")),
        *(f"{t}/part_region=1/part_year=2020" for t in ("school_admission_stat", "school_admission_detail")),
        *(f"{t}/part_region=1/part_year=2022" for t in ("ege_school_year",)),
    }
    assert {(t.table_name, t.part_region) for t in touched} == {(os.path.dirname(f).split("/")[0], 1) for f in set(before) - kept}
    whole = merging.merge_duplicate_schools(tables, region="Край").preview(tables)
    assert content(store.load()) == content(whole)


def test_deleting_a_region_drops_its_folders(store, tables):
    before = files(store)
    state = store.load()
    plan = regions.delete_region(state, "Край")
    plan.apply(store)
    after = files(store)
    assert not [f for f in after if "part_region=1" in f]
    assert {f for f in before if "part_region=2" in f} <= set(after)
    assert content(store.load()) == content(regions.delete_region(tables, "Край").preview(tables))


def test_upsert_reads_and_writes_its_partitions(store, tables):
    rows = [(1, 2020, "actual", 77), (7, 2022, "actual", 3), (6, 2030, "plan", 8), (6, 2022, "actual", 4)]
    source = store.spark.createDataFrame(rows, "school_id bigint, year int, kind string, graduates_total int")
    before = files(store)
    touched = store.upsert("ege_school_year", source, ["school_id", "year", "kind"], ["graduates_total"])
    assert {(t.part_region, t.part_year) for t in touched} == {(1, 2020), (2, 2030), (2, 2022)}
    after = files(store)
    gone = {os.path.dirname(f) for f in set(before) - set(after)}
    assert gone == {"ege_school_year/part_region=1/part_year=2020", "ege_school_year/part_region=2/part_year=2022"}
    years = {r[1:4]: (r[0], r[4]) for r in map(tuple, store.load()["ege_school_year"].collect())}
    old = {r[1:4]: (r[0], r[4]) for r in map(tuple, tables["ege_school_year"].collect())}
    assert years[1, 2020, "actual"] == (1, 77)
    fresh = {(6, 2030, "plan"), (6, 2022, "actual")}
    assert {years[k][0] for k in fresh} == {9, 10} and {years[k][1] for k in fresh} == {8, 4}
    assert {k: v for k, v in years.items() if k not in fresh and k != (1, 2020, "actual")} == {
        k: v for k, v in old.items() if k != (1, 2020, "actual")
    }


def test_moving_a_school_touches_both_regions(store):
    school = store.load()["school"].withColumn("municipality_id", F.expr("if(school_id = 6, 1L, municipality_id)"))
    now = store.load()
    dependent = {n: now[n] for n in ("school", "ege_school_year", "ege_school_subject_stat")}
    touched = ChangePlan({**dependent, "school": school}).apply(store)
    assert {(t.table_name, t.part_region, t.part_year) for t in touched} == {
        *(("school", r, None) for r in (1, 2)),
        *((t, r, 2022) for t in ("ege_school_year", "ege_school_subject_stat") for r in (1, 2)),
    }
    assert sorted(r.school_id for r in store.only(1).load()["ege_school_year"].where("year = 2022").collect()) == [6, 7]


def test_same_content_writes_nothing_and_rows_are_added(store, tables):
    before = files(store)
    now = store.load()
    assert store.commit({n: now[n] for n in ("school", "ege_school_year", "ege_subject")}) == []
    assert files(store) == before
    more = store.spark.createDataFrame([(9, 4, 2031, "plan", 1)], struct_type("ege_school_year"))
    (one,) = store.commit({}, appended={"ege_school_year": more})
    assert (one.part_region, one.part_year, one.rows_before, one.rows_after) == (2, 2031, 0, 1)
    assert set(before) < set(files(store))


def test_a_commit_that_was_cut_off_is_finished(store, monkeypatch):
    now = store.load()
    plan = merging.merge_duplicate_schools(now, region="Край")
    expected = content(plan.preview(now))
    monkeypatch.setattr(PartitionedStore, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        plan.apply(store)
    monkeypatch.undo()
    # A stage without its list never became a commit.
    os.makedirs(f"{store.root}/_stage/unfinished/school")
    assert content(store.load()) == expected
    assert os.listdir(f"{store.root}/_stage") == ["unfinished"]
