"""Facts derived from the base tables: dealt by their number of rows, joined once, never by a key of few values."""

import datetime
import re

import pytest

from edurank.workload import ingest_queries, views

DAY = datetime.datetime(1996, 5, 1)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def folder(spark, tmp_path):
    """Base tables with null and repeated keys."""
    orders = [(o, o % 4 if o % 7 else None, "OFP"[o % 3], 1.0, DAY.replace(year=1995 + o % 3), "1") for o in range(40)] + [(3, 2, "O", 1.0, DAY, "1"), (None, 1, "F", 1.0, DAY, "1")]
    lines = [(o % 45 if o % 11 else None, o, 1, 1, float(o % 9), 1.0, o % 5 / 10, 0.0, "RAN"[o % 3], "O", DAY) for o in range(200)]
    lines += [*lines[:9], (5, None, 1, 1, None, 1.0, None, 0.0, None, None, None)]
    rows = {
        "region": [(0, "AFRICA")],
        "nation": [(0, "ALGERIA", 0)],
        "customer": [(c, f"Customer {c}", 0, 1.0, "AUTO") for c in range(4)],
        "part": [(p, "part", "b", "t", 1, 1.0) for p in range(22)],
        "orders": orders,
        "lineitem": lines,
    }
    for name, found in rows.items():
        spark.createDataFrame(found, views.BASE_SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["f_year", "f_admission", "f_stat_sums"])
def test_dealt_views_have_the_rows_of_their_statement(spark, folder, monkeypatch, name):
    monkeypatch.setattr(views, "TASK_ROWS", 20)
    needs, text = views.VIEWS[name]
    frames = {n: spark.read.schema(views.BASE_SCHEMAS[n]).parquet(f"{folder}/{n}.parquet") for n in needs}
    for n in needs:
        text = views._replace_relation(text, n)
    plain = spark.sql(text, **frames)
    got = views.view(spark, folder, name)
    assert got.dtypes == plain.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_tasks_grow_with_the_rows(spark, folder, monkeypatch):
    """Before, sizes of files decided: many short rows were a few tasks of a gigabyte each."""
    for rows, tasks in ((20, 11), (10, 21)):
        monkeypatch.setattr(views, "TASK_ROWS", rows)
        plan = plan_of(views.view(spark, folder, "f_stat"))
        assert re.search(rf"hashpartitioning\(ege_school_year_id#\d+L, {tasks}\)", plan)


def test_subjects_are_not_a_key_of_tasks(spark, folder):
    plan = plan_of(ingest_queries._wide_long(views.domain(spark, folder)))
    assert "hashpartitioning(subject_id" not in plan


def test_exam_cells_read_the_facts_once(spark, folder):
    cells = ingest_queries.exam_cells(views.domain(spark, folder))
    scans = re.findall(r"FileScan parquet \[[^\]]*l_partkey", plan_of(cells).split("== Initial Plan ==")[0])
    assert len(scans) == 1
    kinds = {r.sheet.split()[0] for r in cells.where("row_idx >= 10 and col_idx > 2").collect()}
    assert kinds == {"plan", "actual"}
