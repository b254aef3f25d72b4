"""Long texts are attached last: no row is shuffled with the names of its programs."""

from pyspark.sql import functions as F

from edurank.operators import rating, runs
from edurank.plans import joins
from edurank.plans.materialize import materialize
from edurank.plans.params import RatingFilters, RatingWeights
from edurank.plans.texts import REF, attach_texts, by_reference
from test_operators import small  # noqa: F401

SCOPE = RatingFilters(institute_ids=(1,), enforce_subject_threshold=False)


def shuffled(df) -> list[set[str]]:
    """Columns of every exchange of the plan that is not a broadcast."""
    found, todo = [], [df._jdf.queryExecution().executedPlan().inputPlan()]
    while todo:
        node = todo.pop()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "Exchange":
            found.append({a.split("#")[0] for a in node.output().mkString("\n").split("\n")})
    return found


def test_rows_of_a_text(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "c"), (3, None), (4, "")], "k long, t string")
    marked, texts = by_reference(rows, "t", ["k"])
    assert sorted(r["_text"] for r in texts.collect()) == ["", "a", "b", "c"]
    short = marked.drop("t")
    for limit in (1 << 20, 0):
        long = attach_texts(short, texts, REF, [F.desc("_ref"), F.col("k")], limit)
        expected = marked.orderBy(F.desc("_ref"), "k").select("k", "t").collect()
        assert [tuple(r) for r in long.select("k", "_text").collect()] == [tuple(r) for r in expected]
        plain = attach_texts(short, texts, REF, limit_bytes=limit).select("k", "_text").collect()
        assert sorted(map(str, plain)) == sorted(str(r).replace("t=", "_text=") for r in expected)


def test_names_are_not_shuffled(small):  # noqa: F811
    ranked = rating.rate_schools(small, SCOPE, RatingWeights())
    carried = [c for columns in shuffled(ranked) for c in columns]
    assert carried and not {"matched_programs", "label"} & set(carried)
    saved = runs.save_rating(small, SCOPE, RatingWeights(), ranked, "me")
    log = saved.plan.preview(small)
    ranking = runs.run_ranking(log, 1)
    fresh, _ = runs.create_reports(log, 1, "me")
    for df in (ranking, fresh):
        columns = set().union(*shuffled(df))
        assert columns and not {"matched_programs", "_text", "payload", "report_payload"} & columns
    assert [r.matched_programs for r in ranking.collect()] == [r.matched_programs for r in ranked.collect()]


def test_equal_plans_share_a_text(spark):
    matches = spark.createDataFrame(
        [(1, 7, "1.00"), (1, 5, "2.00"), (2, 5, "1.00"), (2, 7, "3.00"), (3, 7, "0.00"), (None, 7, "1.00"), (4, 9, "1.00")],
        "school_id long, plan_id long, p string",
    ).selectExpr("school_id", "plan_id", "cast(p as decimal(14,2)) as potential_applicants")
    programs = spark.createDataFrame(
        [(1, 7, "A", "n2"), (2, 5, None, "n1"), (3, 7, "", "n0"), (3, 7, "", "n0"), (4, 5, "B", None)],
        "program_id long, plan_id long, code string, program_name string",
    )
    got = {r.school_id: r.matched_programs for r in rating.matched_program_names(matches, programs).collect()}
    assert got == {1: "n0; n0; n1; A n2", 2: "n0; n0; n1; A n2", None: "n0; n0; A n2"}
    assert rating.plan_names(rating.matched_plans(matches), programs).count() == 2


def test_small_files_of_many_rows_are_not_broadcast(spark, monkeypatch):
    dim = spark.range(300_000).selectExpr("id % 3 as k", "repeat('x', 200) as v")
    assert joins.stored_bytes(materialize(dim)) < joins.BROADCAST_BYTES
    assert joins.memory_bytes(materialize(dim)) > 300_000 * 200
    monkeypatch.setattr(joins, "MEMORY_BYTES", 1 << 20)
    monkeypatch.setattr(joins, "SMALL_BYTES", 0)
    fact = spark.range(3).selectExpr("id as k")
    joined = joins.join_few_keys(fact, dim, ["k"], F.col("k"), salts=2)
    assert "_salt" in joined._jdf.queryExecution().analyzed().toString()


def test_masks_join_programs_last(spark, monkeypatch):
    """What is copied to the executors is one row per set and plan, or per program, never per set and program."""
    from edurank.workload import analytics_queries as queries

    copied = []

    def spy(fact, dim, *args, **kwargs):
        copied.append(set(dim.columns))
        return joins.join_few_keys(fact, dim, *args, **kwargs)

    monkeypatch.setattr(queries, "join_few_keys", spy)
    from edurank.workload.views import domain

    queries._division_masks(domain(spark, "/root/testdata/sf0.001"))
    assert copied and not [c for c in copied if {"reached", "program_id"} <= c]


def test_many_long_texts_lie_together(spark, monkeypatch):
    """Beyond a size rows are dealt by their text: no row is sorted or shuffled with it, and a task holds few texts."""
    from edurank.plans import texts as module

    monkeypatch.setattr(module, "TASK_BYTES", 4_000_000)
    rows = spark.range(20_000).selectExpr("if(id % 9 = 0, null, id) as k", "if(id % 11 = 0, null, repeat(cast(id % 4 as string), 1000)) as t", "map('a', id) as m")
    rows = rows.unionByName(rows.where("k < 50"))
    marked, found = by_reference(rows, "t", ["k"])
    short = marked.drop("t")
    expected = sorted(map(str, marked.select("k", "t", "m").collect()))
    for limit in (1 << 20, 0):
        long = attach_texts(short, found, REF, [F.col("k")], limit, laid_bytes=1 << 20)
        nodes, todo = [], [long._jdf.queryExecution().executedPlan().inputPlan()]
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            nodes.append(node.nodeName())
        wide = [columns for columns in shuffled(long) if {"k", "_text"} <= columns]
        assert not wide and "Exchange" in nodes
        assert sorted(map(str, long.selectExpr("k", "_text as t", "m").collect())) == expected
        per_task = long.groupBy(F.spark_partition_id()).agg(F.countDistinct("_text").alias("n")).collect()
        assert sum(r.n for r in per_task) <= 3 * 4 + 4  # at most the splits of each text
    # Rows with maps can be dealt by salts, too, and stay in order below the size.
    assert [r.k for r in attach_texts(short, found, REF, [F.col("k")], 0, laid_bytes=1 << 40).collect()] == [r.k for r in rows.orderBy("k").collect()]
