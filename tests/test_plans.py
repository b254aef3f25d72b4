import pytest
from pyspark.sql import functions as F

from edurank.plans.joins import join_few_keys
from edurank.plans.ordered import forward_fill
from edurank.plans.paging import page_rows, with_row_number
from edurank.plans.params import Page, RatingFilters, RatingWeights, guess_year_basis, normalize_query
from edurank.sources.schema import struct_type
from edurank.sources.store import CommitConflict, Tables, TableStore, assign_ids, delete_by_key, insert_absent, upsert, upsert_with_ids


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_broadcast_join(spark, how):
    fact = spark.range(500).selectExpr("id", "if(id % 3 = 0, 0, id % 7) as k")
    dim = spark.createDataFrame([(0, "a"), (0, "b"), (3, "c")], "k bigint, v string")
    plain = join_few_keys(fact, dim, ["k"], F.col("id"), how)
    salted = join_few_keys(fact, dim, ["k"], F.col("id"), how, limit_bytes=0, salts=5)
    assert sorted(map(str, plain.collect())) == sorted(map(str, salted.select(*plain.columns).collect()))


def test_row_numbers_and_deep_pages(spark):
    df = spark.range(2000).selectExpr("id", "pmod(id * 7919, 2003) as x")
    order = [F.col("x").asc(), F.col("id").asc()]
    numbered = [r.id for r in with_row_number(df, order, "rn").orderBy("rn").collect()]
    assert numbered == [r.id for r in df.orderBy(*order).collect()]
    shallow = page_rows(df, order, 900, 20).collect()
    deep = page_rows(df, order, 900, 20, top_n=10).collect()
    assert [r.id for r in shallow] == sorted((r.id for r in deep), key=numbered.index)


def test_forward_fill_crosses_blocks(spark):
    df = spark.range(1000).selectExpr("'s' as k", "id as o", "if(id % 97 = 5, id, null) as v")
    filled = forward_fill(df, ["k"], "o", ["v"], block=10).orderBy("o").collect()
    last = None
    for row in filled:
        last = row.o if row.o % 97 == 5 else last
        assert row.v == last


def test_parameters():
    assert RatingWeights(0, 0, 0, 0).normalized() == RatingWeights()
    assert RatingWeights(-1, 1, 0, 1).normalized() == RatingWeights(0, 0.5, 0, 0.5)
    unscoped = RatingWeights().effective(has_scope=False)
    assert unscoped.match_share == 0 and abs(unscoped.graduates + unscoped.avg_score + unscoped.threshold_share - 1) < 1e-12
    assert [RatingFilters(limit=n).validated().limit for n in (1, 9999, None)] == [10, 2000, 300] and RatingFilters().limit is None
    checked = RatingFilters(min_graduates=-3, min_avg_score=300).validated()
    assert (checked.min_graduates, checked.min_avg_score) == (0, 100)
    assert normalize_query("  Ёлка   %А ") == "елка %а"
    assert Page(9, 10).clamped(35) == Page(4, 10) and Page(1, 500).limit == 500
    assert Page(0, 500).validated() == Page(1, 200) and Page(1, 2).validated().limit == 5
    assert guess_year_basis(None, 1990) == 2000 and guess_year_basis(2020, 2015) == 2020


def test_ids_are_dense_and_repeatable(spark):
    old = spark.createDataFrame([(41, "z")], "id bigint, name string")
    new = spark.range(500).selectExpr("concat('n', id) as name")
    first = assign_ids(new, old, "id", ["name"]).orderBy("name").collect()
    again = assign_ids(new.repartition(7), old, "id", ["name"]).orderBy("name").collect()
    assert [tuple(r) for r in first] == [tuple(r) for r in again]
    assert sorted(r.id for r in first) == list(range(42, 542))


def test_table_changes(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, keep string, v int")
    source = spark.createDataFrame([(2, 21), (3, 30)], "k int, v int")
    assert sorted(map(tuple, upsert(target, source, ["k"], ["v"]).collect())) == [(1, "a", 10), (2, "b", 21), (3, None, 30)]
    twice = source.unionByName(source)
    assert [tuple(r) for r in insert_absent(target, twice, ["k"]).collect()] == [(3, 30)]
    assert [r.k for r in delete_by_key(target, source, ["k"]).collect()] == [1]


def test_store_round_trip(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    regions = spark.createDataFrame([(1, "A")], struct_type("region"))
    store.commit({"region": regions})
    tables = store.load()
    assert tables["region"].collect() == regions.collect() and tables["school"].count() == 0
    names = spark.createDataFrame([("A",), ("B",)], "name string")
    store.commit({"region": upsert_with_ids("region", tables, names, ["name"], [])})
    assert sorted(map(tuple, store.load()["region"].collect())) == [(1, "A"), (2, "B")]
    assert tables["region"].count() == 1  # the old version stays readable
    assert len(Tables(spark)) == 26


def test_commits_do_not_lose_updates(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    one, two = (spark.createDataFrame([(i, n)], struct_type("region")) for i, n in ((1, "A"), (2, "B")))
    first = store.commit({"region": one})
    institute = spark.createDataFrame([(7, "I")], struct_type("institute"))
    store.commit({"region": one.unionByName(two)}, base=first)
    # another table was changed in between: both changes stay
    store.commit({"institute": institute}, base=first)
    assert store.load()["region"].count() == 2 and store.load()["institute"].count() == 1
    with pytest.raises(CommitConflict):
        store.commit({"region": two}, base=first)
    assert store.load()["region"].count() == 2


def test_appends_write_only_new_files(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    base = store.commit({"region": spark.createDataFrame([(1, "A")], struct_type("region"))})
    for i in (2, 3):  # appends bear each other
        store.commit({}, appended={"region": spark.createDataFrame([(i, "x")], struct_type("region"))}, base=base)
    assert sorted(r.region_id for r in store.load()["region"].collect()) == [1, 2, 3]
    folders = store.manifest()["region"]
    assert len(folders) == 3 and folders[:1] == store.manifest(base)["region"]
    with pytest.raises(CommitConflict):
        store.commit({"region": spark.createDataFrame([], struct_type("region"))}, base=base)


def test_saves_at_the_same_time_get_keys_of_their_own(spark, tmp_path):
    from datetime import datetime, timezone

    from edurank.operators import runs
    from edurank.plans.params import Page, SchoolFilters

    store = TableStore(spark, str(tmp_path / "store"))
    store.commit({"region": spark.createDataFrame([(1, "A")], struct_type("region"))})
    shown = "school_id bigint, full_name string, last_year int, avg_score double"
    pages = {who: spark.createDataFrame([(i, f"S{i}", 2020, 50.0) for i in ids], shown) for who, ids in (("a", (1, 2)), ("b", (2, 3)))}

    def saving(who, between=lambda: None):
        def make(tables):
            saved = runs.save_search(tables, SchoolFilters(q=who, region_id=1), pages[who], 2, Page(1, 20), who, datetime(2024, 1, 1, tzinfo=timezone.utc))
            between()
            return saved

        return make

    # b saves between a's planning and a's commit: planned keys are taken, the plan conflicts
    late = saving("a")(store.load())
    assert runs.save_on_newest(store, saving("b")).request_id == late.request_id == 1
    with pytest.raises(CommitConflict):
        late.plan.apply(store)
    # saved on the newest tables, with b coming between once more
    more = [saving("b")]

    def once():
        if more:
            runs.save_on_newest(store, more.pop())

    assert runs.save_on_newest(store, saving("a", once)).request_id == 3
    tables = store.load()
    assert sorted((r.request_id, r.created_by) for r in tables["analytics_request"].collect()) == [(1, "b"), (2, "b"), (3, "a")]
    chosen = sorted((r.request_id, r.school_id) for r in tables["analytics_school_selection"].collect())
    assert chosen == [(1, 2), (1, 3), (2, 2), (2, 3), (3, 1), (3, 2)]
    assert sorted(r.filter_id for r in tables["analytics_request_filter"].collect()) == [1, 2, 3]


def test_forward_fill_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, None), ("s", 3, None)], "k string, o int, v string")
    got = sorted((r.o, r.v) for r in forward_fill(df, ["k"], "o", ["v"], block=1).collect())
    assert got == [(1, "a"), (2, "a"), (3, None)]


def test_ratings_of_more_schools_than_a_page(spark):
    from edurank.operators.rating import rank_schools

    scored = spark.range(5000).selectExpr(
        "id as school_id", "'n' as full_name", "cast(id % 7 as double) as rating_score", "1D as avg_score_for_rating", "1D as avg_graduates"
    )
    ranked = {r.rank_pos: r.school_id for r in rank_schools(scored).collect()}
    assert len(ranked) == 5000 and ranked[1] == 6 and ranked[5000] == 4998 - 4998 % 7
    assert rank_schools(scored, 12).count() == 12
