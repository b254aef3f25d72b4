"""Domain tables derived from the star-schema test tables.

Each view is one SELECT accepted by Spark and by the checking engine; the only
difference between the two dialects is integer division.  ``needs`` lists the
base tables and views a view reads, so that a query pulls in nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from edurank.plans.materialize import generation
from edurank.sources.schema import SCHEMAS
from edurank.sources.store import Tables, conform

# Columns of the test tables (explicit, so that reading needs no inference job).
BASE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
BASE_TABLES = tuple(BASE_SCHEMAS)

_YEAR_ID = "o_custkey * 100 + (year(o_orderdate) - 1995) * 2 + case when o_orderstatus = 'O' then 1 else 0 end"
_KIND = "case when o_orderstatus = 'O' then 'plan' else 'actual' end"
_SUBJECT = "l_partkey % 11 + 1"
_SUMS = (
    "cast(sum(cast(l_quantity as int)) as bigint) as q, "
    "cast(sum(case when l_returnflag = 'R' then cast(l_quantity as int) else 0 end) as bigint) as q_r, "
    "cast(sum(case when l_returnflag = 'A' then cast(l_quantity as int) else 0 end) as bigint) as q_a, "
    "cast(sum(case when l_returnflag = 'N' and o_orderstatus = 'F' then 1 else 0 end) as bigint) as n_f, "
    "cast(sum(cast(round(l_discount * 100) as int) * 10) as bigint) as score_sum, count(*) as n"
)


def _actual(value: str) -> str:
    return f"case when kind = 'actual' then {value} end"


# view -> (tables and views read, SELECT text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "f_region": (("region",), "select cast(r_regionkey as bigint) as region_id, r_name as name from region"),
    "f_municipality": (
        ("nation",),
        "select cast(n_nationkey as bigint) as municipality_id, cast(n_regionkey as bigint) as region_id, "
        "n_name as name from nation",
    ),
    "f_school": (
        ("customer",),
        "select c_custkey as school_id, cast(c_nationkey as bigint) as municipality_id, "
        "concat('(', cast(c_custkey % 20 as varchar(9)), ') МБОУ  СОШ № ', cast(c_custkey % 20 as varchar(9)), "
        "case when c_custkey % 3 = 0 then '  Приморского' else ' приморский' end) as full_name, "
        "c_acctbal >= 0 as is_active from customer",
    ),
    "f_profile": (
        ("customer",),
        "select cast(row_number() over (order by name) as bigint) as profile_id, name "
        "from (select distinct c_mktsegment as name from customer) segments",
    ),
    "f_segment": (("customer",), "select c_custkey as school_id, lower(c_mktsegment) as segment from customer"),
    "f_profile_link": (
        ("customer", "f_profile"),
        "select c_custkey as school_id, p.profile_id from customer join f_profile p on p.name = c_mktsegment "
        "union select c_custkey, p.profile_id % 5 + 1 from customer join f_profile p on p.name = c_mktsegment "
        "where c_custkey % 3 = 0",
    ),
    "f_subject": (
        ("part",),
        "select subject_id, concat('Subject ', cast(subject_id as varchar(9))) as name, "
        "cast(case subject_id when 3 then 41 when 4 then 45 when 6 then 46 else 40 end as decimal(3,0)) "
        "as min_passing_score from (select distinct p_partkey % 11 + 1 as subject_id from part) ids",
    ),
    "f_institute": (
        ("supplier",),
        "select institute_id, concat('Institute ', cast(institute_id as varchar(9))) as name "
        "from (select distinct s_suppkey % 12 + 1 as institute_id from supplier) ids",
    ),
    "f_program": (
        ("supplier",),
        "select s_suppkey as program_id, s_suppkey % 12 + 1 as institute_id, "
        "concat('P', cast(s_suppkey as varchar(20))) as code, s_name as name, s_suppkey % 10 <> 9 as is_active "
        "from supplier",
    ),
    "f_requirement": (
        ("supplier",),
        "select s_suppkey as program_id, cast(1 as bigint) as subject_id, 'required' as role, 1 as weight "
        "from supplier "
        "union all select s_suppkey, s_suppkey % 10 + 2, 'required', 1 from supplier "
        "union all select s_suppkey, (s_suppkey + 3) % 10 + 2, 'choice', 2 from supplier where s_suppkey % 4 <> 0 "
        "union all select s_suppkey, (s_suppkey + 7) % 10 + 2, 'choice', 2 from supplier where s_suppkey % 4 <> 0",
    ),
    "f_year": (
        ("orders",),
        f"select {_YEAR_ID} as ege_school_year_id, o_custkey as school_id, cast(year(o_orderdate) as int) as yr, "
        f"{_KIND} as kind, cast(sum(o_orderkey % 40 + 5) as bigint) as graduates_total "
        f"from orders group by o_custkey, year(o_orderdate), {_KIND}, {_YEAR_ID}",
    ),
    "f_stat_sums": (
        ("orders", "lineitem"),
        f"select {_YEAR_ID} as ege_school_year_id, {_SUBJECT} as subject_id, {_KIND} as kind, {_SUMS} "
        f"from lineitem join orders on l_orderkey = o_orderkey group by {_YEAR_ID}, {_KIND}, {_SUBJECT}",
    ),
    # avg_h is the average score in hundredths, rounded half up
    "f_stat": (
        ("f_stat_sums",),
        "select ege_school_year_id, subject_id, "
        + ", ".join(
            f"{_actual(value)} as {name}"
            for name, value in (
                ("participants_cnt", "q"),
                ("not_passed_cnt", "q_r"),
                ("high_80_99_cnt", "q_a"),
                ("score_100_cnt", "n_f"),
                ("score_sum", "score_sum"),
                ("n", "n"),
                ("avg_h", "(200 * score_sum + n) {div} (2 * n)"),
            )
        )
        + ", q as chosen_cnt from f_stat_sums",
    ),
    "f_admission": (
        ("orders",),
        "select o_custkey * 100 + year(o_orderdate) - 1995 as adm_stat_id, o_custkey as school_id, "
        "cast(year(o_orderdate) as int) as yr, 3 * count(*) as applicants_cnt, "
        "cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as enrolled_cnt "
        "from orders group by o_custkey, year(o_orderdate)",
    ),
    "f_event": (
        ("events",),
        "select event_id, user_id as school_id, event_id % 12 + 1 as institute_id, cast(ts as date) as event_date, "
        "cast(floor(value) as int) as coverage_cnt, event_type from events",
    ),
    "f_external_key": (
        ("customer",),
        "select c_custkey as ext_key_id, c_custkey as school_id, 'EGE' as source_name, c_name as external_key, "
        "lower(c_name) as normalized_name from customer where c_custkey % 4 <> 3",
    ),
}

# model table -> (view, renamed columns)
_MODEL = {
    "region": ("f_region", {}),
    "municipality": ("f_municipality", {}),
    "school": ("f_school", {}),
    "school_profile": ("f_profile", {}),
    "school_profile_link": ("f_profile_link", {}),
    "school_external_key": ("f_external_key", {}),
    "ege_subject": ("f_subject", {}),
    "institute": ("f_institute", {}),
    "study_program": ("f_program", {}),
    "program_ege_requirement": ("f_requirement", {}),
    "ege_school_year": ("f_year", {"yr": "year"}),
    "ege_school_subject_stat": ("f_stat", {}),
    "school_admission_stat": ("f_admission", {"yr": "year"}),
    "prof_event": ("f_event", {}),
}


def _closure(names: Iterable[str]) -> list[str]:
    """The views behind ``names``, each after the ones it reads."""
    ordered: list[str] = []

    def visit(name: str):
        if name not in VIEWS or name in ordered:
            return
        for needed in VIEWS[name][0]:
            visit(needed)
        ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def with_views(sql: str, *names: str, ctes: Iterable[tuple[str, str]] = ()) -> str:
    """Prefix a statement for the checking engine with the views it reads."""
    heads = [f"{name} as ({VIEWS[name][1].replace('{div}', '//')})" for name in _closure(names)]
    heads += [f"{name} as ({text})" for name, text in ctes]
    return "with " + ",\n".join(heads) + "\n" + sql


# Base tables a view joins or groups, and the key their rows are dealt by first.
_DEALT = {
    "f_year": {"orders": "o_custkey"},
    "f_admission": {"orders": "o_custkey"},
    "f_stat_sums": {"lineitem": "l_orderkey", "orders": "o_orderkey"},
}
# Rows of a base table per task.
TASK_ROWS = 250_000


def _tasks(frame: DataFrame) -> int:
    """Tasks for a base table: as many more as it has more rows, which Parquet knows without reading them."""
    return -(-frame.count() // TASK_ROWS) or 1


def _stat_sums(spark: SparkSession, lineitem: DataFrame, orders: DataFrame, tasks: int) -> DataFrame:
    """The view ``f_stat_sums``, its rows dealt by school year: all later joins and groupings on it find them in place."""
    rows = spark.sql(
        f"select {_YEAR_ID} as ege_school_year_id, {_SUBJECT} as subject_id, o_orderstatus, l_quantity, l_returnflag, l_discount "
        "from {lineitem} join {orders} on l_orderkey = o_orderkey",
        lineitem=lineitem,
        orders=orders,
    ).repartition(tasks, "ege_school_year_id")
    return spark.sql(
        f"select ege_school_year_id, subject_id, {_KIND} as kind, {_SUMS} from {{rows}} group by ege_school_year_id, {_KIND}, subject_id", rows=rows
    )


def view(spark: SparkSession, sf_dir: str, name: str, frames: dict[str, DataFrame] | None = None) -> DataFrame:
    """One view as a Spark DataFrame over the Parquet files; ``frames`` keeps what was built."""
    frames = {} if frames is None else frames
    for step in _closure([name]):
        if step in frames:
            continue
        needs, text = VIEWS[step]
        for needed in needs:
            if needed not in frames:
                frames[needed] = spark.read.schema(BASE_SCHEMAS[needed]).parquet(f"{sf_dir}/{needed}.parquet")
            text = _replace_relation(text, needed)
        given = {n: frames[n] for n in needs}
        if step in _DEALT:
            tasks = max(_tasks(given[n]) for n in _DEALT[step])
            given |= {n: given[n].repartition(tasks, key) for n, key in _DEALT[step].items()}
        if step == "f_stat_sums":
            frames[step] = _stat_sums(spark, tasks=tasks, **given)
        else:
            frames[step] = spark.sql(text.replace("{div}", "div"), **given)
    return frames[name]


def _replace_relation(text: str, name: str) -> str:
    """Turn a relation name after FROM or JOIN into a DataFrame parameter."""
    return re.sub(rf"\b(from|join) {name}\b", rf"\1 {{{name}}}", text)


_STORED: dict[tuple[str, str, str, int], object] = {}


class DomainTables(Tables):
    """Model tables over a test data folder, each derived on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark)
        self._sf_dir = sf_dir
        self._views: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames and name in _MODEL:
            self._frames[name] = self._derive(name)
        return super().__getitem__(name)

    def _derive(self, name: str) -> DataFrame:
        source, renamed = _MODEL[name]
        df = self.view(source).withColumnsRenamed(renamed)
        if name == "ege_school_subject_stat":
            df = df.selectExpr(
                "*",
                "cast(avg_h as decimal(9,0)) * 0.01 as avg_score",
                "ege_school_year_id * 20 + subject_id as ege_school_subject_stat_id",
            )
        if name == "program_ege_requirement":
            df = df.selectExpr("*", "program_id * 20 + subject_id as req_id")
        return conform(df, name)

    def stored(self, name: str, build):
        """A result several queries start from (such as a saved run), made once per session and folder; again when its files were dropped."""
        key = (self.spark.sparkContext.applicationId, self._sf_dir, name, generation())
        if key not in _STORED:
            _STORED[key] = build(self)
        return _STORED[key]

    def view(self, name: str) -> DataFrame:
        return view(self.spark, self._sf_dir, name, self._views)

    def with_tables(self, changed):
        copy = DomainTables(self.spark, self._sf_dir)
        copy._frames = {**self._frames, **changed}
        copy._views = self._views
        copy.shared = self.shared_beside(changed)
        return copy


def domain(spark: SparkSession, sf_dir: str) -> DomainTables:
    return DomainTables(spark, sf_dir)


assert set(_MODEL) <= set(SCHEMAS)
