"""Relational division on sets of subjects, as bit masks.

Subjects are numbered densely; a set of them is an array of 64-bit words.  A
school's set is one aggregate, and whether it holds all subjects that a plan
requires, and one of each of its choices, is bit arithmetic.  Schools with the
same set are judged once: a school meets the plans through its set, not subject
by subject.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edurank.functions.numeric import exact_ratio
from edurank.plans.joins import join_few_keys
from edurank.plans.materialize import materialize

WORD = 64
# About so many programs of a plan are one list, see :func:`with_programs`; short lists come again soon, which packs well.
LIST_PROGRAMS = 200
# Rows that one task makes of schools and programs.
TASK_ROWS = 50_000_000


def subject_numbers(requirements: DataFrame) -> tuple[int, ...]:
    """Subjects that any plan asks for, in the order of their numbers; a part of the subject dictionary."""
    return tuple(sorted(r[0] for r in requirements.select("subject_id").distinct().collect() if r[0] is not None))


def words(numbers: Sequence[int]) -> int:
    return max(1, -(-len(numbers) // WORD))


def number_of(subject: str, numbers: Sequence[int]) -> str:
    """Number of a subject, -1 for one that no plan asks for (SQL text)."""
    known = ", ".join(f"{n}L" for n in numbers) or "-1L"
    return f"cast(coalesce(array_position(array({known}), {subject}), 0) - 1 as int)"


def _bit(number: str, word: int) -> str:
    return f"if({number} >= 0 and {number} div {WORD} = {word}, shiftleft(1L, cast({number} % {WORD} as int)), 0L)"


def set_aggregate(number: str, held: str, count: int) -> str:
    """Mask of the numbers of a group's rows for which ``held`` is true (aggregate)."""
    parts = (f"bit_or(if({held}, {_bit(number, w)}, 0L))" for w in range(count))
    return f"array({', '.join(parts)})"


def set_of(items: str, count: int) -> str:
    """Mask of an array of numbers."""
    return f"array({', '.join(f'aggregate({items}, 0L, (m, n) -> m | {_bit("n", w)})' for w in range(count))})"


def common(left: str, right: str, count: int) -> str:
    """How many members two masks share."""
    return "(" + " + ".join(f"bit_count({left}[{w}] & {right}[{w}])" for w in range(count)) + ")"


def holds(mask: str, wanted: str, count: int) -> str:
    """The mask has every member of ``wanted``."""
    return "(" + " and ".join(f"({wanted}[{w}] & ~{mask}[{w}]) = 0" for w in range(count)) + ")"


def meets(mask: str, options: str, count: int) -> str:
    """The mask has a member of ``options``."""
    return "(" + " or ".join(f"({mask}[{w}] & {options}[{w}]) <> 0" for w in range(count)) + ")"


def members(mask: str, size: int) -> str:
    """Numbers in a mask, ascending."""
    bit = f"(shiftright({mask}[n div {WORD}], n % {WORD}) & 1) = 1"
    return f"filter(sequence(0, {max(size, 1) - 1}), n -> {bit})"


def requirement_plans(requirements: DataFrame, numbers: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Plans with their masks, and (program_id, plan_id).

    Programs that ask for the same subjects in the same roles share a plan:
    ``plan_id`` is the lowest of them, ``programs`` their number.  ``required``
    is the mask of the required subjects, ``choices`` one mask per weighted
    choice; ``required_items`` and ``choice_items`` are the same as numbers, the
    latter with the choice that has no weight.
    """
    count = words(numbers)
    needs = requirements.groupBy("program_id").agg(
        F.expr("array_sort(collect_list(struct(subject_id, role, weight))) as needs")
    )
    plans = needs.groupBy("needs").agg(F.expr("min(program_id) as plan_id"), F.expr("count(*) as programs"))
    number = number_of("x.subject_id", numbers)
    choices = "filter(needs, x -> x.role = 'choice')"
    items = f"filter({choices}, x -> x.weight <=> w)"
    masked = (
        plans.selectExpr(
            "*",
            f"transform(filter(needs, x -> x.role = 'required'), x -> {number}) as required_items",
            f"array_sort(array_distinct(transform({choices}, x -> x.weight))) as _weights",
        )
        .selectExpr("*", f"transform(_weights, w -> transform({items}, x -> {number})) as choice_items")
        .selectExpr("*", "transform(filter(_weights, w -> w is not null), w -> array_position(_weights, w) - 1) as _counted")
        .selectExpr(
            "*",
            f"{set_of('required_items', count)} as required",
            f"transform(_counted, i -> {set_of('choice_items[cast(i as int)]', count)}) as choices",
        )
    )
    own = needs.join(plans, "needs").select("program_id", "plan_id")
    return masked.select("plan_id", "programs", "required", "choices", "required_items", "choice_items"), own


def judged_sets(sets: DataFrame, plans: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """Every different set of ``sets`` (reached) with the plans it has a subject of.

    ``required_ok`` and ``choice_ok`` count what the set satisfies, ``complete``
    tells a plan that requires something and misses nothing.  A pair is made
    once, at the lowest subject that both have.
    """
    count = words(numbers)
    different = sets.select("reached").distinct()
    own = different.selectExpr("reached", f"{members('reached', len(numbers))} as _held").selectExpr(
        "*", "explode(_held) as _subject"
    )
    asked = plans.selectExpr("*", "array_distinct(concat(required_items, flatten(choice_items))) as _asked").selectExpr(
        "*", "explode(_asked) as _subject"
    )
    met = join_few_keys(own, asked, ["_subject"], F.xxhash64("reached"))
    once = met.where("_subject = array_min(array_intersect(_held, _asked))").drop("_held", "_asked", "_subject")
    satisfied = once.selectExpr(
        "*",
        "size(required_items) as required_total",
        f"{common('reached', 'required', count)} as required_ok",
        "size(choices) as choice_total",
        f"size(filter(choices, c -> {meets('reached', 'c', count)})) as choice_ok",
    )
    complete = "required_total > 0 and required_ok = required_total and choice_ok = choice_total"
    share = exact_ratio("(required_ok + choice_ok)", "(required_total + choice_total)", 4)
    return satisfied.selectExpr(
        "reached", "plan_id", "programs", "required_items", "choice_items", "required_ok", "choice_ok", f"({complete}) as complete", f"{share} as threshold_share"
    )


# People a plan can draw from a school: the scarcest required subject or choice, a choice by its largest subject.
POTENTIAL = (
    "least(array_min(transform(required_items, n -> people[n])), "
    "array_min(transform(choice_items, c -> array_max(transform(c, n -> people[n])))))"
)


def divided(sets: DataFrame, judged: DataFrame) -> DataFrame:
    """Schools (school_id, reached, people) with the judged plans of their set and the people each can draw."""
    met = join_few_keys(sets.select("school_id", "reached", "people"), judged, ["reached"], F.col("school_id"))
    return met.selectExpr(
        "school_id",
        "plan_id",
        "programs",
        f"cast(case when complete then {POTENTIAL} else 0 end as decimal(14,2)) as potential_applicants",
        "threshold_share",
    )


def dealt_schools(sets: DataFrame, plans: DataFrame) -> DataFrame:
    """Written ``sets`` (school_id) dealt to as many tasks as their rows need once there is one for each program of the ``plans``."""
    programs = plans.agg(F.expr("coalesce(sum(programs), 0)")).first()[0]
    tasks = max(sets.sparkSession.sparkContext.defaultParallelism, -(-sets.count() * programs // TASK_ROWS))
    return sets.repartition(tasks, "school_id")


def with_programs(judged: DataFrame, members: DataFrame) -> DataFrame:
    """Schools and plans (school_id, plan_id) with every program of the plan in ``program_id``.

    The programs of a plan are copied as a few lists: a row looks up these and
    runs through them, not through one entry of a hash table per program.  Rows
    of one list lie together in a task, sorted before they are many: a columnar
    file has the same programs again and again, a few bytes for a whole list.
    """
    lists = members.groupBy("plan_id").agg(F.expr(f"ceil(count(*) / {LIST_PROGRAMS}) as _lists"))
    listed = (
        members.join(lists, "plan_id")
        .groupBy("plan_id", F.expr("pmod(xxhash64(program_id), _lists) as _list"))
        .agg(F.collect_list("program_id").alias("_programs"))
    )
    listed = materialize(listed)
    short = join_few_keys(judged, listed.select("plan_id", "_list"), ["plan_id"], F.col("school_id")).sortWithinPartitions("plan_id", "_list")
    # A sort right below a join is taken for needless and dropped; not so below an explode.
    short = short.withColumn("_list", F.explode(F.array("_list")))
    met = join_few_keys(short, listed, ["plan_id", "_list"], F.col("school_id")).drop("_list")
    return met.select("*", F.explode("_programs").alias("program_id")).drop("_programs")


def judged_plans(sets: DataFrame, plans: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """:func:`judged_sets`, kept for the several uses of a rating."""
    return materialize(judged_sets(sets, plans, numbers))
