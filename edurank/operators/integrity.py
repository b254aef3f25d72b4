"""Integrity rules as a report: every broken key, reference and value rule.

A row becomes its claims: keys it holds, references it uses, the parent key it
offers, rules it breaks.  A claim carries the number of its rule and a typed key,
whole numbers and texts apart, so that no two keys are taken for one; text is
made for the violations alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from functools import cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edurank.plans.change import ChangePlan
from edurank.plans.joins import BROADCAST_BYTES, stored_bytes
from edurank.plans.materialize import materialize
from edurank.sources.schema import CHECKS, FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, UNIQUE_KEYS, struct_type
from edurank.sources.store import Tables

HELD, USED, OFFERED, BROKEN = range(4)
KEY = ("rule_id", "nums", "texts")


@dataclass(frozen=True)
class Rule:
    """A rule of a table: the columns of its key, and when a row takes part or breaks it."""

    table: str
    name: str
    columns: tuple[str, ...]
    role: int
    given: str = "true"
    parent: tuple[str, str] | None = None


def _all_given(columns: Iterable[str]) -> str:
    return " and ".join(f"{c} is not null" for c in columns)


@cache
def all_rules() -> tuple[Rule, ...]:
    """Every rule of the schema; claims name them by their place."""
    found = []
    for table in SCHEMAS:
        primary = PRIMARY_KEYS[table]
        found.append(Rule(table, "primary_key", primary, HELD, _all_given(primary)))
        for columns in UNIQUE_KEYS.get(table, ()):
            found.append(Rule(table, f"unique:{','.join(columns)}", columns, HELD, _all_given(columns)))
        for fk in FOREIGN_KEYS.get(table, ()):
            found.append(Rule(table, f"fk:{fk.column}", (fk.column,), USED, f"{fk.column} is not null", (fk.parent, fk.parent_column)))
        for name, condition in CHECKS.get(table, {}).items():
            found.append(Rule(table, f"check:{name}", primary, BROKEN, f"not coalesce(({condition}), true)"))
        if table == "analytics_run_metric":
            found.append(Rule(table, "one_primary_metric", ("run_id",), HELD, "is_primary"))
        if table == "analytics_request_filter":
            # missing ids count as equal
            item = [c for c in struct_type(table).fieldNames() if c not in ("filter_id", "min_score")]
            found.append(Rule(table, "unique:item", tuple(item), HELD))
    return tuple(found)


def _slots(table: str, columns: Iterable[str]) -> tuple[list[str], list[str]]:
    """Columns of a key that are whole numbers, and those that are texts."""
    texts = [c for c in columns if isinstance(struct_type(table)[c].dataType, T.StringType)]
    return [c for c in columns if c not in texts], texts


def _claim(rule_id: int, role: int, table: str, columns: Iterable[str], given: str) -> str:
    nums, texts = _slots(table, columns)
    values = ", ".join(f"cast({c} as bigint)" for c in nums)
    claim = (
        f"named_struct('rule_id', {rule_id}, 'role', {role}, 'nums', cast(array({values}) as array<bigint>), "
        f"'texts', cast(array({', '.join(texts)}) as array<string>))"
    )
    return f"if({given}, {claim}, null)"


def _claims(rows: DataFrame, table: str, rules: Iterable[int], roles: Iterable[int]) -> DataFrame | None:
    """(rule_id, role, nums, texts) of the rows, for some rules and roles; None where there is nothing to say."""
    found = []
    for i in rules:
        rule = all_rules()[i]
        if rule.table == table and rule.role in roles:
            found.append(_claim(i, rule.role, table, rule.columns, rule.given))
        if rule.parent and rule.parent[0] == table and OFFERED in roles:
            found.append(_claim(i, OFFERED, table, [rule.parent[1]], "true"))
    return rows.selectExpr(f"inline(array_compact(array({', '.join(found)})))") if found else None


def _union(parts: Iterable[DataFrame | None]) -> DataFrame | None:
    kept = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, kept) if kept else None


def _counted(claims: DataFrame) -> DataFrame:
    """Rows per key and role; sums up within a task before anything is sent."""
    number = [F.count_if(F.col("role") == r).alias(n) for r, n in ((HELD, "held"), (USED, "used"), (OFFERED, "offered"), (BROKEN, "broken"))]
    return claims.groupBy(*KEY).agg(*number)


# Parts of a key as text: whole numbers, then texts; a missing one is empty.
_NUMS, _TEXTS = "transform(nums, n -> coalesce(cast(n as string), ''))", "transform(texts, t -> coalesce(t, ''))"


def _key_text() -> str:
    """Key as text, its parts in order of the rule's columns (SQL text)."""
    cases = []
    for i, rule in enumerate(all_rules()):
        nums, texts = _slots(rule.table, rule.columns)
        if list(rule.columns) != nums + texts:
            parts = (f"coalesce(cast(nums[{nums.index(c)}] as string), '')" if c in nums else f"coalesce(texts[{texts.index(c)}], '')" for c in rule.columns)
            cases.append(f"when rule_id = {i} then concat_ws('|', {', '.join(parts)})")
    return f"case {' '.join(cases)} else concat_ws('|', {_NUMS}, {_TEXTS}) end"


def _violations(counted: DataFrame) -> DataFrame:
    """Keys held twice, used without a parent or broken, with their number of rows."""
    broken = counted.selectExpr(*KEY, "if(held > 1, held, 0) + if(offered = 0, used, 0) + broken as row_count").where("row_count > 0")

    def told(values: Iterable[str]) -> str:
        return f"array({', '.join(repr(v) for v in values)})[rule_id]"

    tables, names = zip(*((r.table, r.name) for r in all_rules()), strict=True)
    return broken.selectExpr(f"{told(tables)} as table_name", f"{told(names)} as rule", f"{_key_text()} as row_key", "row_count")


def check_integrity(tables: Tables, names: Iterable[str] | None = None) -> DataFrame:
    """All violations of the given tables (default: every table): table, rule, key and number of rows.

    Each table is read once; one aggregation over the claims of all tables finds
    repeated keys, references without a parent and broken checks.  A key with a
    null part never collides.
    """
    checked = set(names or SCHEMAS)
    rules = [i for i, r in enumerate(all_rules()) if r.table in checked]
    found = _union(_claims(tables[t], t, rules, (HELD, USED, OFFERED, BROKEN)) for t in SCHEMAS)
    return _violations(_counted(found))


# --- integrity of a change -------------------------------------------------------------------


def changed_rows(tables: Tables, plan: ChangePlan) -> Mapping[str, tuple[DataFrame, DataFrame]]:
    """Rows of every changed table that may differ: as they were, and as they will be.

    Where the plan names the keys it touched, rows are found by them; of other
    tables the rows that are not on both sides, by all their columns.
    """
    found, kept = {}, {}
    for name, df in plan.appended.items():
        found[name] = (tables[name].limit(0), df)
    for name, after in plan.tables.items():
        before = tables[name]
        if name in plan.touched:
            key, ids = plan.touched[name]
            if id(ids) not in kept:  # many tables share their keys
                kept[id(ids)] = materialize(ids.select(F.col(ids.columns[0]).alias(key)).distinct())
            own = kept[id(ids)].toDF(key)
            small = F.broadcast(own) if stored_bytes(kept[id(ids)]) <= BROADCAST_BYTES else own
            found[name] = (before.join(small, key, "left_semi"), after.join(small, key, "left_semi"))
        else:
            found[name] = (before.exceptAll(after), after.exceptAll(before))
    return found


def check_change(tables: Tables, plan: ChangePlan) -> DataFrame:
    """Violations that the rows of a change take part in once it is made.

    That is the full check of the new state, restricted to the keys that changed
    rows hold, use or break, and to references to the parents they were.  Claims
    about other keys are dropped where they are read, and tables that no such key
    can be in are not read at all.
    """
    # Read for the changed rows and again for the keys of all rows.
    plan = replace(plan, tables={name: materialize(df) for name, df in plan.tables.items()})
    changes = changed_rows(tables, plan)
    after = plan.preview(tables)
    rules = [i for i, r in enumerate(all_rules()) if r.table in changes or (r.parent and r.parent[0] in changes)]
    own = _union(_claims(new, t, rules, (HELD, USED, BROKEN)) for t, (_, new) in changes.items())
    lost = _union(_claims(old, t, rules, (OFFERED,)) for t, (old, _) in changes.items())
    own = materialize(own)
    wanted = own.select(*KEY)
    wanted = materialize((wanted if lost is None else wanted.unionByName(lost.select(*KEY))).distinct())
    claims = _union(_claims(after[t], t, rules, (HELD, USED, OFFERED)) for t in SCHEMAS)
    if stored_bytes(wanted) <= BROADCAST_BYTES:
        counted = _counted(claims.join(F.broadcast(wanted), list(KEY), "left_semi").unionByName(own.where(F.col("role") == BROKEN)))
    else:
        counted = _counted(claims.unionByName(own.where(F.col("role") == BROKEN))).join(wanted, list(KEY), "left_semi")
    return _violations(counted)
