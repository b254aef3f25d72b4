"""Planned changes: computed first, written only on request."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from edurank.sources.store import Tables, TableStore, conform


def _hashable(df: DataFrame) -> list[str]:
    """Columns whose values can be hashed; together they keep a dry run from leaving out work."""
    return [name for name, kind in df.dtypes if "map<" not in kind]


@dataclass(frozen=True)
class ChangePlan:
    """New contents of the changed tables and rows to add to others, with reports a dry run can show.

    ``reports`` are DataFrames such as unmatched rows, samples or counts; ``base``
    is the version of the store the plan was made from.  ``touched`` names, for a
    table, a column and a frame of its values: rows with any other value stay as
    they are.  ``numbered`` are the tables whose added rows have new keys.
    """

    tables: Mapping[str, DataFrame]
    reports: Mapping[str, DataFrame] = field(default_factory=dict)
    appended: Mapping[str, DataFrame] = field(default_factory=dict)
    base: int | None = None
    touched: Mapping[str, tuple[str, DataFrame]] = field(default_factory=dict)
    numbered: Collection[str] = ()

    def changed(self, tables: Tables) -> dict[str, DataFrame]:
        """Contents after the change of every table it touches."""
        grown = {name: tables[name].unionByName(conform(df, name)) for name, df in self.appended.items()}
        return {**self.tables, **grown}

    def preview(self, tables: Tables) -> Tables:
        """The state after the change, without writing anything."""
        return tables.with_tables(self.changed(tables))

    def row_counts(self, tables: Tables) -> dict[str, tuple[int, int]]:
        """Rows before and after per changed table: a write that goes nowhere, one job a table.

        Both sides are counted by observation while their rows pass by, so a
        table's new content is worked out once.
        """
        counts = {}
        for name, after in self.changed(tables).items():
            seen = Observation(), Observation()
            sides = (
                df.select(F.hash(*_hashable(df)).alias("row")).observe(one, F.count(F.lit(1)).alias("n"))
                for df, one in zip((tables[name], after), seen, strict=True)
            )
            reduce(DataFrame.unionAll, sides).write.format("noop").mode("overwrite").save()
            counts[name] = tuple(one.get["n"] for one in seen)
        return counts

    def apply(self, store: TableStore) -> int:
        """Write all of it in one commit; returns the new version."""
        return store.commit(self.tables, appended=self.appended, base=self.base, numbered=self.numbered)
