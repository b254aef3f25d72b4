"""Long texts that many rows share: rows are joined and sorted without them, each text is attached last.

A text of a hundred kilobytes that comes with every row of a join or a sort is
shuffled, spilled and written once per row.  Its rows carry a reference instead,
and the different texts are a table of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edurank.plans.joins import join_few_keys, memory_bytes, salted_join
from edurank.plans.materialize import materialize

# Bytes of different texts that are copied to every executor.
TEXT_BYTES = 256 << 20
# Rows that share one text are spread over so many tasks when the texts are too long to copy.
TEXT_SALTS = 4
# Bytes of texts beside their rows from which on rows lie by their text, not in order.
LAID_BYTES = 1 << 30
# Bytes of different texts that a column of a Parquet file keeps once each; beyond, every row has its own copy.
DICTIONARY_BYTES = 1 << 20
# Bytes of one text beside its rows that one task makes, and the most tasks.
TASK_BYTES = 4 << 30
MOST_TASKS = 10_000
# Reference of a text, see :func:`by_reference`.
REF = "_ref"


class ByReference(NamedTuple):
    """Rows with the reference of their text in a column ``_ref``, and the different texts (_ref, _text)."""

    rows: DataFrame
    texts: DataFrame


def by_reference(rows: DataFrame, text: str, keys: Sequence[str]) -> ByReference:
    """``rows`` with the digest of ``text`` (SQL text) in a column ``_ref``, and the different texts (_ref, _text).

    Only digests are grouped; the text is then read from one row of each, found
    by ``keys``, which need not be unique.
    """
    marked = rows.withColumn(REF, F.expr(f"sha2({text}, 256)"))
    chosen = marked.where(f"{REF} is not null").groupBy(REF).agg(F.expr(f"min(struct({', '.join(keys)})) as _one"))
    chosen = chosen.selectExpr(f"{REF} as _wanted", *(f"_one.{k} as _wanted_{k}" for k in keys))
    one = rows.selectExpr(*keys, f"{text} as _text").join(
        F.broadcast(materialize(chosen)), [F.col(k).eqNullSafe(F.col(f"_wanted_{k}")) for k in keys]
    )
    same = one.where("_wanted = sha2(_text, 256)").selectExpr(f"_wanted as {REF}", "_text")
    return ByReference(marked, materialize(same.dropDuplicates([REF])))


def _spread_by(rows: DataFrame) -> Column:
    """Hash of all columns that can be hashed."""
    return F.xxhash64(*(F.col(f"`{name}`") for name, kind in rows.dtypes if "map<" not in kind and "variant" not in kind))


def attach_texts(
    rows: DataFrame,
    texts: DataFrame,
    on: str,
    order: Sequence[Column] = (),
    limit_bytes: int = TEXT_BYTES,
    laid_bytes: int = LAID_BYTES,
) -> DataFrame:
    """``rows`` with the ``_text`` of their reference ``on``, if any, in ``order``.

    Short rows are dealt to a fixed number of tasks, as what comes out of them is long.
    Beyond ``laid_bytes`` of text they are not put in ``order``, which would deal every text to all tasks:
    see :func:`_laid`.
    """
    sizes = materialize(
        rows.groupBy(on)
        .agg(F.expr("count(*) as _rows"))
        .join(texts.selectExpr(on, "octet_length(_text) as _size"), on)
        .selectExpr(on, "_rows", "_size", f"greatest(1L, ceil(_rows * _size / {TASK_BYTES})) as _splits")
    )
    small = memory_bytes(texts) <= limit_bytes
    if (sizes.agg(F.expr("sum(_rows * _size)")).first()[0] or 0) > laid_bytes:
        return _laid(rows, texts, on, sizes, small)
    if not small:
        long = salted_join(rows, texts, [on], _spread_by(rows), "left", TEXT_SALTS)
        return long.orderBy(*order) if order else long
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order) if order else rows.repartition(tasks)
    return dealt.join(F.broadcast(texts), on, "left")


def _laid(rows: DataFrame, texts: DataFrame, on: str, sizes: DataFrame, small: bool) -> DataFrame:
    """Rows with their text; rows of one text lie together, in few tasks with few other texts.

    A columnar file of such rows holds a text once and not once per row, and
    texts too long to copy everywhere are sent only to the tasks of their rows.
    A text of very many rows is split over tasks, rows without a text go to all.
    """
    groups, kept = sizes.agg(F.expr("sum(_splits)"), F.expr("sum(_splits * _size)")).first()
    least = 4 * rows.sparkSession.sparkContext.defaultParallelism
    # Where a hash deals them, about an eighth of what a file can keep of different texts rarely becomes too much.
    tasks = max(least, min(2 * groups, -(-8 * kept // DICTIONARY_BYTES), MOST_TASKS))
    splits = sizes.select(on, "_splits")
    spread_by = _spread_by(rows)
    placed = (
        join_few_keys(rows, splits, [on], spread_by, "left")
        .withColumn("_salt", F.pmod(spread_by, F.coalesce("_splits", F.lit(tasks).cast("bigint"))))
        .drop("_splits")
        .repartition(tasks, on, "_salt")
    )
    if small:
        return placed.sortWithinPartitions(on).join(F.broadcast(texts), on, "left").drop("_salt")
    parts = texts.join(splits, on).withColumn("_salt", F.expr("explode(sequence(0L, _splits - 1))")).drop("_splits")
    return placed.join(parts.repartition(tasks, on, "_salt"), [on, "_salt"], "left").drop("_salt")
