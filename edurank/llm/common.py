"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import math
import os
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edurank.plans.materialize import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Python workers are told where this package lies."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column of that very name, whatever signs it holds."""
    return F.col(_quoted(name))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_row(df: DataFrame) -> Column:
    """All columns as one struct."""
    return F.struct(*(column(c) for c in df.columns))


def inside(row: str, name: str) -> Column:
    """A field of a struct of :func:`as_row`."""
    return F.col(f"{row}.{_quoted(name)}")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % F.lit(folds)


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def text_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts."""
    return docs.select(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def shares(total: int, each: int) -> int:
    """How many parts of about ``each`` hold ``total``; at least one."""
    return max(1, math.ceil(total / each))


def in_blocks(docs: DataFrame, doc_id: str, text: str, blocks: int) -> DataFrame:
    """(block, doc_id, text) dealt evenly: neither one source nor copies share a block."""
    place = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(blocks)).cast("int")
    return docs.select(place.alias("block"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def encoded(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 without a round trip through str; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words of a text whose words are joined by one space."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(text)]))


def portions(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to about ``limit``."""
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes)


def release_memory() -> None:
    """Give back what a task no longer uses: workers live on for other stages beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# Bits of the table that rules ids out, at most: 8 MB in rows of 64 bits.
MOST_BITS = 1 << 26


def maybe_among(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``df`` with a column ``maybe``: false only for rows whose key is not in ``ids`` (one column).

    A table of bits by hash, of bounded size, is sent to all tasks; rows it rules
    out need not be shuffled for a join with what belongs to the ids.
    """
    bits = 1 << 16
    while bits < min(MOST_BITS, 8 * ids.count()):
        bits *= 2

    def spot(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(bits))

    name = ids.columns[0]
    known = ids.select(F.shiftright(spot(F.col(name)), 6).alias("_cell"), (spot(F.col(name)) % 64).cast("int").alias("_bit"))
    cells = known.groupBy("_cell").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    joined = df.withColumn("_spot", spot(F.col(key))).join(
        F.broadcast(cells), F.shiftright(F.col("_spot"), 6) == F.col("_cell"), "left"
    )
    return joined.select(*df.columns, F.expr("coalesce(shiftright(_bits, cast(_spot % 64 as int)) & 1, 0) = 1").alias("maybe"))


def without_keys(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not in ``gone`` (one column); a row with a null key stays."""
    gone = materialize(gone.select(F.col(gone.columns[0]).alias("_gone")).where("_gone is not null").distinct())
    whole = df.select(as_row(df).alias("_row"), key.alias("_key"))
    marked = maybe_among(whole, "_key", gone)
    doubtful = marked.where("maybe").join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    return marked.where("not maybe").select("_row.*").unionByName(doubtful.select("_row.*"))
