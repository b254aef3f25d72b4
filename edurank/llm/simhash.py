"""Near duplicates by SimHash fingerprints, linked through vantage points.

Distinct fingerprints are dealt to shards by their Hamming distances from a few
vantage points: inside or outside a radius at each level.  A fingerprint within
the link distance of a radius also visits the shard on the other side, so every
linked pair meets in the shard where one of the two is at home.  There a
vantage-point tree with one branch per distance is descended by all visitors at
once; the triangle inequality leaves only the branches within the link distance.

Copies share one fingerprint and a shard reports a spanning forest of its links,
so no group is expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edurank.llm.common import as_row, encoded, spans, table
from edurank.llm.components import components, spanning_forest
from edurank.plans.materialize import materialize

SHINGLE = 3
BITS = 2
SEED = 42
# Distinct fingerprints at home in one task.
SHARD = 16_384
# Comparisons made at once in a leaf.
LEAF = 1 << 18
# Links held before they are reduced to a forest.
HELD_LINKS = 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit number; no word gives zero."""
    joined = b" ".join(text.lower().split())
    starts, ends = spans(joined)
    if not len(starts):
        return 0
    width = min(shingle, len(starts))
    digests = b"".join(
        [
            xxhash.xxh64_digest(joined[a:b], SEED)
            for a, b in zip(starts[: len(starts) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
        ]
    )
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 14):
        ones += np.unpackbits(rows[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint as bigint) of every row; a null text has no word."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x, shingle) for x in encoded(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _distance(fp: Column, vantage: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(vantage)))


def _vantages(levels: int) -> list[int]:
    """Fixed points of the space, the same for every input."""
    return [xxhash.xxh64_intdigest(f"vantage {i}".encode()) - (1 << 63) for i in range(levels)]


def _dealt(points: DataFrame, bits: int, shard: int) -> DataFrame:
    """(cell, fp, home): each fingerprint at home in one cell and visiting all that its links may reach.

    A shard that holds a dense ball beyond ``shard`` is cut into cells; its visitors go to each of them.
    """
    levels = max(0, math.ceil(math.log2(max(1, points.count()) / shard)))
    vantages = _vantages(levels)
    if vantages:
        middles = [F.percentile(_distance(F.col("fp"), v), F.lit(0.5)).cast("int") for v in vantages]
        radii = [r if r is not None else 32 for r in points.select(*middles).first()]
    else:
        radii = []

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = np.arange(len(frame))
            fp = frame["fp"].to_numpy()
            code = np.zeros(len(frame), np.int64)
            home = np.ones(len(frame), bool)
            for vantage, radius in zip(vantages, radii, strict=True):
                distance = np.bitwise_count((fp ^ vantage).view(np.uint64)).astype(np.int64)
                outside = distance[rows] > radius
                near = np.where(outside, distance[rows] - bits <= radius, distance[rows] + bits > radius)
                code = np.concatenate((2 * code + outside, 2 * code[near] + ~outside[near]))
                home = np.concatenate((home, np.zeros(near.sum(), bool)))
                rows = np.concatenate((rows, rows[near]))
            yield pd.DataFrame({"code": code, "fp": fp[rows], "home": home})

    visits = materialize(points.select("fp").mapInPandas(run, "code bigint, fp bigint, home boolean"))
    cuts = (
        visits.groupBy("code")
        .agg(F.count_if("home").alias("n"))
        .select("code", F.ceil(F.col("n") / F.lit(2 * shard)).cast("int").alias("cuts"))
        .where("cuts > 1")
    )
    dense = visits.join(cuts, "code", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    cell = F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return dense.select("code", "fp", "home", cell.alias("cell"), own.alias("own")).select(
        "code", "cell", "fp", (F.col("home") & (F.col("own").isNull() | (F.col("own") == F.col("cell")))).alias("home")
    )


def near_pairs(home: np.ndarray, visitors: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (point at home, larger visitor) within ``bits``, by descending a vantage-point tree."""
    todo = [(home, visitors, 0)]
    while todo:
        inner, outer, depth = todo.pop()
        if not len(inner) or not len(outer):
            continue
        if len(inner) * len(outer) <= LEAF or depth > 40:
            step = max(1, LEAF // len(inner))
            for at in range(0, len(outer), step):
                part = outer[at : at + step]
                close = np.bitwise_count(inner[:, None] ^ part[None, :]) <= bits
                close &= part[None, :] > inner[:, None]
                i, j = np.nonzero(close)
                if len(i):
                    yield inner[i], part[j]
            continue
        vantage = inner[(depth * 7919) % len(inner)]
        at_home = np.bitwise_count(inner ^ vantage)
        at_visit = np.bitwise_count(outer ^ vantage)
        inner = inner[np.argsort(at_home, kind="stable")]
        outer = outer[np.argsort(at_visit, kind="stable")]
        shell = np.concatenate(([0], np.cumsum(np.bincount(at_home, minlength=65))))
        reach = np.concatenate(([0], np.cumsum(np.bincount(at_visit, minlength=65))))
        for d in range(65):
            if shell[d] < shell[d + 1]:
                low, high = reach[max(0, d - bits)], reach[min(64, d + bits) + 1]
                todo.append((inner[shell[d] : shell[d + 1]], outer[low:high], depth + 1))


def _links(cells: DataFrame, bits: int) -> DataFrame:
    """(a, b): a spanning forest of the links of each cell."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        fp = frame["fp"].to_numpy().view(np.uint64)
        a, b = np.empty(0, np.uint64), np.empty(0, np.uint64)
        for x, y in near_pairs(fp[frame["home"].to_numpy()], fp, bits):
            a, b = np.concatenate((a, x)), np.concatenate((b, y))
            if len(a) > HELD_LINKS:
                a, b = spanning_forest(a, b)
        a, b = spanning_forest(a, b)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return cells.groupBy("code", "cell").applyInPandas(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    bits: int = BITS,
    shard: int = SHARD,
) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_docs) of every row of ``docs``.

    Rows whose fingerprints differ in at most ``bits`` bits are linked;
    ``component_id`` is the smallest id reachable and ``n_docs`` the rows of the
    component.  Null and empty texts have fingerprint zero and are linked like
    any other.  A null id never names a component unless all its ids are null.
    Repeated rows stay repeated; an empty table gives an empty result; other
    columns are not read.
    """
    marks = materialize(fingerprints(docs, doc_id, text, shingle))
    points = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(_links(_dealt(points, bits, shard), bits))
    placed = points.join(roots, points.fp == roots.node, "left").select(
        "fp", "first", "n", F.coalesce("root", "fp").alias("root")
    )
    groups = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("n_docs"))
    named = placed.select("fp", "root").join(groups, "root").select("fp", "component_id", "n_docs")
    return marks.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_docs"
    )


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS
) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, a null id last.

    Rows are known by id and a hash of the text: of rows that share the smallest
    id the one with the smallest hash stays, and of equal rows one.
    """
    own = F.xxhash64(F.col(text).cast("string"))
    key = F.struct(F.col(doc_id).isNull().alias("nameless"), F.col(doc_id).alias("kept_id"), own.alias("kept_own"))
    firsts = materialize(
        near_duplicates(docs.select(key.alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", shingle, bits)
        .where("doc_id = component_id")
        .groupBy("doc_id")
        .count()
        .select("doc_id.kept_id", "doc_id.kept_own", "count")
    )
    whole = docs.select(as_row(docs).alias("_row"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"), own.alias("_own"))
    same = (F.col("_own") == F.col("kept_own")) & F.col("_id").eqNullSafe(F.col("kept_id"))
    once = whole.join(firsts.where("count = 1"), same, "left_semi")
    again = whole.join(firsts.where("count > 1"), same, "left_semi").dropDuplicates(["_id", "_text"])
    return once.select("_row.*").unionByName(again.select("_row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
