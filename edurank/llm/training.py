"""Bounded samples of labelled documents for the classifiers, and cuts from all labelled documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from edurank.llm.common import encoded, fold, maybe_among, portions
from edurank.plans.materialize import materialize

# Longest text of a training row in bytes; scoring has no such bound.
TRAINING_BYTES = 65_536
# Score histograms: cells of this width between plus and minus LARGEST.
LARGEST, CELL = 30.0, 0.005
FEWEST_FOR_THRESHOLD = 10
# Bytes of text scored at once.
PORTION = 4 << 20


def _known(labels: DataFrame, label: str, folds: int, held: int, doc_id: str) -> DataFrame:
    """(labelled_id, label) outside the held-out fold; ids labelled more than once take the larger label."""
    return (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (fold(doc_id, folds) != held))
        .groupBy(F.col(doc_id).alias("labelled_id"))
        .agg(F.max(label).cast("int").alias("label"))
    )


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    folds: int,
    held: int,
    rows: int,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> pd.DataFrame:
    """(labelled_id, text, label, lang) of at most ``rows`` labelled documents outside the held-out fold.

    Rows are drawn by a hash of the id, so the sample does not depend on the
    partitions.  Ids labelled more than once take the larger label; rows without
    id, label or text are left out.
    """
    drawn = _known(labels, label, folds, held, doc_id).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(rows)
    texts = docs.where(F.octet_length(F.col(text).cast("string")) <= TRAINING_BYTES)
    picked = texts.join(F.broadcast(drawn), texts[doc_id] == drawn["labelled_id"]).select(
        drawn["labelled_id"].alias("labelled_id"),
        texts[text].alias("text"),
        drawn["label"].alias("label"),
        (texts[lang] if lang in docs.columns else F.lit(None)).cast("string").alias("lang"),
    )
    one = picked.groupBy("labelled_id", "label").agg(F.min(F.struct("text", "lang")).alias("row"))
    frame = one.select("labelled_id", "row.text", "label", "row.lang").toPandas()
    return frame.sort_values("labelled_id").reset_index(drop=True)


def balanced_weight(label) -> float:
    """Weight of a positive row that makes both classes count alike, between 1 and 10."""
    positive = float(label.sum())
    return min(10.0, max(1.0, (len(label) - positive) / max(1.0, positive)))


def score_counts(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    folds: int,
    held: int,
    learnt: list,
    logits: Callable[[list[bytes]], np.ndarray],
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    low: bool = False,
) -> DataFrame:
    """(lang, cell, positive, n): histogram of the logits of all labelled rows that are neither held out nor ``learnt`` from.

    Texts of any size are scored where they lie; only ids and cells are shuffled.
    Positive rows have a label above zero, with ``low`` the others.  A null language counts as the empty one; rows without id, label or text are left out.
    """
    spark = docs.sparkSession
    used = spark.createDataFrame([(x,) for x in learnt], StructType([StructField("used_id", labels.schema[doc_id].dataType)]))
    known = _known(labels, label, folds, held, doc_id)
    rest = materialize(known.join(F.broadcast(used), known["labelled_id"] == used["used_id"], "left_anti"))
    language = F.coalesce(F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string"), F.lit(""))
    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), language.alias("lang")
    )
    near = maybe_among(rows, "doc_id", rest.select("labelled_id")).where("maybe").select("doc_id", "text", "lang")
    sent = spark.sparkContext.broadcast(logits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column("text"))
            for a, b in portions([len(t) for t in texts], PORTION):
                cell = np.floor((np.clip(sent.value(texts[a:b]), -LARGEST, LARGEST) + LARGEST) / CELL).astype(np.int32)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(cell)], ["doc_id", "lang", "cell"])

    scored = near.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, cell int")
    judged = scored.join(rest, scored["doc_id"] == rest["labelled_id"])
    counts = judged.groupBy("lang", "cell").agg(F.count_if((F.col("label") > 0) != F.lit(low)).alias("positive"), F.count("*").alias("n"))
    return materialize(counts)


def best_cut(cell: np.ndarray, positive: np.ndarray, n: np.ndarray) -> float | None:
    """Logit that gives the best F1 of a histogram ordered by cell; among equals the middle of the widest gap.

    None with fewer than ``FEWEST_FOR_THRESHOLD`` positive rows, or where nothing can be told apart.
    """
    if positive.sum() < FEWEST_FOR_THRESHOLD or positive.sum() == n.sum() or len(cell) < 2:
        return None
    caught = positive.sum() - np.cumsum(positive)[:-1]
    f1 = 2 * caught / (n.sum() - np.cumsum(n)[:-1] + positive.sum())
    gaps = np.where(f1 >= f1.max() - 1e-12, np.diff(cell), -1)
    at = int(gaps.argmax())
    return float(cell[at] + cell[at + 1] + 1) / 2 * CELL - LARGEST


def cut_of_all(counts: DataFrame) -> float:
    """Best cut over all languages, zero where there is none; a bounded histogram passes the driver."""
    frame = counts.groupBy("cell").agg(F.sum("positive").alias("positive"), F.sum("n").alias("n")).toPandas().sort_values("cell")
    return best_cut(*(frame[c].to_numpy() for c in ("cell", "positive", "n"))) or 0.0


def cuts_by_language(counts: DataFrame) -> dict[str, float]:
    """Best cut of every language that has one."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("cell")
        cut = best_cut(*(ordered[c].to_numpy() for c in ("cell", "positive", "n")))
        return pd.DataFrame({"lang": frame["lang"].iloc[:1], "cut": [np.nan if cut is None else cut]})

    rows = counts.groupBy("lang").applyInPandas(run, "lang string, cut double").where("cut is not null and not isnan(cut)").collect()
    return {r["lang"]: r["cut"] for r in rows}
