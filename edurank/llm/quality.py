"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded from the shape and
hashed words it holds; gated attention, learned from document labels alone,
weighs the passages, and the weighted representation is scored.  The model is
trained in numpy on a bounded sample and has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edurank.llm.common import encoded, fold, portions, table
from edurank.llm.hashing import RangeHasher, word_ranges
from edurank.llm.toxicity import sigmoid
from edurank.llm.training import balanced_weight, cut_of_all, labelled_sample, score_counts

FOLDS, HELD = 3, 1
SAMPLE_ROWS = 6_000
PASSAGE = 32
WORD_BUCKETS = 64
SHAPES = 16
HIDDEN, ATTENTION = 32, 16
STEPS, BATCH, RATE = 900, 64, 0.003
CALIBRATION = 5
PORTION = 2 << 20


def _bytes(*ranges: tuple[str, str]) -> np.ndarray:
    out = np.zeros(256, np.int32)
    for low, high in ranges:
        out[ord(low) : ord(high) + 1] = 1
    return out


# Kinds of bytes whose share in a passage is a feature.
_KINDS = [
    _bytes(("A", "Z")),
    _bytes(("a", "z")),
    _bytes(("0", "9")),
    _bytes(("\x80", "\xff")),
    _bytes((".", "."), (",", ",")),
    _bytes(("!", "+"), ("-", "-"), ("/", "/"), (":", "@"), ("[", "`"), ("{", "}")),
]


def passage_features(texts: list[bytes], hasher: RangeHasher, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, first passage of each text); a text without words has one empty passage."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    small = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    starts, ends = word_ranges(data)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])[: len(texts)]
    text = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(text, minlength=len(texts))
    bags = np.maximum(1, -(-words // size))
    first = np.cumsum(bags) - bags
    place = np.arange(len(starts)) - (np.cumsum(words) - words)[text]
    passage = first[text] + place // size
    total = int(bags.sum())
    out = np.zeros((total, SHAPES + WORD_BUCKETS))
    if not len(starts):
        return out, first
    held = np.bincount(passage, minlength=total)
    share = 1 / np.maximum(1, held)
    length = ends - starts
    letters = np.bincount(passage, length, total)
    for k, kind in enumerate(_KINDS):
        sums = np.concatenate(([0], np.cumsum(kind[data], dtype=np.int64)))
        out[:, k] = np.bincount(passage, sums[ends] - sums[starts], total) / np.maximum(1, letters)
    mark = hasher(small, starts, ends)
    same = np.zeros(len(starts), bool)
    same[1:] = (mark[1:] == mark[:-1]) & (passage[1:] == passage[:-1])
    last, head = data[ends - 1], data[starts]
    order = np.lexsort((mark, passage))
    new = np.ones(len(order), bool)
    new[1:] = (mark[order][1:] != mark[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    column = len(_KINDS)
    for flag in (
        same,
        (last == 33) | (last == 63),
        last == 46,
        (length == 1) & (data[starts] == 124),
        (head >= 65) & (head <= 90),
        length > 15,
    ):
        out[:, column] = np.bincount(passage, flag, total) * share
        column += 1
    out[:, column] = np.bincount(passage[order], new, total) * share
    out[:, column + 1] = letters * share / 8
    out[:, column + 2] = held / size
    buckets = passage * WORD_BUCKETS + (mark % np.uint64(WORD_BUCKETS)).astype(np.int64)
    out[:, SHAPES:] = np.bincount(buckets, minlength=total * WORD_BUCKETS).reshape(total, WORD_BUCKETS) * share[:, None]
    return out, first


@dataclass
class Model:
    """Encoder, gated attention and output; the features' middle and spread."""

    weights: dict[str, np.ndarray]
    middle: np.ndarray
    spread: np.ndarray
    offset: float = 0.0

    @classmethod
    def fresh(cls, features: np.ndarray) -> Model:
        rng = np.random.default_rng(5)
        width = features.shape[1]
        shapes = {"encode": (width, HIDDEN), "encode_bias": (HIDDEN,), "tanh": (HIDDEN, ATTENTION), "gate": (HIDDEN, ATTENTION), "attend": (ATTENTION,), "out": (HIDDEN,), "bias": (1,)}
        weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in ("attend", "out") else np.zeros(s) for k, s in shapes.items()}
        return cls(weights, features.mean(axis=0), features.std(axis=0) + 0.05)

    def forward(self, features: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = (features - self.middle) / self.spread
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        t, g = np.tanh(h @ w["tanh"]), sigmoid(h @ w["gate"])
        raw = (t * g) @ w["attend"]
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(features))))
        power = np.exp(raw - np.maximum.reduceat(raw, first)[bag])
        share = power / np.add.reduceat(power, first)[bag]
        z = np.add.reduceat(share[:, None] * h, first, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "bag": bag, "share": share, "z": z, "logit": z @ w["out"] + w["bias"][0]}

    def gradient(self, seen: dict[str, np.ndarray], first: np.ndarray, miss: np.ndarray) -> dict[str, np.ndarray]:
        w, h, share, bag = self.weights, seen["h"], seen["share"], seen["bag"]
        dz = miss[:, None] * w["out"][None, :]
        pull = (h * dz[bag]).sum(axis=1)
        draw = share * (pull - np.add.reduceat(share * pull, first)[bag])
        dt = draw[:, None] * w["attend"] * seen["g"] * (1 - seen["t"] ** 2)
        dg = draw[:, None] * w["attend"] * seen["t"] * seen["g"] * (1 - seen["g"])
        dh = share[:, None] * dz[bag] + dt @ w["tanh"].T + dg @ w["gate"].T
        de = dh * (1 - h**2)
        return {
            "encode": seen["x"].T @ de,
            "encode_bias": de.sum(axis=0),
            "tanh": h.T @ dt,
            "gate": h.T @ dg,
            "attend": (seen["t"] * seen["g"]).T @ draw,
            "out": seen["z"].T @ miss,
            "bias": miss.sum(keepdims=True),
        }

    def logits(self, texts: list[bytes], hasher: RangeHasher) -> np.ndarray:
        parts = [np.empty(0)]
        for a, b in portions([len(t) for t in texts], PORTION):
            features, first = passage_features(texts[a:b], hasher)
            parts.append(self.forward(features, first)["logit"] + self.offset)
        return np.concatenate(parts)

    def poorness(self, texts: list[bytes]) -> np.ndarray:
        return -self.logits(texts, RangeHasher(9))


def train(texts: list[bytes], label: np.ndarray) -> Model:
    """Log loss with balanced classes, Adam."""
    hasher, rng = RangeHasher(9), np.random.default_rng(3)
    parts, firsts, done = [], [], 0
    for a, b in portions([len(t) for t in texts], PORTION):
        part, own = passage_features(texts[a:b], hasher)
        parts.append(part.astype(np.float32))
        firsts.append(own + done)
        done += len(part)
    features, first = np.concatenate(parts), np.concatenate(firsts)
    ends = np.append(first[1:], len(features))
    model = Model.fresh(features)
    weight = np.where(label < 1, balanced_weight(1 - label), 1.0)
    slow = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    step = 0
    while step < STEPS:
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            sizes = ends[batch] - first[batch]
            own = np.cumsum(sizes) - sizes
            rows = np.repeat(first[batch] - own, sizes) + np.arange(sizes.sum())
            seen = model.forward(features[rows], own)
            miss = (sigmoid(seen["logit"]) - label[batch]) * weight[batch] / len(batch)
            step += 1
            for k, g in model.gradient(seen, own, miss).items():
                mean, square = slow[k]
                mean += 0.1 * (g - mean)
                square += 0.001 * (g**2 - square)
                model.weights[k] -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Model | None:
    """Model of at most ``rows`` labelled documents; None without rows of both classes."""
    sample = labelled_sample(docs, labels, label, FOLDS, HELD, rows, doc_id, text)
    if sample["label"].nunique() < 2:
        return None
    texts = [x.encode() for x in sample["text"]]
    truth = (sample["label"] > 0).to_numpy().astype(np.float64)
    aside = np.arange(len(texts)) % CALIBRATION == 0
    model = train([t for t, out in zip(texts, aside, strict=True) if not out], truth[~aside])
    used = sample["labelled_id"][~aside].tolist()
    # One half is the best cut for the rarer, poor documents.
    model.offset = cut_of_all(score_counts(docs, labels, label, FOLDS, HELD, used, model.poorness, doc_id, text, low=True))
    return model


def score_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, passages.

    The score, higher for better documents, reads the text alone, all of its
    passages.  Null and empty texts are one empty passage.  Without labelled rows
    of both classes every score is one half.  Repeated rows are scored each;
    other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, doc_id, text, rows))
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RangeHasher(9)
        for batch in batches:
            texts = encoded(batch.column("text"))
            score = np.full(len(texts), 0.5) if sent.value is None else sigmoid(sent.value.logits(texts, hasher))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select(
        "doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
