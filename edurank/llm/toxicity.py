"""Toxicity: convolutional text classifier over hashed word embeddings.

A word's vector is the sum of hashed vectors of the word and of its first bytes,
so that unseen forms of a known stem are understood.  Filters of several widths
slide over the words, the strongest answer of each filter in the whole text is
kept, and a linear layer scores it.  The model is trained in numpy on a bounded
sample; its size is fixed, so it can be sent to every task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edurank.llm.common import encoded, fold, portions, release_memory, table
from edurank.llm.training import balanced_weight, cut_of_all, cuts_by_language, labelled_sample, score_counts

FOLDS, HELD = 5, 0
SAMPLE_ROWS = 6_000
BUCKETS = 1 << 15
DIMENSIONS = 16
FILTERS = 8
WIDTHS = (1, 2, 3)
STEMS = (3, 4, 5, 6)
# Training steps of one batch each, over the sample as often as that takes.
STEPS = 900
BATCH = 32
RATE = 0.05
# Share of the sample that is not learnt from; with all labelled rows beyond the sample it calibrates the thresholds.
CALIBRATION = 5
# Bytes of text scored at once; beside other stages in one worker, fewer.
PORTION, SMALL_PORTION = 4 << 20, 1 << 20

_FOLDED = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def sigmoid(logit: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def split_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII bytes."""
    return text.translate(_FOLDED).split()


def word_buckets(words: list[bytes]) -> np.ndarray:
    """(words, 1 + stems) buckets; 0 stands for a stem the word is too short for."""
    longest = max(STEMS)
    head = np.frombuffer(b"".join([w[:longest].ljust(8, b"\0") for w in words]), "<u8")
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), 1 + len(STEMS)), np.int64)
    out[:, 0] = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % (BUCKETS - 1) + 1
    for k, n in enumerate(STEMS, 1):
        mixed = (head & np.uint64((1 << 8 * n) - 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n * 0x632BE59BD9B4E019 % (1 << 64))
        stem = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64)
        out[:, k] = np.where(size >= n, stem % (BUCKETS - 1) + 1, 0)
    return out


def numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, word numbers of all texts with ``max(WIDTHS) - 1`` zeros behind each, starts of the texts."""
    index: dict[bytes, int] = {}
    numbers: list[int] = []
    starts = []
    gap = [0] * (max(WIDTHS) - 1)
    for text in texts:
        starts.append(len(numbers))
        numbers += [index.setdefault(w, len(index) + 1) for w in split_words(text)]
        numbers += gap
    return list(index), np.array(numbers, np.int64), np.array(starts, np.int64)


@dataclass
class Model:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    output: np.ndarray
    offset: float
    thresholds: dict[str, float]

    @classmethod
    def fresh(cls) -> Model:
        rng = np.random.default_rng(7)
        embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
        embedding[0] = 0
        filters = {w: rng.normal(0, 0.2, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS}
        bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        output = rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32)
        return cls(embedding, filters, bias, output, 0.0, {})

    def answers(self, vectors: np.ndarray, numbers: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(width, filter answers at every word); between the texts the answer is very low."""
        ends = np.append(starts[1:], len(numbers))
        gaps = np.concatenate([ends - 1 - k for k in range(max(WIDTHS) - 1)])
        for width in WIDTHS:
            answer = (vectors @ self.filters[width][0] + self.bias[width])[numbers]
            for k in range(1, width):
                answer[: len(numbers) - k] += (vectors @ self.filters[width][k])[numbers[k:]]
            answer[gaps] = -1e9
            yield width, answer

    def logits(self, texts: list[bytes]) -> np.ndarray:
        words, numbers, starts = numbered(texts)
        vectors = np.zeros((len(words) + 1, DIMENSIONS), np.float32)
        if words:
            for bucket in word_buckets(words).T:
                vectors[1:] += self.embedding[bucket]
        pooled = [np.maximum(np.maximum.reduceat(answer, starts, axis=0), 0) for _, answer in self.answers(vectors, numbers, starts)]
        return np.concatenate(pooled, axis=1).astype(np.float64) @ self.output.astype(np.float64) + self.offset

    def scores(self, texts: list[bytes]) -> np.ndarray:
        parts = [self.logits(texts[a:b]) for a, b in portions([len(t) for t in texts], PORTION)]
        return sigmoid(np.concatenate(parts)) if parts else np.empty(0)


class _Adagrad:
    def __init__(self, array: np.ndarray) -> None:
        self.array, self.squares = array, np.full(array.shape, 1e-6, np.float32)

    def step(self, gradient: np.ndarray) -> None:
        self.squares += gradient**2
        self.array -= RATE * gradient / np.sqrt(self.squares)

    def step_rows(self, rows: np.ndarray, gradient: np.ndarray) -> None:
        unique, place = np.unique(rows, return_inverse=True)
        total = np.zeros((len(unique), gradient.shape[1]), np.float32)
        np.add.at(total, place, gradient)
        self.squares[unique] += total**2
        self.array[unique] -= RATE * total / np.sqrt(self.squares[unique])


def train(texts: list[bytes], label: np.ndarray) -> Model:
    """Log loss with balanced classes, Adagrad, gradients only through the strongest word of each filter."""
    model, rng = Model.fresh(), np.random.default_rng(11)
    weight = np.where(label > 0, balanced_weight(label), 1.0)
    offset = np.zeros(1, np.float32)
    embedding, output, bias_out = _Adagrad(model.embedding), _Adagrad(model.output), _Adagrad(offset)
    filters = {w: _Adagrad(model.filters[w]) for w in WIDTHS}
    bias = {w: _Adagrad(model.bias[w]) for w in WIDTHS}
    for _ in range(math.ceil(STEPS * BATCH / len(texts))):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            words, numbers, starts = numbered([texts[i] for i in batch])
            if not words:
                continue
            buckets = np.vstack((np.zeros((1, 1 + len(STEMS)), np.int64), word_buckets(words)))
            # Without the word itself now and then, its stems have to carry the meaning.
            buckets[rng.random(len(buckets)) < 0.5, 0] = 0
            # Without a third of the words, one strong word cannot hide the others.
            buckets[rng.random(len(buckets)) < 0.33] = 0
            vectors = model.embedding[buckets].sum(axis=1)
            ends = np.append(starts[1:], len(numbers))
            places, pooled = {}, {}
            for width, answer in model.answers(vectors, numbers, starts):
                places[width] = np.stack([s + answer[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)])
                pooled[width] = np.maximum(np.take_along_axis(answer, places[width], axis=0), 0)
            layer = np.concatenate([pooled[w] for w in WIDTHS], axis=1)
            miss = (sigmoid(layer @ model.output + offset[0]) - label[batch]) * weight[batch]
            miss = (miss / len(batch)).astype(np.float32)
            back = miss[:, None] * model.output[None, :]
            rows, slopes = [], []
            steps = []
            for n, width in enumerate(WIDTHS):
                slope = np.where(pooled[width] > 0, back[:, n * FILTERS : (n + 1) * FILTERS], 0)
                gradient = np.zeros_like(model.filters[width])
                for k in range(width):
                    word = numbers[np.minimum(places[width] + k, len(numbers) - 1)]
                    gradient[k] = np.einsum("df,dfx->xf", slope, vectors[word])
                    active = np.nonzero(slope)
                    rows.append(word[active])
                    slopes.append(slope[active][:, None] * model.filters[width][k].T[active[1]])
                steps.append((filters[width], gradient))
                steps.append((bias[width], slope.sum(axis=0)))
            output.step(layer.T @ miss)
            bias_out.step(miss.sum(keepdims=True))
            for one, gradient in steps:
                one.step(gradient)
            touched = buckets[np.concatenate(rows)]
            change = np.repeat(np.concatenate(slopes), touched.shape[1], axis=0)
            flat = touched.ravel()
            embedding.step_rows(flat[flat > 0], change[flat > 0])
    model.offset = float(offset[0])
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows: int = SAMPLE_ROWS,
) -> Model | None:
    """Model of at most ``rows`` labelled documents, thresholds of all others; None without rows of both classes."""
    sample = labelled_sample(docs, labels, label, FOLDS, HELD, rows, doc_id, text, lang)
    if sample["label"].nunique() < 2:
        return None
    texts = [x.encode() for x in sample["text"]]
    truth = (sample["label"] > 0).to_numpy().astype(np.float32)
    aside = np.arange(len(texts)) % CALIBRATION == 0
    learnt = train([t for t, out in zip(texts, aside, strict=True) if not out], truth[~aside])
    used = sample["labelled_id"][~aside].tolist()
    counts = score_counts(docs, labels, label, FOLDS, HELD, used, learnt.logits, doc_id, text, lang)
    # One half is the best cut over all languages.
    shift = cut_of_all(counts)
    learnt.offset -= shift
    learnt.thresholds = {name: float(sigmoid(cut - shift)) for name, cut in cuts_by_language(counts).items()}
    return learnt


def judged(model: Model | None, texts: list[bytes], langs: list) -> tuple[np.ndarray, np.ndarray]:
    """Score and threshold of every text; zero and one half without a model."""
    if model is None:
        return np.zeros(len(texts)), np.full(len(texts), 0.5)
    cuts = [model.thresholds.get("" if x is None else str(x), 0.5) for x in langs]
    return model.scores(texts), np.array(cuts, np.float64)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, threshold, rejected.

    The score reads the text alone.  ``predicted`` compares it with one half;
    ``rejected`` with the threshold calibrated for the row's language, one half
    for languages with too few labelled rows and for a null language.  A null
    text scores like an empty one.  Without labelled rows of both classes every
    score is 0.  Repeated rows are scored each; other columns are not read.
    """
    model = fit(docs, labels, label, doc_id, text, lang, rows)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    language = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), language.alias("lang"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, cuts = judged(sent.value, encoded(batch.column("text")), batch.column("lang").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(cuts, pa.float64())], ["doc_id", "score", "threshold"]
            )

    scored = kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double, threshold double")
    return scored.select(
        "doc_id",
        (fold("doc_id", FOLDS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold",
        (F.col("score") >= F.col("threshold")).alias("rejected"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of ``docs`` that are not rejected; every row is judged by its own text, whatever its id."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id=doc_id, text=text, lang=lang))
    text_at, lang_at = docs.columns.index(text), docs.columns.index(lang) if lang in docs.columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(text_at))
            langs = [None] * len(texts) if lang_at is None else batch.column(lang_at).to_pylist()
            for a, b in portions([len(t) for t in texts], SMALL_PORTION):
                score, cuts = judged(sent.value, texts[a:b], langs[a:b])
                yield batch.slice(a, b - a).filter(pa.array(score < cuts))
        release_memory()

    # Columns go by place: their names may hold signs that Spark reads as paths.
    placed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return placed.mapInArrow(run, placed.schema).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
