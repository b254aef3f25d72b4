"""Token counts of whole texts.

Arrow functions encode texts in batches of about equal bytes and return lengths
only.  A long text is split where no token can span the cut, so that the parts
count as much as the whole and a batch stays small whatever the text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edurank.llm.common import portions, table

LIMIT = 4096
# Characters after which a text is cut at the next safe place, and bytes encoded in one call.
PART_CHARS = 1 << 16
BATCH_BYTES = 1 << 18
_BLANK = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCounter:
    """Counts of a sentencepiece model.

    Two neighbouring characters that are neighbours in no piece are never in one
    token: between them a text may be cut.  What follows a cut is encoded
    without the blank that the model puts before a text.  A model that rewrites
    texts, or joins unknown characters, gets its texts whole.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        rules = model.normalizer_spec
        self.cuttable = (
            not rules.precompiled_charsmap
            and not rules.remove_extra_whitespaces
            and rules.escape_whitespaces
            and model.trainer_spec.byte_fallback
            and not model.trainer_spec.treat_whitespace_as_suffix
        )
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        normal = [p.piece for p in model.pieces if p.type not in (kinds.CONTROL, kinds.UNKNOWN, kinds.BYTE)]
        self.joined = {p[i : i + 2] for p in normal for i in range(len(p) - 1)}
        self.first = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        rules.add_dummy_prefix = False
        self.later = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def safe(self, text: str, place: int) -> bool:
        """No token spans the two characters around ``place``."""
        return text[place - 1 : place + 1].replace(" ", _BLANK) not in self.joined

    def lengths(self, texts: list[str], inner: bool) -> list[int]:
        """Tokens of each text, or of each part behind a cut."""
        return [len(ids) for ids in (self.later if inner else self.first).encode(texts, num_threads=1)]


class VocabularyCounter:
    """Counts of a tokenizers file.

    A byte-level vocabulary that splits words by the usual pattern never joins
    what stands before a blank with a letter behind it, if the blank follows a
    visible character; other files get their texts whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        splitter = spec.get("pre_tokenizer") or {}
        self.cuttable = (
            spec.get("normalizer") is None
            and splitter.get("type") == "ByteLevel"
            and splitter.get("use_regex", True)
            and not splitter.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec.get("added_tokens", []))
        )

    def safe(self, text: str, place: int) -> bool:
        return text[place] == " " and not text[place - 1].isspace() and text[place + 1 : place + 2].isalpha()

    def lengths(self, texts: list[str], inner: bool) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


def counter(vocabulary: str) -> PieceCounter | VocabularyCounter:
    """The library of a vocabulary file: tokenizers for .json, sentencepiece for .model."""
    kinds: dict[str, Callable[[str], PieceCounter | VocabularyCounter]] = {
        "model": PieceCounter,
        "json": VocabularyCounter,
    }
    ending = vocabulary.rsplit(".", 1)[-1]
    if ending not in kinds:
        raise ValueError(f"no library for vocabulary files ending in {ending}")
    return kinds[ending](vocabulary)


def parts(text: str, count: PieceCounter | VocabularyCounter, most: int = PART_CHARS) -> list[str]:
    """The text in parts of at least ``most`` characters, each up to the first safe place behind them."""
    if len(text) <= most or not count.cuttable:
        return [text]
    found, start, place = [], 0, most
    while place < len(text):
        if count.safe(text, place):
            found.append(text[start:place])
            start, place = place, place + most
        else:
            place += 1
    return [*found, text[start:]]


def batch_lengths(texts: Iterable[str | None], count: PieceCounter | VocabularyCounter, most: int = PART_CHARS) -> np.ndarray:
    """Tokens of each text, encoded in batches of about ``BATCH_BYTES``."""
    owners: tuple[list[int], list[int]] = ([], [])
    pieces: tuple[list[str], list[str]] = ([], [])
    rows = 0
    for rows, text in enumerate(texts, 1):
        for n, part in enumerate(parts(text or "", count, most)):
            owners[n > 0].append(rows - 1)
            pieces[n > 0].append(part)
    totals = np.zeros(rows, np.int64)
    for inner in (False, True):
        own = np.array(owners[inner], np.int64)
        for start, end in portions([len(p.encode()) for p in pieces[inner]], BATCH_BYTES):
            np.add.at(totals, own[start:end], count.lengths(pieces[inner][start:end], inner))
    return totals


def count_tokens(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    limit: int = LIMIT,
    most: int = PART_CHARS,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens and over_limit (more tokens than ``limit``).

    Tokens are those the vocabulary's library gives by default, without begin,
    end or added special tokens, truncation or padding.  A null text counts as
    empty: no bytes, no tokens.  Repeated rows and rows without an id are
    counted each; an empty table gives no row; other columns are not read.
    A text without any safe place is encoded in one call.
    """
    path = vocabulary or default_vocabulary()
    kept = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    kind = kept.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            sizes, texts = batch.column("n_bytes").to_pylist(), batch.column("text")
            counted = [
                batch_lengths(texts.slice(start, end - start).to_pylist(), count, most)
                for start, end in portions(sizes, 16 * BATCH_BYTES)
            ]
            totals = np.concatenate([np.empty(0, np.int64), *counted])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals)], ["doc_id", "n_bytes", "n_tokens"]
            )

    counted = kept.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
