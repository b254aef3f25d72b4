"""Packing by power-of-two decomposition.

Every document is cut into pieces of binary lengths, the longest first, and
pieces of equal length form one bucket.  A piece is a sequence of its own: no
sequence crosses documents and none needs padding.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edurank.llm.common import table

MAX_LENGTH = 2048
END_ID = 1
# Distinct words of one kind whose ids a task remembers at once.
REMEMBERED = 300_000
# Sequence ids: bucket, task and place, so that equal lengths are next to each other.
_TASK_BITS, _PLACE_BITS = 26, 33


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Words(dict):
    """Token ids of a word, found on first use; the owner forgets all when too many are held."""

    def __init__(self, find) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids = self.find(word)
        return ids


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers.

    Byte-level pieces never span a cut before a blank that a visible character
    follows, nor a cut around a line break between visible characters.  Between
    these cuts texts repeat most of their words, which are looked up; the
    tokenizer sees the others, and all parts with other white space.
    """

    # Marks that may end a word and always form a piece of their own.
    _MARKS = ".,;:!?*#$%&|)]"
    # Letters in this range are letters to every version of the character tables.
    _LAST_LETTER = "\u024f"

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        ((self.blank, _),) = self.spelled.pre_tokenize_str(" ")
        self.pieces = _Words(self._piece)
        self.first = _Words(lambda word: self._word("", word))
        self.later = _Words(lambda word: self._word(" ", word))

    def _piece(self, piece: str) -> bytes:
        if piece.isascii():  # visible ASCII is spelled as itself
            mapped = piece.replace(" ", self.blank)
        else:
            ((mapped, _),) = self.spelled.pre_tokenize_str(piece)
        return array("I", [x.id for x in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def _plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def _word(self, before: str, word: str) -> bytes:
        core = word.rstrip(self._MARKS)
        if core.isalpha() and max(core) <= self._LAST_LETTER:
            tail = word[len(core) :]
            return self.pieces[before + core] + (self.pieces[tail] if tail else b"")
        return self._plain(before + word)

    def __call__(self, text: str) -> bytes:
        out: list[bytes] = []
        held, before = "", ""
        for n, line in enumerate(text.split("\n")):
            words = line.split(" ")
            apart = words == line.split()
            if n and apart and before and not before[-1].isspace():
                out += (self._plain(held), self.first["\n"])
                held = ""
            elif n:
                held += "\n"
            if apart and not held:
                out.append(self.first[words[0]])
                out += map(self.later.__getitem__, words[1:])
            else:
                for place, word in enumerate(words):
                    if place and word and not word[0].isspace():
                        out.append(self._plain(held))
                        held = ""
                    held += " " * (place > 0) + word
            before = line
        out.append(self._plain(held))
        return b"".join(out)


def binary_pieces(tokens: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces: whole ``longest`` pieces, then the binary digits of the rest."""
    whole, rest = divmod(tokens, longest)
    return [longest] * whole + [1 << b for b in reversed(range(longest.bit_length())) if rest >> b & 1]


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    longest: int = MAX_LENGTH,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    ``longest`` is a power of two.  A null text counts as empty: one piece that
    holds the end id.  Repeated rows are packed each; an empty table gives no
    piece; other columns are not read.  A sequence id is unique in the result
    and names the bucket in its highest bits.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    path = vocabulary or default_vocabulary()
    kind = kept.schema["doc_id"].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(path), np.array([END_ID], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        seen = [0] * longest.bit_length()
        for batch in batches:
            owner: list[int] = []
            columns: list[list[int]] = [[] for _ in names]
            ids: list[np.ndarray] = []
            for row, value in enumerate(batch.column("text").to_pylist()):
                data = encode(value or "") + end
                start, tokens = 0, len(data) // 4
                for length in binary_pieces(tokens, longest):
                    piece, bucket = data[4 * start : 4 * (start + length)], length.bit_length() - 1
                    sequence = ((bucket << _TASK_BITS | task) << _PLACE_BITS) | seen[bucket]
                    seen[bucket] += 1
                    owner.append(row)
                    for column, x in zip(columns, (start, length, zlib.crc32(piece), tokens, sequence, 0), strict=True):
                        column.append(x)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                    start += length
            arrays = [batch.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in columns)]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names, *(["ids"] if with_ids else [])])

    schema = f"doc_id {kind}, " + ", ".join(f"{x} bigint" for x in names) + (", ids array<int>" if with_ids else "")
    return kept.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
