"""Fill-in-middle transformation of whole texts.

Texts are cut in bytes, while places are also told in code points.  A sparse
index holds only the multibyte characters of a text, their places and excess
bytes: a binary search in it turns one kind of place into the other, and between
its entries the two differ by a constant.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edurank.llm.common import portions, table
from edurank.llm.hashing import white

SEED = 42
# Shares in hundredths: texts that are transformed, and of those the ones with the suffix first.
RATE, SPM_RATE = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
# Bytes of text that a task holds in outputs at once.
_PORTION = 8 << 20


class Exceptions:
    """Multibyte characters of a UTF-8 text: byte place, code-point place and excess bytes so far."""

    def __init__(self, data: np.ndarray) -> None:
        self.at_byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.at_byte]
        self.excess = np.cumsum(np.concatenate(([0], 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))))
        self.at_point = self.at_byte - self.excess[:-1]

    def points(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before byte cuts that lie between characters."""
        return cuts - self.excess[np.searchsorted(self.at_byte, cuts)]

    def bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before code-point cuts."""
        return cuts + self.excess[np.searchsorted(self.at_point, cuts)]


def token_ends(data: np.ndarray) -> np.ndarray:
    """Ends of the tokens: white space and the word behind it, or white space at the end of the text."""
    inside = np.concatenate((~white(data), [False]))
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    return np.append(ends, len(data)) if len(data) and not inside[len(data) - 1] else ends


def byte_cuts(data: np.ndarray, index: Exceptions, unit: str, one: int, two: int) -> tuple[int, int, int]:
    """Units of a text, and the byte places of the two cuts drawn by two numbers."""
    if unit == "char":
        n = len(data) - int(index.excess[-1])
        low, high = sorted((one % (n + 1), two % (n + 1)))
        start, end = index.bytes(np.array([low, high]))
    else:
        ends = np.concatenate(([0], token_ends(data)))
        n = len(ends) - 1
        low, high = sorted((one % (n + 1), two % (n + 1)))
        start, end = ends[low], ends[high]
    return n, int(start), int(end)


def _transformed(data: bytes, draws: tuple[int, ...], unit: str, rate: int, spm_rate: int) -> tuple:
    """n, form, code points of prefix and middle, output."""
    one, two, three, four = draws
    symbols = np.frombuffer(data, np.uint8)
    index = Exceptions(symbols)
    n, start, end = byte_cuts(symbols, index, unit, one, two)
    if not data or three % 100 >= rate or any(m in data for m in _MARKS):
        return n, "plain", None, None, data
    before, until = index.points(np.array([start, end]))
    prefix, middle, suffix = data[:start], data[start:end], data[end:]
    p, s, m = _MARKS
    spm = four % 100 < spm_rate
    output = (s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle)
    return n, "spm" if spm else "psm", int(before), int(until - before), b"".join(output)


def fill_in_middle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    unit: str = "token",
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars and output.

    ``n`` counts the units a text may be cut after, tokens (a word with the
    white space before it) or characters.  The draws are the first four groups
    of the hash of ``seed:doc_id``, so a document is cut alike in every run.
    ``plain`` texts stay as they are: the empty ones, those holding a marker and
    those not drawn.  A null text is empty; a null id is drawn as an empty one.
    Repeated rows come out each; an empty table gives no row; other columns are
    not read.
    """
    if unit not in ("token", "char"):
        raise ValueError("a text is cut after tokens or characters")
    key = F.col(f"`{doc_id}`")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(drawn, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]
    kept = docs.select(key.alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *groups)
    names = ["n", "form", "prefix_chars", "middle_chars"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [x or 0 for x in pc.binary_length(batch.column("text")).to_pylist()]
            for start, end in portions(sizes, _PORTION):
                part = batch.slice(start, end - start)
                draws = zip(*(part.column(f"h{i}").to_pylist() for i in range(1, 5)), strict=True)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                rows = [_transformed(t or b"", d, unit, rate, spm_rate) for t, d in zip(texts, draws, strict=True)]
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
                output = pa.array(columns[-1], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays, output], ["doc_id", *names, "output"])

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(
        run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )


def restored(output: Column, form: Column) -> Column:
    """The exact text, rebuilt from an output and its form."""
    first, second, middle = (F.element_at(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), i) for i in (2, 3, 4))
    return (
        F.when(form == "psm", F.concat(first, middle, second))
        .when(form == "spm", F.concat(second, middle, first))
        .otherwise(output)
    )


def query(spark, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
with drawn as (
    select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units
    from documents
), numbers as (
    select doc_id, text, units, len(units) as n,
        ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
        ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4
    from drawn
), cut as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50
            then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form
    from numbers
), pieces as (
    select doc_id, text, n, form, array_to_string(units[1:low], '') as prefix,
        array_to_string(units[low + 1:high], '') as middle, array_to_string(units[high + 1:], '') as suffix
    from cut
)
select doc_id, n, form,
    case when form <> 'plain' then length(prefix) end as prefix_chars,
    case when form <> 'plain' then length(middle) end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(text) as restored_sha256
from pieces
"""
