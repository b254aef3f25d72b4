"""Substring deduplication with automata of repeated phrases.

A window of words that recurs has the same smallest phrase (by hash) wherever it
stands.  Blocks of documents first report the smallest phrases of their windows;
only windows around phrases that recur anywhere are reported next, and those met
twice are confirmed.  Each block is told its confirmed windows and their phrases,
compiles the phrases into an Aho-Corasick automaton and streams its documents through
it; the windows around each occurrence that are confirmed cover their words.

Blocks are dealt evenly.  A phrase or window is reported once by each block,
however often it occurs, phrases to buckets by their own hash and windows by
theirs: the many windows around one frequent phrase are spread over all buckets.
Windows are told apart by two independent hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from edurank.llm.common import encoded, in_blocks, portions, shares, table, text_bytes
from edurank.llm.hashing import SequenceHasher, word_ranges

WINDOW = 35
PHRASE = 8
# Bytes of text in a block; of the reported hashes in a bucket, that of so much text.
BLOCK = 8 << 20
# Bytes of text worked on at once.
PORTION = 2 << 20

_NONE = np.empty(0, np.uint64)


def normal(text: bytes) -> bytes:
    """The words of a text joined by one blank."""
    return b" ".join(text.split())


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of every ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    return best(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


class Portion:
    """Words, phrases and windows of some documents."""

    def __init__(self, texts: list[bytes], window: int, phrase: int, hasher: SequenceHasher) -> None:
        self.window, self.phrase = window, phrase
        self.data = np.frombuffer(b"\n".join(texts), np.uint8)
        self.starts, self.ends = word_ranges(self.data)
        text = np.searchsorted(np.flatnonzero(self.data == 10), self.starts)
        self.whole = np.empty(0, bool)
        if len(self.starts) >= window:
            self.whole = text[: len(text) - window + 1] == text[window - 1 :]
            self.marks = marks = hasher(self.data, self.starts, self.ends, phrase)
            # Windows across documents have no phrase; the largest number stands for none.
            self.least = np.where(self.whole, _sliding(marks, window - phrase + 1, np.minimum), np.uint64(2**64 - 1))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the phrases that are the smallest of some window."""
        if not self.whole.any():
            return np.empty(0, np.int64), _NONE
        span = self.window - self.phrase + 1
        seen = np.where(self.whole, self.least, np.uint64(0))
        padded = np.concatenate((np.zeros(span - 1, np.uint64), seen, np.zeros(span - 1, np.uint64)))
        places = np.flatnonzero(_sliding(padded, span, np.maximum) == self.marks)
        return places, self.marks[places]

    def words(self, place: int, number: int) -> bytes:
        return self.data[self.starts[place] : self.ends[place + number - 1]].tobytes()


def _portions(texts: pa.ChunkedArray) -> Iterator[list[bytes]]:
    whole = [normal(x) for x in encoded(texts.combine_chunks())]
    for a, b in portions([len(x) for x in whole], PORTION):
        yield whole[a:b]


def _members(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[place] == values


def _buckets(values: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its values in their order)."""
    bucket = (values % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for places in np.split(order, cuts) if len(order) else ():
        yield int(bucket[places[0]]), places


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


_ANCHORS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("marks", pa.binary()), ("many", pa.binary())])
_FOUND = pa.schema([("block", pa.int32()), ("marks", pa.binary())])
_WINDOWS = pa.schema(
    [("block", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("one", "two", "marks", "many"))]
)
_CONFIRMED = pa.schema([("block", pa.int32()), *((c, pa.binary()) for c in ("one", "two", "marks"))])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


def _anchor_report(texts: DataFrame, window: int, phrase: int, buckets: int) -> DataFrame:
    """Distinct smallest phrases of each block, and whether the block has them twice."""

    def run(group: pa.Table) -> pa.Table:
        hasher, parts = SequenceHasher(1), [_NONE]
        for part in _portions(group.column("text")):
            parts.append(Portion(part, window, phrase, hasher).anchors()[1])
        marks, counts = np.unique(np.concatenate(parts), return_counts=True)
        block = group.column("block")[0].as_py()
        rows = [
            {"block": block, "bucket": b, "marks": marks[at].tobytes(), "many": (counts[at] > 1).tobytes()}
            for b, at in _buckets(marks, buckets)
        ]
        return _table(rows, _ANCHORS)

    return texts.groupBy("block").applyInArrow(run, _ddl(_ANCHORS))


def _recurring(report: DataFrame) -> DataFrame:
    """The reported phrases of each block that recur in the corpus."""

    def run(group: pa.Table) -> pa.Table:
        marks = [np.frombuffer(x, np.uint64) for x in group.column("marks").to_pylist()]
        many = [np.frombuffer(x, bool) for x in group.column("many").to_pylist()]
        values, counts = np.unique(np.concatenate([*marks, *(m[f] for m, f in zip(marks, many, strict=True))]), return_counts=True)
        twice = values[counts > 1]
        rows = [
            {"block": block, "marks": kept.tobytes()}
            for block, m in zip(group.column("block").to_pylist(), marks, strict=True)
            if len(kept := m[_members(m, twice)])
        ]
        return _table(rows, _FOUND)

    return report.groupBy("bucket").applyInArrow(run, _ddl(_FOUND))


def _window_report(texts: DataFrame, found: DataFrame, window: int, phrase: int, buckets: int) -> DataFrame:
    """Distinct windows around recurring phrases of each block, with the phrase, and whether the block has them twice."""

    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(replies) or not len(group):
            return _table([], _WINDOWS)
        known = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in replies.column("marks").to_pylist()]))
        hasher, first, second = SequenceHasher(1), SequenceHasher(2), SequenceHasher(4)
        parts: list[tuple[np.ndarray, ...]] = []
        for texts in _portions(group.column("text")):
            part = Portion(texts, window, phrase, hasher)
            if not part.whole.any():
                continue
            at = np.flatnonzero(part.whole & _members(part.least, known))
            place = (part.data, part.starts, part.ends, window, at)
            parts.append((part.least[at], first(*place), second(*place)))
        if not parts:
            return _table([], _WINDOWS)
        mark, one, two = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((two, one))
        mark, one, two = mark[order], one[order], two[order]
        new = _changes(one, two)
        many = np.diff(np.append(np.flatnonzero(new), len(new))) > 1
        mark, one, two = mark[new], one[new], two[new]
        block = group.column("block")[0].as_py()
        columns = {"one": one, "two": two, "marks": mark, "many": many}
        rows = [{"block": block, "bucket": bucket, **{c: x[at].tobytes() for c, x in columns.items()}} for bucket, at in _buckets(one, buckets)]
        return _table(rows, _WINDOWS)

    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, _ddl(_WINDOWS))


def _changes(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which of some ordered pairs differ from the one before."""
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return new


def _confirmed(report: DataFrame) -> DataFrame:
    """The windows of each block that start at two places of the corpus, and the hashes of their phrases."""

    def run(group: pa.Table) -> pa.Table:
        one, two, mark = ([np.frombuffer(x, np.uint64) for x in group.column(c).to_pylist()] for c in ("one", "two", "marks"))
        many = np.concatenate([np.frombuffer(x, bool) for x in group.column("many").to_pylist()])
        a, b = np.concatenate(one), np.concatenate(two)
        order = np.lexsort((b, a))
        group_of = np.cumsum(_changes(a[order], b[order])) - 1
        twice = np.bincount(group_of, weights=1.0 + many[order]) > 1
        flags = np.empty(len(a), bool)
        flags[order] = twice[group_of]
        rows, start = [], 0
        for x, y, m, block in zip(one, two, mark, group.column("block").to_pylist(), strict=True):
            own = flags[start : start + len(x)]
            start += len(x)
            if own.any():
                rows.append({"block": block, "one": x[own].tobytes(), "two": y[own].tobytes(), "marks": np.unique(m[own]).tobytes()})
        return _table(rows, _CONFIRMED)

    return report.groupBy("bucket").applyInArrow(run, _ddl(_CONFIRMED))


class Windows:
    """Confirmed windows of a block, known by both of their hashes."""

    def __init__(self, one: np.ndarray, two: np.ndarray) -> None:
        order = np.lexsort((two, one))
        self.one, self.two = one[order], two[order]
        self.first, self.second = SequenceHasher(2), SequenceHasher(4)
        cuts = np.flatnonzero(np.append(np.diff(self.one) != 0, True))
        # How many windows share their first hash, at most: one, but for chance.
        self.longest = int(np.diff(np.append(-1, cuts)).max()) if len(one) else 0

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, at: np.ndarray) -> np.ndarray:
        """Which of the places ``at`` begin a confirmed window."""
        out = np.zeros(len(at), bool)
        one = self.first(data, starts, ends, window, at)
        open_ = np.flatnonzero(_members(one, self.one))
        if not len(open_):
            return out
        two = self.second(data, starts, ends, window, at[open_])
        place = np.searchsorted(self.one, one[open_])
        for step in range(self.longest):
            spot = np.minimum(place + step, len(self.one) - 1)
            out[open_] |= (self.one[spot] == one[open_]) & (self.two[spot] == two)
        return out


def spelled_phrases(texts: pa.ChunkedArray, marks: np.ndarray, window: int, phrase: int) -> set[bytes]:
    """The words of the smallest phrases of windows whose hashes are among ``marks``."""
    hasher, found = SequenceHasher(1), set()
    for portion in _portions(texts):
        part = Portion(portion, window, phrase, hasher)
        places, own = part.anchors()
        known = _members(own, marks)
        _, first = np.unique(own[known], return_index=True)
        found.update(part.words(place, phrase) for place in places[known][first].tolist())
    return found


def automaton(phrases: set[bytes]) -> ahocorasick.Automaton:
    """Automaton of byte phrases, one character per byte, that tells their lengths."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for phrase in phrases:
        found.add_word(phrase.decode("latin-1"), len(phrase))
    found.make_automaton()
    return found


def covered(text: bytes, phrases: ahocorasick.Automaton, windows: Windows, window: int, phrase: int) -> np.ndarray:
    """Which words of a normal text lie in a confirmed window around an occurrence of a phrase."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_ranges(data)
    out = np.zeros(len(starts), bool)
    if len(starts) < window:
        return out
    met = np.array(list(phrases.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
    if not len(met):
        return out
    last = np.minimum(np.searchsorted(ends, met[:, 0] + 1), len(ends) - 1)
    place = last - phrase + 1
    exact = (ends[last] == met[:, 0] + 1) & (place >= 0) & (starts[np.maximum(place, 0)] == met[:, 0] + 1 - met[:, 1])
    place = place[exact]
    steps = np.zeros(len(starts) + 1, np.int64)
    np.add.at(steps, np.maximum(place - (window - phrase), 0), 1)
    np.add.at(steps, place + 1, -1)
    at = np.flatnonzero(np.cumsum(steps)[: len(starts) - window + 1] > 0)
    at = at[windows(data, starts, ends, window, at)]
    cover = np.zeros(len(starts) + 1, np.int64)
    cover[at] += 1
    cover[at + window] -= 1
    return np.cumsum(cover[:-1]) > 0


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    phrase: int = PHRASE,
    with_text: bool = False,
    block_bytes: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, and the kept text if asked for.

    Words are runs without ASCII white space.  A word goes if it lies in
    ``window`` consecutive words of its document that also start anywhere else,
    in the same document too.  Null and empty texts have no words; repeated rows
    repeat each other; an empty table gives an empty result; other columns are
    not read.
    """
    if not 0 < phrase <= window:
        raise ValueError("a phrase must fit into the window")
    blocks = shares(text_bytes(docs, text), block_bytes)
    texts = in_blocks(docs, doc_id, text, blocks)
    found = _recurring(_anchor_report(texts, window, phrase, blocks))
    confirmed = _confirmed(_window_report(texts, found, window, phrase, blocks))
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        machine = windows = None
        if len(replies):
            one, two, marks = (np.concatenate([np.frombuffer(x, np.uint64) for x in replies.column(c).to_pylist()]) for c in ("one", "two", "marks"))
            windows = Windows(one, two)
            machine = automaton(spelled_phrases(group.column("text"), np.unique(marks), window, phrase))
        n_words, n_removed, marks, kept_texts = [], [], [], []
        for value in encoded(group.column("text").combine_chunks()):
            words = value.split()
            removed = 0
            if machine is not None and len(words) >= window:
                gone = covered(b" ".join(words), machine, windows, window, phrase)
                removed = int(gone.sum())
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed else words)
            n_words.append(len(words))
            n_removed.append(removed)
            marks.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_texts.append(kept.decode())
        arrays = [
            group.column("doc_id").combine_chunks(),
            pa.array(n_words, pa.int64()),
            pa.array(n_removed, pa.int64()),
            pa.array(marks, pa.string()),
        ]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            arrays.append(pa.array(kept_texts, pa.string()))
            names.append("kept_text")
        return pa.Table.from_arrays(arrays, names)

    schema = f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if with_text else "")
    return texts.groupBy("block").cogroup(confirmed.groupBy("block")).applyInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
with words as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), starts as (
    select doc_id, i, list_slice(w, i, i + 34) as phrase
    from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from words where len(w) >= 35)
), again as (
    select phrase from starts group by phrase having count(*) > 1
), gone as (
    select distinct doc_id, p from (select doc_id, unnest(range(i, i + 35)) as p from starts where phrase in (select phrase from again))
), split as (
    select doc_id, p, w[p] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from words)
), left_over as (
    select split.doc_id, count(gone.p) as n_removed, string_agg(word, ' ' order by split.p) filter (where gone.p is null) as kept
    from split left join gone on split.doc_id = gone.doc_id and split.p = gone.p group by split.doc_id
)
select words.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from words left join left_over using (doc_id)
"""
