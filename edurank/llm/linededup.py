"""Line deduplication by an exact set-similarity join.

The words of a line form a set, ordered by rarity.  Similar sets share a word
among the rarest few of each (prefix filter), at places that leave room for the
needed overlap (positional filter), and are about equally large (length filter);
a bitmap of each set (the parity of its words by hash) bounds the overlap once more before the Jaccard similarity
of the words themselves is verified.  A line goes if an earlier line matches it.

Lines are ordered by document id and place, those without an id last by a hash of
their text, and equal sets are one node of the join.  A row is known by its id and
this hash, so rows that share an id do not lose each other's lines.  Per prefix word every node is first verified with its nearest earlier
holder that passes the filters; the nodes that had such a holder and failed, and
only they, meet all their candidates.  So a group of near copies costs a comparison per node
instead of all pairs.  Documents are read for verification and for the result
only where a bit table of the wanted ids does not rule them out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edurank.llm.common import UPPER, as_row, encoded, inside, maybe_among, portions, release_memory, shares, table, text_bytes
from edurank.llm.hashing import mixed, word_hashes, word_ranges
from edurank.plans.materialize import materialize

# Least Jaccard similarity of a match, in per cent.
SIMILARITY = 80
# Counters of the rarity estimate and rows they are sent in.
COUNTERS, SLICES = 1 << 20, 64
# Bytes of text worked on at once.
PORTION = 1 << 20
_RANK_BITS = 9


class LineSets:
    """Distinct words of every line of some texts, as hashes."""

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """(word hash, line number over all texts), in order of the texts, and the number of lines."""
        data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        starts, ends = word_ranges(data)
        breaks = np.flatnonzero(data == 10)
        return word_hashes(data, starts, ends), np.searchsorted(breaks, starts), len(breaks) + 1

    def ordered(self, texts: list[bytes], ranks: np.ndarray | None) -> dict[str, np.ndarray]:
        """Distinct words of each line, the rarest first, and the start and size of each line that has words.

        Words of one rank follow each other in order of their hashes.
        """
        every, line, lines = self.words(texts)
        rank = np.zeros(len(every), np.uint64) if ranks is None else ranks[(every >> np.uint64(44)).astype(np.int64)].astype(np.uint64)
        room = np.uint64(64 - _RANK_BITS - lines.bit_length())
        key = ((line.astype(np.uint64) << np.uint64(_RANK_BITS)) | rank) << room | every >> (np.uint64(64) - room)
        order = np.argsort(key)
        word, key = every[order], key[order]
        if ((key[1:] == key[:-1]) & (word[1:] != word[:-1])).any():  # the key has no room for all of the hash
            order = np.lexsort((every, rank, line))
            word = every[order]
        line = line[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (line[1:] != line[:-1])
        word, line = word[new], line[new]
        first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(line)))
        lines_before = np.cumsum([0] + [t.count(b"\n") + 1 for t in texts])
        text = np.searchsorted(lines_before, line[first], side="right") - 1
        return {"all": every, "word": word, "first": first, "size": size, "text": text, "line": line[first] - lines_before[text]}


def set_marks(sets: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each line's set."""
    return tuple(np.add.reduceat(mixed(sets["word"], salt), sets["first"]).view(np.int64) for salt in (5, 6))


def _with_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, own, text) of the rows with a text; ``own`` is a hash of it."""
    kept = docs.where(F.col(text).isNotNull())
    return kept.select(F.col(doc_id).alias("doc_id"), _own(text).alias("own"), F.col(text).cast("string").alias("text"))


def _own(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def sets_and_counts(rows: DataFrame) -> DataFrame:
    """(set, mark, doc_id, own, line) of every line with words, and (slice, counts) of each task's word counts."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    each = COUNTERS // SLICES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, total, id_type = LineSets(), np.zeros(COUNTERS, np.int64), None
        names = ["set", "mark", "doc_id", "own", "line", "slice", "counts"]
        for batch in batches:
            texts, ids = encoded(batch.column("text")), batch.column("doc_id")
            id_type = ids.type
            for a, b in portions([len(t) for t in texts], PORTION):
                found = sets.ordered(texts[a:b], None)
                total += np.bincount((found["all"] >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
                one, two = set_marks(found)
                text = pa.array(found["text"] + a)
                lines = [pa.array(one), pa.array(two), ids.take(text), batch.column("own").take(text), pa.array(found["line"].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*lines, pa.nulls(len(one), pa.int32()), pa.nulls(len(one), pa.binary())], names)
        if id_type is not None:
            parts = [x.astype("<u8").tobytes() for x in total.reshape(SLICES, each)]
            none = [pa.nulls(SLICES, t) for t in (pa.int64(), pa.int64(), id_type, pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names)
        release_memory()

    return rows.mapInArrow(run, f"set bigint, mark bigint, doc_id {kind}, own bigint, line int, slice int, counts binary")


def rarity(found: DataFrame) -> np.ndarray:
    """Rank of words by their estimated number of occurrences, in eighths of a doubling, by the highest bits of
    their hash; a table of fixed size.
    """

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<u8") for x in frame["counts"])
        return pd.DataFrame({"slice": frame["slice"].iloc[:1], "counts": [total.tobytes()]})

    slices = found.where("slice is not null").select("slice", "counts").groupBy("slice").applyInPandas(add, "slice int, counts binary")
    out = np.zeros((SLICES, COUNTERS // SLICES), np.uint64)
    for row in slices.collect():
        out[row["slice"]] = np.frombuffer(row["counts"], "<u8")
    return np.minimum(8 * np.log2(out.ravel() + 1.0), (1 << _RANK_BITS) - 1).astype(np.uint16)


# Rows a task holds before it reports them, and bytes of text whose rows share a bucket.
HELD = 150_000
BUCKET = 8 << 20
# Bits of the table of words that the second round asks for.
WORD_BITS = 1 << 23

# ``low`` and ``high`` are the parity bitmap.
_FIELDS = {"word": "<u8", "set": "<u8", "low": "<u8", "high": "<u8", "own": "<u8", "line": "<u4", "size": "<u4", "place": "<u4"}


def prefix_postings(rows: DataFrame, counts: np.ndarray, similarity: int, buckets: int, words: np.ndarray | None = None) -> DataFrame:
    """Postings of the rarest words of every line that can match another set, packed by bucket of the word.

    A row holds arrays of word, set, bitmap, own, line, size and place, and the document
    ids.  ``words`` is a bit table that leaves out words nobody asks for.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast((counts, words))
    names = ["bucket", *_FIELDS, "ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, (known, asked) = LineSets(), sent.value
        held: list[tuple[dict[str, np.ndarray], pa.Array]] = []

        def packed() -> pa.RecordBatch:
            fields = {f: np.concatenate([x[f] for x, _ in held]) for f in _FIELDS}
            ids = pa.concat_arrays([x for _, x in held])
            bucket = word_bucket(fields["word"], buckets)
            order = np.lexsort((fields["word"], bucket))
            starts = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) > 0)))
            ends = np.append(starts[1:], len(order))
            columns = [pa.array(bucket[order[starts]].astype(np.int32))]
            for f, form in _FIELDS.items():
                values = fields[f][order].astype(form)
                columns.append(pa.array([values[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()))
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), ids.take(pa.array(order))))
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            texts, ids = encoded(batch.column("text")), batch.column("doc_id")
            for a, b in portions([len(t) for t in texts], PORTION):
                found = sets.ordered(texts[a:b], known)
                if not len(found["size"]):
                    continue
                marks, _ = set_marks(found)
                # Common words cancel out: no more bits differ than words do, also of long lines.
                bit = np.uint64(1) << (found["word"] & np.uint64(63))
                upper = (found["word"] & np.uint64(64)) > 0
                low, high = (np.bitwise_xor.reduceat(np.where(upper == side, bit, np.uint64(0)), found["first"]) for side in (False, True))
                size = found["size"]
                # A smaller set cannot reach the similarity with any other.
                prefix = np.where((size + 1) * similarity <= size * 100, size - -(-size * similarity // 100) + 1, 0)
                row = np.repeat(np.arange(len(size)), prefix)
                place = np.arange(len(row)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
                word = found["word"][found["first"][row] + place]
                if asked is not None:
                    use = np.flatnonzero(asked[(word % np.uint64(WORD_BITS)).astype(np.int64)])
                    row, place, word = row[use], place[use], word[use]
                if not len(row):
                    continue
                text = found["text"][row] + a
                own = batch.column("own").to_numpy(zero_copy_only=False).view(np.uint64)[text]
                fields = {"word": word, "set": marks.view(np.uint64)[row], "low": low[row], "high": high[row], "own": own}
                fields |= {"line": found["line"][row], "size": size[row], "place": place}
                held.append((fields, ids.take(pa.array(text))))
                if sum(len(x["word"]) for x, _ in held) >= HELD:
                    yield packed()
        if held:
            yield packed()
        release_memory()

    arrays = ", ".join(f"{f} binary" for f in _FIELDS)
    return rows.mapInArrow(run, f"bucket int, {arrays}, ids array<{kind}>")


def word_bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    return ((word >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _matching(x: np.ndarray, y: np.ndarray, f: dict[str, np.ndarray], similarity: int) -> np.ndarray:
    """Which rows of a bucket, paired with others, may match: length, positional and bitmap filter, each on what the last left."""
    left, right = f["size"][x], f["size"][y]
    use = np.flatnonzero(100 * np.minimum(left, right) >= similarity * np.maximum(left, right))
    x, y, left, right = x[use], y[use], left[use], right[use]
    need = -(-similarity * (left + right) // (100 + similarity))
    fits = np.flatnonzero(np.minimum(left - f["place"][x], right - f["place"][y]) >= need)
    use, x, y, spare = use[fits], x[fits], y[fits], (left + right - 2 * need)[fits]
    differ = np.bitwise_count(f["low"][x] ^ f["low"][y]).astype(np.int64) + np.bitwise_count(f["high"][x] ^ f["high"][y])
    return use[(differ <= spare) & (f["rank"][x] != f["rank"][y])]


class Holders:
    """The postings of a bucket ordered by word and line, the first line of each set under a word."""

    def __init__(self, group: pa.Table) -> None:
        fields = {f: np.concatenate([np.frombuffer(x, form) for x in group.column(f).to_pylist()]) for f, form in _FIELDS.items()}
        ids = group.column("ids").combine_chunks().flatten()
        # Without an id the text's hash orders the rows; rows of one id have equal places.
        key = np.where(ids.is_null().to_numpy(zero_copy_only=False), fields["own"].view(np.int64), 0)
        rows = pa.table({"word": fields["word"], "id": ids, "key": key, "line": fields["line"], "own": fields["own"].view(np.int64)})
        order = pc.sort_indices(rows, [(c, "ascending") for c in rows.column_names], null_placement="at_end").to_numpy()
        number = pc.fill_null(ids.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        step = np.zeros(len(order), bool)
        for x in (fields["word"][order], number[order], key[order], fields["line"][order]):
            step[1:] |= x[1:] != x[:-1]
        rank = np.cumsum(step)
        word, own = fields["word"][order], fields["set"][order]
        again = np.lexsort((np.arange(len(order)), own, word))
        new = np.ones(len(order), bool)
        new[again[1:]] = (word[again[1:]] != word[again[:-1]]) | (own[again[1:]] != own[again[:-1]])
        order, rank = order[new], rank[new]
        self.fields = {f: x[order] if x.dtype.itemsize == 8 else x[order].astype(np.int64) for f, x in fields.items()} | {"rank": rank}
        self.ids = ids.take(pa.array(order))

    def lines(self, rows: np.ndarray) -> pa.StructArray:
        line = pa.array(self.fields["line"][rows].astype(np.int32))
        own = pa.array(self.fields["own"][rows].view(np.int64))
        return pa.StructArray.from_arrays([self.ids.take(pa.array(rows)), own, line], ["doc_id", "own", "line"])

    def nearest(self, similarity: int) -> tuple[np.ndarray, np.ndarray]:
        """(x, y): for each row that has one, the nearest earlier row of the same word that may match it."""
        word = self.fields["word"]
        out = np.full(len(word), -1)
        open_, back = np.arange(len(word)), 0
        while len(open_):
            back += 1
            open_ = open_[open_ >= back]
            open_ = open_[word[open_ - back] == word[open_]]
            fits = _matching(open_ - back, open_, self.fields, similarity)
            out[open_[fits]] = open_[fits] - back
            open_ = np.delete(open_, fits)
        y = np.flatnonzero(out >= 0)
        return out[y], y

    def earlier(self, y: int, similarity: int) -> np.ndarray:
        """All earlier rows of the same word that may match a row."""
        x = np.arange(np.searchsorted(self.fields["word"], self.fields["word"][y]), y)
        return x[_matching(x, np.full(len(x), y), self.fields, similarity)]


def _end_type(postings: DataFrame) -> str:
    return f"struct<doc_id: {postings.schema['ids'].dataType.elementType.simpleString()}, own: bigint, line: int>"


def _first_pairs(postings: DataFrame, similarity: int) -> DataFrame:
    """(word, x, y): the nearest earlier candidate of every line under each of its prefix words."""

    def run(group: pa.Table) -> pa.Table:
        held = Holders(group)
        x, y = held.nearest(similarity)
        return pa.table({"word": held.fields["word"][y].view(np.int64), "x": held.lines(x), "y": held.lines(y)})

    end = _end_type(postings)
    return postings.groupBy("bucket").applyInArrow(run, f"word bigint, x {end}, y {end}")


def _other_pairs(failed: DataFrame, postings: DataFrame, buckets: int, similarity: int) -> DataFrame:
    """(x, y): all earlier candidates of the lines ``failed`` (word, y) under these words."""
    end = _end_type(postings)

    def run(asked: pa.Table, group: pa.Table) -> pa.Table:
        xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if not len(asked) or not len(group):
            none = pa.array([], pa.struct([("doc_id", group.schema.field("ids").type.value_type), ("own", pa.int64()), ("line", pa.int32())]))
            return pa.table({"x": none, "y": none})
        held = Holders(group)
        columns = (held.fields["word"].tolist(), held.ids.to_pylist(), held.fields["own"].view(np.int64).tolist(), held.fields["line"].tolist())
        places = {k: n for n, k in enumerate(zip(*columns, strict=True))}
        for word, y in zip(asked.column("word").to_numpy().view(np.uint64).tolist(), asked.column("y").to_pylist(), strict=True):
            row = places[word, y["doc_id"], y["own"], y["line"]]
            x = held.earlier(row, similarity)
            xs.append(x)
            ys.append(np.full(len(x), row))
        return pa.table({"x": held.lines(np.concatenate(xs)), "y": held.lines(np.concatenate(ys))})

    asked = failed.select(F.pmod(F.shiftrightunsigned("word", 20), F.lit(buckets)).cast("int").alias("bucket"), "word", "y")
    return asked.groupBy("bucket").cogroup(postings.groupBy("bucket")).applyInArrow(run, f"x {end}, y {end}")


def _word_bits(failed: DataFrame) -> np.ndarray:
    """Bit table of the words of ``failed``; a fixed number of cells passes the driver."""
    spot = failed.select(F.expr(f"cast(word & {WORD_BITS - 1} as bigint)").alias("spot"))
    cells = spot.groupBy(F.shiftright("spot", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits"))
    frame = cells.toPandas()
    out = np.zeros(WORD_BITS // 64, np.uint64)
    out[frame["cell"].to_numpy(np.int64)] = frame["bits"].to_numpy(np.int64).view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _verified(pairs: DataFrame, rows: DataFrame, similarity: int) -> DataFrame:
    """(y) of the pairs (x, y) of lines whose words have the similarity.

    Texts are split where they are read, and only lines that a bit table does not
    rule out are sent, as texts: words are made beside their partner.
    """
    ends = pairs.select(F.col("x").alias("at")).unionByName(pairs.select(F.col("y").alias("at")))
    wanted = materialize(ends.distinct().select("at", _spot("at").alias("spot")))
    whole = maybe_among(rows, "own", wanted.select("at.own").distinct()).where("maybe").select("doc_id", "own", "text")
    lines = whole.select("doc_id", "own", F.posexplode(F.split("text", "\n")).alias("line", "line_text"))
    keyed = lines.select(F.struct("doc_id", "own", "line").alias("at"), "line_text").withColumn("spot", _spot("at"))
    near = maybe_among(keyed, "spot", wanted.select("spot")).where("maybe").select("at", "line_text")
    spoken = materialize(near.join(wanted.select("at"), "at", "left_semi").dropDuplicates(["at"]))
    left = spoken.select(F.col("at").alias("x"), F.col("line_text").alias("xt"))
    right = spoken.select(F.col("at").alias("y"), F.col("line_text").alias("yt"))
    words = "array_distinct(filter(split({0}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''))"
    met = pairs.join(left, "x").select("y", "xt").join(right, "y")
    spelled = met.select("y", *(F.expr(words.format(f"translate({c}, '{UPPER}', '{UPPER.lower()}')")).alias(f"{c}w") for c in ("xt", "yt")))
    judged = spelled.withColumn("common", F.size(F.array_intersect("xtw", "ytw")))
    return judged.where(100 * F.col("common") >= similarity * (F.size("xtw") + F.size("ytw") - F.col("common"))).select("y").distinct()


def _spot(at: str) -> Column:
    return F.xxhash64(f"{at}.doc_id", f"{at}.own", f"{at}.line")


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, own, line) of every line that an earlier line matches; lines are numbered from 0, ``own`` is the text's hash."""
    rows = _with_rows(docs, doc_id, text)
    at = F.struct("doc_id", "own", "line")
    nameless = F.col("doc_id").isNull()
    order = F.struct(nameless, F.col("doc_id"), F.when(nameless, F.col("own")).otherwise(0), F.col("line"))
    found = materialize(sets_and_counts(rows))
    sets = found.where("slice is null").select("set", "mark", at.alias("at"), order.alias("order"), "own")
    firsts = sets.groupBy("set", "mark").agg(F.min(F.struct("order", "own", "at")).alias("first"), F.count("*").alias("n"))
    again = sets.join(firsts.where("n > 1"), ["set", "mark"])
    copies = again.where(F.col("order") > F.col("first.order")).select("at")
    # Equal places of rows that share an id: they go if the first of them is matched.
    twins = again.where((F.col("order") == F.col("first.order")) & (F.col("own") != F.col("first.own")))
    twins = twins.select(F.col("first.at").alias("y"), "at")

    counts, buckets = rarity(found), shares(text_bytes(rows, "text"), BUCKET)
    pairs = materialize(_first_pairs(prefix_postings(rows, counts, similarity, buckets), similarity))
    near = matched = materialize(_verified(pairs.select("x", "y").distinct(), rows, similarity))
    failed = materialize(pairs.select("word", "y").join(matched, "y", "left_anti"))
    if not failed.isEmpty():
        asked = prefix_postings(rows, counts, similarity, buckets, _word_bits(failed))
        others = _other_pairs(failed, asked, buckets, similarity).distinct()
        rest = materialize(others.join(pairs.select("x", "y").distinct(), ["x", "y"], "left_anti"))
        near = near.unionByName(_verified(rest, rows, similarity))
    gone = copies.unionByName(near.select(F.col("y").alias("at"))).unionByName(twins.join(near.distinct(), "y").select("at"))
    return gone.distinct().select("at.doc_id", "at.own", "at.line")


def _with_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` (_own, _id, _mark) and ``_again``: without an id, and not the first of its text."""
    named = rows.withColumn("_again", F.lit(False))
    without = rows.where("_id is null")
    if without.isEmpty():
        return named
    numbered = materialize(without.withColumn("_n", F.monotonically_increasing_id()))
    leads = numbered.groupBy("_mark").agg(F.min("_n").alias("_lead")).select("_lead")
    nameless = numbered.join(leads, F.col("_n") == F.col("_lead"), "left")
    return named.where("_id is not null").unionByName(nameless.select("_own", "_id", "_mark", F.col("_lead").isNull().alias("_again")))


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: int = SIMILARITY,
    lines_as: str | None = "n_lines",
    removed_as: str | None = "n_removed",
) -> DataFrame:
    """``docs`` with the texts' remaining lines, and columns n_lines and n_removed, by other names or none if wanted.

    A line is split off by a line feed; its words are runs without ASCII white
    space, A-Z lowered, each counted once.  It is removed if any line before it,
    removed or not, has a Jaccard similarity of at least ``similarity`` per cent;
    lines without words stay.  Lines before it are those of smaller ids and the
    earlier ones of its own document; rows that repeat an id are one document
    and do not remove each other's equal places.  Rows with a null id come last,
    each as a document of its own, so of equal ones the first keeps its lines;
    a null text stays null with no line.
    """
    gone = materialize(
        removed_lines(docs, doc_id, text, similarity)
        .groupBy(F.col("doc_id").alias("gone_id"), F.col("own").alias("gone_own"))
        .agg(F.collect_set("line").alias("gone_lines"))
    )
    whole = docs.select(as_row(docs).alias("_own"), F.col(doc_id).alias("_id"), _own(text).alias("_mark"))
    marked = maybe_among(_with_repeats(whole), "_mark", gone.select("gone_own"))
    same = (F.col("_mark") == F.col("gone_own")) & F.col("_id").eqNullSafe(F.col("gone_id"))
    touched = marked.where("maybe").join(gone, same, "left").select("_own", "_again", "gone_lines")
    others = marked.where("not maybe").select("_own", "_again", F.lit(None).cast(gone.schema["gone_lines"].dataType).alias("gone_lines"))
    lines = F.split(inside("_own", text), "\n")
    spoken = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(r"[^\x20\x09-\x0D]"))
    worded = F.when(F.col("_again") & inside("_own", text).isNotNull(), spoken).otherwise(F.col("gone_lines"))
    left = F.filter(lines, lambda _, i: ~F.array_contains("gone_lines", i))
    own = inside("_own", text)
    changed = F.when(F.col("gone_lines").isNull(), own).otherwise(F.array_join(left, "\n"))
    count = F.when(own.isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    removed = F.when(F.col("gone_lines").isNull(), 0).otherwise(F.size("gone_lines")).cast("bigint")
    columns = [(changed if c == text else inside("_own", c)).alias(c) for c in docs.columns]
    judged = touched.unionByName(others).select("_own", worded.alias("gone_lines"))
    told = [value.alias(name) for value, name in ((count, lines_as), (removed, removed_as)) if name]
    return judged.select(*columns, *told)


def query(spark, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
with lines as (
    select doc_id, i - 1 as line, w, len(w) as n
    from (
        select doc_id, i, list_distinct(regexp_extract_all(translate(l[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) as w
        from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from documents))
    )
    where len(w) > 0
), sets as (
    select list_sort(w) as w, n, min((doc_id, line)) as at from lines group by all
), rows as (
    select row_number() over () as k, * from sets
), tokens as (
    select k, unnest(w) as t from rows
), common as (
    select a.k as x, b.k as y, count(*) as c from tokens a join tokens b on a.t = b.t and a.k <> b.k
    join rows r on r.k = a.k join rows s on s.k = b.k
    where r.at < s.at and 10 * least(r.n, s.n) >= 8 * greatest(r.n, s.n)
    group by all
), near as (
    select distinct y from common join rows r on r.k = x join rows s on s.k = y where 10 * c >= 8 * (r.n + s.n - c)
), gone as (
    select l.doc_id, l.line from lines l join rows r on list_sort(l.w) = r.w
    where (l.doc_id, l.line) > r.at or r.k in (select y from near)
), split as (
    select doc_id, i - 1 as line, l[i] as part from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from documents))
)
select split.doc_id, count(*) as n_lines, count(gone.line) as n_removed,
       sha256(coalesce(string_agg(part, chr(10) order by split.line) filter (where gone.line is null), '')) as kept_sha256
from split left join gone on split.doc_id = gone.doc_id and split.line = gone.line
group by split.doc_id
"""
