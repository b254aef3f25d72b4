"""Language-model scoring by prediction by partial matching.

The model is a byte-context trie pretrained on a corpus: counts of every byte
after every context of up to five bytes.  A shorter context counts a byte once
for each longer context that has seen it (update exclusion).  A byte that a
context has not seen costs an escape to the next shorter one (method D: half a
count for each byte seen), where the bytes of the longer context no longer
compete (symbol exclusion).  The end of a text is a symbol of its own, and the
start a context.

The trie is sharded by the three bytes next to the symbol, so a shard holds whole
chains of contexts from the longest to that of three bytes; the shorter contexts
have at most 256**3 counts and are sent to all tasks.  Blocks of documents ask
the shards once for each distinct context and symbol and add up the answers.
The same exchange counts the words for the baseline.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edurank.llm.common import encoded, fold, in_blocks, portions, shares, table, text_bytes
from edurank.llm.hashing import mixed
from edurank.plans.materialize import materialize

FOLDS, HELD_OUT = 7, 2
# Context bytes of the model; a context and its symbol fit into 64 bits.
ORDER = 5
# Context bytes that choose the shard.
SHARD_ORDER = 3
# Bytes that never occur in UTF-8: end of text, and what stands before a text.
END, START = 0xFE, 0xFF
SYMBOLS = 255
# Bytes of text in a block, and of the text whose counts fall into one shard.
BLOCK = 8 << 20
SHARD = 8 << 20
PORTION = 2 << 20
# The word that ends every text; no word contains a blank.
END_WORD = b" "

_NONE = np.empty(0, np.uint64)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context and symbol of every byte and text end, start of each text).

    The symbol is in the lowest eight bits, the byte before it in the next.
    """
    data = np.frombuffer(b"".join([bytes([START]) * ORDER + t + bytes([END]) for t in texts]), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    key = data.astype(np.uint64)
    for back in range(1, ORDER + 1):
        key[back:] |= data[: len(data) - back].astype(np.uint64) << np.uint64(8 * back)
    starts = np.cumsum(sizes) - sizes
    keep = np.repeat((np.arange(len(texts)) + 1) * ORDER, sizes) + np.arange(sizes.sum())
    return key[keep], starts


def _edges(keys: np.ndarray) -> np.ndarray:
    """Where each different one of sorted keys begins."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, their counts)."""
    keys = np.sort(keys)
    edges = _edges(keys)
    return keys[edges], np.diff(np.append(edges, len(keys)))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, sums of their counts) of several sorted runs, one after the other."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edges = _edges(keys)
    return keys[edges], np.add.reduceat(counts[order], edges) if len(edges) else counts


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts with A-Z lowered, their number in each text); the ends are left out."""
    # Seen as text without a check, so that broken bytes are kept as they are.
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
    words, cuts = lists.flatten(), lists.offsets.to_numpy()
    # A blank at either end of a text gives an empty word.
    real = pc.binary_length(words).to_numpy() > 0
    before = np.concatenate(([0], np.cumsum(real)))
    return words.view(pa.binary()).filter(pa.array(real)), np.diff(before[cuts - cuts[0]])


def word_counts(texts: list[bytes]) -> pa.Table:
    """(word, n) of the different words of texts and of their ends."""
    found = pc.value_counts(split_words(texts)[0])
    ends = [END_WORD] if texts else []
    words = pa.chunked_array([found.field("values"), pa.array(ends, pa.binary())])
    return pa.table({"word": words, "n": pa.chunked_array([found.field("counts"), pa.array([len(texts)] * len(ends), pa.int64())])})


def _words_summed(counts: list[pa.Table]) -> pa.Table:
    """(word, n) of several such tables, each word once."""
    return pa.concat_tables(counts).group_by("word").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, which compress well."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u8"), dtype=np.uint64)


def gram_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    near = keys >> np.uint64(8) & np.uint64((1 << 8 * SHARD_ORDER) - 1)
    return (mixed(near) % np.uint64(shards)).astype(np.int64)


def word_shard(words: list[bytes], shards: int) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) % shards for w in words), np.int64, len(words))


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places in their order)."""
    few = not len(shard) or shard.max() < 1 << 16
    order = np.argsort(shard.astype(np.uint16) if few else shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for places in np.split(order, cuts) if len(order) else ():
        yield int(shard[places[0]]), places


_COUNTS = pa.schema([("shard", pa.int32()), ("kind", pa.string()), ("keys", pa.binary()), ("counts", pa.binary())])
_MODEL = pa.schema([*_COUNTS, ("total", pa.int64()), ("distinct", pa.int64())])
_ASKED = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("kind", pa.string()), ("keys", pa.binary())])
_ANSWERED = pa.schema([*_ASKED, ("values", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


class _Tally:
    """Distinct grams and words of many texts."""

    def __init__(self) -> None:
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: list[pa.Table] = []
        self.held = 0
        self.held_words = 0

    def add(self, texts: list[bytes]) -> None:
        keys, counts = _counted(grams(texts)[0])
        self.grams.append((keys, counts))
        self.held += len(keys)
        if len(self.grams) > 8 and self.held > 1 << 22:
            self.grams = [self.total()]
            self.held = len(self.grams[0][0])
        self.words.append(word_counts(texts))
        self.held_words += len(self.words[-1])
        if len(self.words) > 8 and self.held_words > 1 << 19:
            self.words = [_words_summed(self.words)]
            self.held_words = len(self.words[0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.grams:
            return _NONE, np.empty(0, np.int64)
        return _summed(np.concatenate([k for k, _ in self.grams]), np.concatenate([c for _, c in self.grams]))

    def rows(self, shards: int) -> Iterator[dict]:
        keys, counts = self.total()
        for shard, at in _by_shard(gram_shard(keys, shards)):
            yield {"shard": shard, "kind": "gram", "keys": _packed(keys[at]), "counts": counts[at].astype("<u4").tobytes()}
        if not self.words:
            return
        table = _words_summed(self.words)
        words = table.column("word").to_numpy().tolist()
        numbers = table.column("n").to_numpy()
        for shard, at in _by_shard(word_shard(words, shards)):
            own = b"\n".join([words[i] for i in at.tolist()])
            yield {"shard": shard, "kind": "word", "keys": own, "counts": numbers[at].astype("<u4").tobytes()}


# Distinct grams and words a training task holds before it reports them.
HELD = 3 << 20


def _added(group: pa.Table) -> pa.Table:
    """One row for all counts of a shard."""
    kind, shard = group.column("kind")[0].as_py(), group.column("shard")[0].as_py()
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in group.column("counts").to_pylist()]).astype(np.int64)
    if kind == "gram":
        keys, sums = _summed(np.concatenate([_unpacked(x) for x in group.column("keys").to_pylist()]), counts)
        packed = _packed(keys)
    else:
        places, keys = pd.factorize(np.array([w for x in group.column("keys").to_pylist() for w in x.split(b"\n")], object))
        packed = b"\n".join(keys.tolist())
        sums = np.bincount(places, counts, len(keys))
    sums = sums.astype("<i8")
    row = {"shard": shard, "kind": kind, "keys": packed, "counts": sums.tobytes(), "total": int(sums.sum()), "distinct": len(keys)}
    return pa.Table.from_pylist([row], schema=_MODEL)


@dataclass(frozen=True)
class Trie:
    """Sharded counts (shard, kind, keys, counts), those of short contexts, and the words' total and number."""

    shards: DataFrame
    n_shards: int
    short: Broadcast
    train_tokens: int
    train_words: int


def pretrain(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD) -> Trie:
    """Model of all texts of ``docs``; a null text counts as empty."""
    n_shards = shares(text_bytes(docs, text), shard_bytes)
    texts = docs.select(F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            whole = encoded(batch.column("text"))
            for a, b in portions([len(t) + 1 for t in whole], PORTION):
                tally.add(whole[a:b])
                if tally.held + tally.held_words > HELD:
                    yield from pa.Table.from_pylist(list(tally.rows(n_shards)), schema=_COUNTS).to_batches()
                    tally = _Tally()
        yield from pa.Table.from_pylist(list(tally.rows(n_shards)), schema=_COUNTS).to_batches()

    model = materialize(texts.mapInArrow(run, _ddl(_COUNTS)).groupBy("shard", "kind").applyInArrow(_added, _ddl(_MODEL)))
    total, distinct = (
        model.where("kind = 'word'").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    )
    return Trie(model, n_shards, docs.sparkSession.sparkContext.broadcast(_short_contexts(model)), total, distinct)


def _short_contexts(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of contexts shorter than the shards': at most 256**3 of the longest kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys in batch.column("keys").to_pylist():
                longer = np.unique(_unpacked(keys) & np.uint64((1 << 8 * SHARD_ORDER + 8) - 1))
                found, counts = np.unique(longer & np.uint64((1 << 8 * SHARD_ORDER) - 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(counts)], ["key", "n"])

    grams_only = model.where("kind = 'gram'").select("keys")
    sums = grams_only.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    frame = sums.toPandas().sort_values("key")
    return frame["key"].to_numpy(np.int64).astype(np.uint64), frame["n"].to_numpy(np.int64)


class Chains:
    """Trie levels of one shard: counts by context and symbol, from no context to the longest."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, short: tuple[np.ndarray, np.ndarray]) -> None:
        self.keys, self.counts, self.total, self.kinds, self.contexts, self.first = ([None] * (ORDER + 1) for _ in range(6))
        for order in range(ORDER, -1, -1):
            if order == SHARD_ORDER - 1:
                keys, counts = short
            found, places = np.unique(keys & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
            sums = np.bincount(places, counts, len(found))
            # Symbols of a context next to each other.
            turn = np.argsort(found >> np.uint64(8), kind="stable")
            context = found[turn] >> np.uint64(8)
            edge = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.empty(0, np.int64)
            self.keys[order], self.counts[order] = found, sums
            self.contexts[order] = context[edge]
            self.total[order] = np.add.reduceat(sums[turn], edge) if len(edge) else np.empty(0)
            self.kinds[order] = np.diff(np.append(edge, len(context))).astype(np.float64)
            self.first[order] = (turn, edge)
            keys, counts = found, np.ones(len(found))
        # What the symbols of a context count in the next shorter one.
        self.shared = [np.zeros(0)]
        for order in range(1, ORDER + 1):
            low = self.keys[order] & np.uint64((1 << 8 * order) - 1)
            above = self._value(self.keys[order - 1], self.counts[order - 1], low)
            turn, edge = self.first[order]
            self.shared.append(np.add.reduceat(above[turn], edge) if len(edge) else np.empty(0))

    @staticmethod
    def _value(table: np.ndarray, values: np.ndarray, sought: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(sought))
        place = np.minimum(np.searchsorted(table, sought), len(table) - 1)
        return np.where(table[place] == sought, values[place], 0.0)

    def log10(self, asked: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after its context."""
        out = np.zeros(len(asked))
        open_ = np.ones(len(asked), bool)
        # Symbols of the longer context: their number, and their count here.
        kinds = np.zeros(len(asked))
        shared = np.zeros(len(asked))
        for order in range(ORDER, -1, -1):
            key = asked & np.uint64((1 << 8 * (order + 1)) - 1)
            context = key >> np.uint64(8)
            own_kinds = self._value(self.contexts[order], self.kinds[order], context)
            left = self._value(self.contexts[order], self.total[order], context) - shared
            fresh = own_kinds - kinds
            count = self._value(self.keys[order], self.counts[order], key)
            use = open_ & (left > 0)
            hit, miss = use & (count > 0), use & (count == 0)
            out[hit] += np.log10((count[hit] - 0.5) / left[hit])
            out[miss] += np.log10(0.5 * fresh[miss] / left[miss])
            open_ &= ~hit
            kinds = own_kinds
            shared = self._value(self.contexts[order], self.shared[order], context) if order else shared
        out[open_] -= np.log10(SYMBOLS - kinds[open_])
        return out


def _asked(texts: DataFrame, n_shards: int) -> DataFrame:
    """Distinct grams and words of each block, by the shard that knows them."""

    def run(group: pa.Table) -> pa.Table:
        tally = _Tally()
        whole = encoded(group.column("text").combine_chunks())
        for a, b in portions([len(t) + 1 for t in whole], PORTION):
            tally.add(whole[a:b])
        block = group.column("block")[0].as_py()
        rows = [{"block": block, **{c: row[c] for c in ("shard", "kind", "keys")}} for row in tally.rows(n_shards)]
        return pa.Table.from_pylist(rows, schema=_ASKED)

    return texts.groupBy("block").applyInArrow(run, _ddl(_ASKED))


def _answered(asked: DataFrame, trie: Trie) -> DataFrame:
    """The questions with a value for each key: log10 of a gram's probability, or a word's count."""
    short = trie.short

    def run(questions: pa.Table, shard: pa.Table) -> pa.Table:
        if not len(questions):
            return pa.Table.from_pylist([], schema=_ANSWERED)
        kind = questions.column("kind")[0].as_py()
        lists = questions.column("keys").to_pylist()
        own = (shard.column("keys")[0].as_py(), np.frombuffer(shard.column("counts")[0].as_py(), "<i8")) if len(shard) else None
        if kind == "gram":
            chains = Chains(*(_unpacked(own[0]), own[1]) if own else (_NONE, np.empty(0, np.int64)), short.value)
            values = [chains.log10(_unpacked(x)).astype("<f8").tobytes() for x in lists]
        else:
            counts = dict(zip(own[0].split(b"\n"), own[1].tolist(), strict=True)) if own else {}
            values = [np.array([counts.get(w, 0) for w in x.split(b"\n")], "<f8").tobytes() for x in lists]
        return questions.select([f.name for f in _ASKED]).append_column("values", pa.array(values, pa.binary()))

    shards = trie.shards.select("shard", "kind", "keys", "counts")
    return asked.groupBy("shard", "kind").cogroup(shards.groupBy("shard", "kind")).applyInArrow(run, _ddl(_ANSWERED))


def score(docs: DataFrame, trie: Trie, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the model's log10 probability of the whole text and its end,
    ``base_score`` that of its words by smoothed training counts.  Null and empty
    texts consist of the end alone.  A model of no text gives every byte the same
    probability.  Repeated rows are scored each; other columns are not read.
    """
    blocks = shares(text_bytes(docs, text), block_bytes)
    texts = in_blocks(docs, doc_id, text, blocks)
    answers = _answered(_asked(texts, trie.n_shards), trie)
    log_total = float(np.log10(trie.train_tokens + trie.train_words + 1))
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(group):
            return pa.Table.from_arrays([group.column("doc_id").combine_chunks(), *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names)
        keys, logs, known_words, counts = [_NONE], [np.empty(0)], [], []
        for kind, own, values in zip(*(replies.column(c).to_pylist() for c in ("kind", "keys", "values")), strict=True):
            numbers = np.frombuffer(values, "<f8")
            if kind == "gram":
                keys.append(_unpacked(own))
                logs.append(numbers)
            else:
                known_words += own.split(b"\n")
                counts.append(numbers)
        key, log, count = pd.Index(np.concatenate(keys)), np.concatenate(logs), np.concatenate(counts)
        ends = count[known_words.index(END_WORD)]
        known_words = pa.array(known_words, pa.binary())
        whole = encoded(group.column("text").combine_chunks())
        scores, tokens, known, base = [], [], [], []
        for a, b in portions([len(t) + 1 for t in whole], PORTION):
            found, starts = grams(whole[a:b])
            scores.append(np.add.reduceat(log[key.get_indexer(found)], starts))
            words, sizes = split_words(whole[a:b])
            words = words.dictionary_encode()
            place = pc.index_in(words.dictionary, value_set=known_words).to_numpy()
            # The end of each text follows its words.
            seen = np.insert(count[place][words.indices.to_numpy()], np.cumsum(sizes), ends)
            sizes = sizes + 1
            at = np.cumsum(sizes) - sizes
            tokens.append(sizes)
            known.append(np.add.reduceat(seen > 0, at, dtype=np.int64))
            base.append(np.add.reduceat(np.log10(seen + 1), at) - sizes * log_total)
        columns = [np.concatenate(x) for x in (tokens, known, base, scores)]
        return pa.Table.from_arrays([group.column("doc_id").combine_chunks(), *map(pa.array, columns)], names)

    kind = texts.schema["doc_id"].dataType.simpleString()
    done = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        run, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return done.withColumn("train_tokens", F.lit(trie.train_tokens).cast("bigint"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trie = pretrain(docs.where(fold("doc_id", FOLDS) != HELD_OUT))
    done = score(docs, trie)
    return done.select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
