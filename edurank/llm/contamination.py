"""Benchmark decontamination on a positional inverted index.

The index holds (row, term, pos) of every word of the documents that a benchmark
item uses; a window is found from the postings of its rarest word, moved back by
the word's offset and intersected with the equally moved postings of the words
around it.  All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edurank.llm.common import ascii_lower, table, without_keys
from edurank.plans.joins import join_few_keys
from edurank.plans.materialize import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same words before A-Z are lowered.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10


def words(text: Column) -> Column:
    """Words of a text with A-Z in their first spelling; null has none."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(RAW_WORD), F.lit(0))


def lowered(word: Column) -> Column:
    """A-Z lowered; most words have none and are not rewritten."""
    return F.when(F.lower(word) == word, word).otherwise(ascii_lower(word))


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, ipos, word, size) of every item with words; equal rows count once."""
    rows = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("_words")).distinct()
    numbered = materialize(rows.withColumn("item", F.monotonically_increasing_id()))
    spread = numbered.select("item", "item_id", F.size("_words").alias("size"), F.posexplode("_words").alias("ipos", "_raw"))
    return spread.select("item", "item_id", "ipos", lowered(F.col("_raw")).alias("word"), "size")


@dataclass(frozen=True)
class PositionalIndex:
    """``rows``: (row, doc_id, n_words) of every document; ``postings``: (row, term, pos); ``terms``: (word, term, n)."""

    rows: DataFrame
    postings: DataFrame
    terms: DataFrame


def build_index(docs: DataFrame, vocabulary: DataFrame, doc_id: str = "doc_id", text: str = "text") -> PositionalIndex:
    """Index of the documents' words that occur in ``vocabulary`` (word), written to the shared folder.

    Every row of ``docs`` is a document of its own, also repeated ones.  Words and
    the document's word count are one pass over the texts; the last position of
    a row, which has no word, carries the count.
    """
    numbered = materialize(
        vocabulary.select("word").distinct().withColumn("term", F.monotonically_increasing_id())
    )
    split = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("_words")
    )
    spread = split.select("row", "doc_id", F.posexplode(F.array_append("_words", F.lit(None).cast("string"))).alias("pos", "_raw"))
    placed = spread.select("row", "doc_id", "pos", lowered(F.col("_raw")).alias("word"))
    known = join_few_keys(placed, numbered, ["word"], F.struct("row", "pos"), "left")
    stored = materialize(
        known.where("term is not null or word is null").select(
            "row", F.when(F.col("word").isNull(), F.col("doc_id")).alias("doc_id"), F.col("word").isNull().alias("last"), "term", "pos"
        )
    )
    postings = stored.where("not last").select("row", "term", "pos")
    counts = postings.groupBy("term").agg(F.count("*").alias("n"))
    terms = materialize(numbered.join(counts, "term", "left").select("word", "term", F.coalesce("n", F.lit(0)).alias("n")))
    return PositionalIndex(stored.where("last").select("row", "doc_id", F.col("pos").alias("n_words")), postings, terms)


def phrase_matches(index: PositionalIndex, item_terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, item, start, length): stretches of a document in which windows of an item lie end to end.

    ``item_terms`` is (item, ipos, term, n, size).  A window is ``window``
    consecutive words, of a shorter item all of them.
    """
    width = F.least(F.lit(window), F.col("size"))
    around = Window.partitionBy("item").orderBy("ipos").rowsBetween(0, window - 1)
    rarest = (
        item_terms.withColumn("_pick", F.min(F.struct("n", "ipos")).over(around))
        .where(F.col("ipos") + width <= F.col("size"))
        .select("item", F.col("_pick.ipos").alias("ipos"))
        .distinct()
        .join(item_terms, ["item", "ipos"])
        .where("n > 0")
        .select("item", "ipos", "term")
    )
    found = join_few_keys(index.postings, rarest, ["term"], F.struct("row", "pos")).select(
        "item", "row", "ipos", (F.col("pos") - F.col("ipos")).alias("shift")
    )
    near = rarest.select("item", F.col("ipos").alias("anchor")).join(item_terms.select("item", "ipos", "term"), "item")
    near = near.where((F.col("ipos") - F.col("anchor")).between(1 - window, window - 1))
    sought = (
        join_few_keys(found.withColumnRenamed("ipos", "anchor"), near, ["item", "anchor"], F.struct("row", "shift"))
        .select("item", "row", "shift", "ipos", "term", (F.col("shift") + F.col("ipos")).cast("int").alias("pos"))
        .where("pos >= 0")
        .distinct()
    )
    met = sought.join(index.postings.withColumnRenamed("pos", "_pos").selectExpr("row", "term", "_pos as pos"), ["row", "pos", "term"])
    place = Window.partitionBy("item", "row", "shift").orderBy("ipos")
    runs = (
        met.withColumn("_run", F.col("ipos") - F.row_number().over(place))
        .groupBy("item", "row", "shift", "_run")
        .agg(F.min("ipos").alias("first"), F.count("*").alias("length"))
    )
    sizes = item_terms.select("item", "size").distinct()
    return (
        join_few_keys(runs, sizes, ["item"], F.struct("row", "shift"))
        .where(F.col("length") >= width)
        .select("row", "item", (F.col("shift") + F.col("first")).alias("start"), "length")
    )


def proximity_matches(index: PositionalIndex, item_terms: DataFrame, reach: int) -> DataFrame:
    """(row, item, pos): places of an item's rarest word with all its other words at most ``reach`` words away."""
    wanted = item_terms.select("item", "term", "n").distinct()
    lead = wanted.groupBy("item").agg(F.min_by("term", F.struct("n", "term")).alias("lead"), F.count("*").alias("terms"))
    found = join_few_keys(index.postings, lead.withColumnRenamed("lead", "term"), ["term"], F.struct("row", "pos"))
    found = found.select("item", "terms", "row", F.col("pos").alias("at"))
    others = join_few_keys(index.postings, wanted.select("item", "term"), ["term"], F.struct("row", "pos"))
    # Neighbouring stretches of ``reach`` words make the range an equality.
    near = found.withColumn("stretch", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: d + F.floor(F.col("at") / reach))))
    there = others.withColumn("stretch", F.floor(F.col("pos") / reach))
    return (
        near.join(there, ["item", "row", "stretch"])
        .where(F.abs(F.col("pos") - F.col("at")) <= reach)
        .groupBy("row", "item", "at", "terms")
        .agg(F.count_distinct("term").alias("met"))
        .where("met = terms")
        .select("row", "item", F.col("at").alias("pos"))
    )


def item_matches(
    docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int
) -> tuple[PositionalIndex, DataFrame, DataFrame]:
    """Index of the documents, terms of the items, and matches (row, item, start, length)."""
    spelled = materialize(item_words(items, item_id, item_text))
    index = build_index(docs, spelled, doc_id, text)
    item_terms = materialize(spelled.join(index.terms, "word").select("item", "item_id", "ipos", "term", "n", "size"))
    return index, item_terms, materialize(phrase_matches(index, item_terms, window))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; items without words have no window.  Items
    with one id count once; items without an id hit words but are not listed.
    Without items or documents nothing is hit.  Other columns are not read.
    """
    index, item_terms, matches = item_matches(docs, items, doc_id, text, item_id, item_text, window)
    hit = (
        matches.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos"))
        .distinct()
        .groupBy("row")
        .agg(F.count("*").alias("n_hit"))
    )
    names = item_terms.select("item", F.col("item_id").cast("string").alias("name")).distinct()
    named = join_few_keys(matches.select("row", "item").distinct(), names, ["item"], F.col("row"))
    listed = named.groupBy("row").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return (
        index.rows.join(hit, "row", "left")
        .join(listed, "row", "left")
        .select(
            "doc_id",
            F.col("n_words").cast("bigint").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce(F.size("names"), F.lit(0)).cast("bigint").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text is not contaminated, whatever their ids; the index knows a row by the hash of its text."""
    key = F.unhex(F.sha2(F.col(text).cast("string"), 256))
    hashed = docs.select(key.alias("key"), F.col(text).alias("text"))
    index, _, matches = item_matches(hashed, items, "key", "text", item_id, item_text, WINDOW)
    hit = index.rows.join(matches.select("row").distinct(), "row", "left_semi")
    return without_keys(docs, key, hit.select("doc_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
), items as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
), wanted as (
    select distinct item_id, least(10, len(w)) as size, list_slice(w, i, i + least(10, len(w)) - 1) as phrase
    from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)
), sizes as (
    select distinct size from wanted
), starts as (
    select doc_id, size, i, list_slice(w, i, i + size - 1) as phrase
    from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from words, sizes where len(w) >= size)
), met as (
    select doc_id, i, wanted.size, item_id from starts join wanted on starts.size = wanted.size and starts.phrase = wanted.phrase
), hit as (
    select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from met) group by doc_id
), named as (
    select doc_id, count(*) as n_items, string_agg(name, ',' order by name) as names
    from (select distinct doc_id, cast(item_id as varchar) as name from met) group by doc_id
)
select words.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from words left join hit using (doc_id) left join named using (doc_id)
"""
