"""Merkle manifest of a dataset: one tree per source, and one over the sources.

Per level, lag and lead columns of fixed offsets give a node its siblings, masked
by its slot in the run and by the length of the run; the first child of a run
hashes the parent.  Windows hold one run each, so a source with a third of
all rows is spread like any other.  Paths go down the levels again, each node
taking over what its parent has.  Everything is hashed with sha256, digests
are lower-case hex and count as text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edurank.llm.common import UPPER, column, table
from edurank.plans.joins import join_few_keys
from edurank.plans.materialize import materialize
from edurank.plans.paging import with_row_number

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(values: Sequence[Column]) -> Column:
    """Digest of a row: per value ``-`` if null, else its UTF-8 byte count, a colon and the value."""

    def told(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(told, values)), 256)


def with_siblings(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """``nodes`` (tree, pos, size, hash, ...) with run, slot and the joined digests left and right of a node in its run."""
    order = Window.partitionBy("tree", "run").orderBy("pos")
    placed = nodes.selectExpr("*", f"pos div {fan} as run", f"pos % {fan} as slot").withColumn(
        "length", F.least(F.lit(fan), F.col("size") - F.col("run") * fan)
    )
    before = [F.when(F.col("slot") >= k, F.lag("hash", k).over(order)) for k in range(fan - 1, 0, -1)]
    behind = [F.when(F.col("slot") + k < F.col("length"), F.lead("hash", k).over(order)) for k in range(1, fan)]
    return placed.withColumns({"left": F.concat_ws("", *before), "right": F.concat_ws("", *behind)}).drop("length")


def parents(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """The next level of every tree that has more than one node left."""
    first = with_siblings(nodes.where("size > 1"), fan).where("slot = 0")
    return first.select(
        "tree", F.col("run").alias("pos"), F.expr(f"(size + {fan - 1}) div {fan}").alias("size"),
        F.sha2(F.concat("hash", "right"), 256).alias("hash"),
    )


def levels(leaves: DataFrame, largest: int, fan: int = FAN) -> list[DataFrame]:
    """The levels above ``leaves`` up to the single node of the largest tree."""
    found: list[DataFrame] = []
    while largest > 1:
        found.append(materialize(parents(found[-1] if found else leaves.select("tree", "pos", "size", "hash"), fan)))
        largest = -(-largest // fan)
    return found


def _downwards(nodes: DataFrame, above: DataFrame | None, tops: DataFrame, fan: int) -> DataFrame:
    """``nodes`` with what their parents, or at the top of a tree its row of ``tops``, hand down.

    ``steps`` are the siblings (left, right) level by level, own level first.
    """
    handed = [c for c in tops.columns if c not in ("tree", "steps")]
    columns = [c for c in nodes.columns if c not in handed]
    done = nodes.where("size = 1").join(tops, "tree").select(*columns, *handed, "steps")
    if above is None:
        return done
    beyond = above.select("tree", F.col("pos").alias("run"), *handed, F.col("steps").alias("_above"))
    joined = with_siblings(nodes.where("size > 1"), fan).join(beyond, ["tree", "run"])
    steps = F.concat(F.array(F.struct("left", "right")), "_above").alias("steps")
    return joined.select(*columns, *handed, steps).unionByName(done)


def with_paths(leaves: DataFrame, above: Sequence[DataFrame], tops: DataFrame, fan: int = FAN) -> DataFrame:
    """``leaves`` with ``steps`` and the other columns of ``tops`` (tree, steps, ...), handed down level by level."""
    path = None
    for nodes in reversed(above):
        path = materialize(_downwards(nodes.select("tree", "pos", "size", "hash"), path, tops, fan))
    return _downwards(leaves, path, tops, fan)


def _tops(leaves: DataFrame, above: Sequence[DataFrame]) -> DataFrame:
    """The single node that each tree ends in: tree, hash."""
    ends = [nodes.where("size = 1").select("tree", "hash") for nodes in (leaves, *above)]
    return reduce(DataFrame.unionByName, ends)


def manifest(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    fields: Sequence[str] = FIELDS,
    carried: Mapping[str, Column] | None = None,
    fan: int = FAN,
) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, steps, and what ``carried`` names.

    Leaves of a source ascend by id (null ids first, equal ids by digest);
    subroots ascend by source, the null source first.  ``steps`` are the
    siblings of a leaf and of the nodes above it, an array of (left, right).  A
    null field is told apart from an empty one.  Repeated rows are leaves of
    their own.  An empty table has no root and gives no row.  Columns beside
    ``fields`` play no part, whatever their names; ``carried`` expressions are
    taken from ``docs``.
    """
    more = [F.struct(*(value.alias(name) for name, value in carried.items())).alias("_carried")] if carried else []
    key = column(source).cast("string")
    leaves = materialize(
        docs.select(
            # The empty text stands for no source and sorts first.
            F.coalesce(F.concat(F.lit("."), key), F.lit("")).alias("_key"),
            column(doc_id).alias("doc_id"),
            leaf_hash([column(f) for f in fields]).alias("hash"),
            *more,
        )
    )
    # Equal rows may come in any order: their digests are equal.
    counted = leaves.withColumn("_nth", F.monotonically_increasing_id())
    numbered = with_row_number(counted, [F.col(c) for c in ("_key", "doc_id", "hash", "_nth")], "_row").drop("_nth")
    per_source = materialize(numbered.groupBy("_key").agg(F.min("_row").alias("_first"), F.count("*").alias("size")))
    sources = materialize(
        with_row_number(per_source, [F.col("_key")], "_place").selectExpr("_key", "_first", "size", "_place - 1 as tree")
    )
    count, largest = sources.agg(F.count("*"), F.max("size")).first()
    placed = join_few_keys(numbered, sources, ["_key"], F.col("_row"))
    nodes = materialize(placed.selectExpr("tree", "_row - _first as pos", "size", "hash", "doc_id", *(["_carried"] if more else [])))

    above = levels(nodes, largest or 0, fan)
    subroots = materialize(
        _tops(nodes, above).selectExpr("0L as tree", "tree as pos", f"{count}L as size", "hash")
    )
    higher = levels(subroots, count, fan)
    last = _tops(subroots, higher).first()
    root = F.lit(last.hash if last else None).cast("string")
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    summit = docs.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("tree"), nothing.alias("steps"))
    tops = with_paths(subroots, higher, summit, fan).select(
        F.col("pos").alias("tree"), F.col("hash").alias("subroot"), "steps"
    )
    done = with_paths(nodes, above, materialize(tops), fan)
    return done.select("doc_id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), "steps", *(["_carried.*"] if more else []))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    return F.aggregate(steps, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof_hash(steps: Column) -> Column:
    """Digest of the siblings on the way to the root."""
    return F.sha2(F.concat_ws("", F.transform(steps, lambda step: F.concat(step["left"], step["right"]))), 256)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    values = {f: column(f) for f in FIELDS} | {"text": F.translate("text", UPPER, UPPER.lower())}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_hash(list(values.values())))
    rows = manifest(docs, carried={"tampered": tampered})
    end = folded(F.coalesce("tampered", "leaf"), F.col("steps"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_hash(F.col("steps")).alias("proof_sha256"), end.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = f"""
with recursive rows as (
    select doc_id, text, lang, n_chars, source, case when source is null then '' else '.' || source end as key,
        translate(text, '{UPPER}', '{UPPER.lower()}') as lowered,
        list_reduce(
            list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
            lambda crc, byte: list_reduce(
                list_prepend(xor(crc, byte), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
                lambda c, bit: xor(c >> 1, 3988292384 * (c & 1))
            )
        ) as crc
    from documents
), told as (
    select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-')
        || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
        || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') as others
    from rows
), leaves as (
    select doc_id, key, sha256(others || coalesce(strlen(text) || ':' || text, '-')) as leaf,
        case when xor(crc, 4294967295) % 5 = 0
            then sha256(others || coalesce(strlen(lowered) || ':' || lowered, '-')) end as tampered
    from told
), placed as (
    select *, row_number() over (partition by key order by doc_id nulls first, leaf) - 1 as pos,
        count(*) over (partition by key) as size
    from leaves
), nodes as (
    select 0 as level, key, pos, size, leaf as hash from placed
    union all
    select level + 1, key, pos // 16, (size + 15) // 16, sha256(string_agg(hash, '' order by pos))
    from nodes where size > 1 group by level, key, pos // 16, size
), subroots as (
    select key, hash, row_number() over (order by key) - 1 as pos, count(*) over () as size from nodes where size = 1
), tops as (
    select 0 as level, pos, size, hash from subroots
    union all
    select level + 1, pos // 16, (size + 15) // 16, sha256(string_agg(hash, '' order by pos))
    from tops where size > 1 group by level, pos // 16, size
), steps as (
    select level, key, pos,
        coalesce(string_agg(hash, '') over (w rows between unbounded preceding and 1 preceding), '') as before,
        coalesce(string_agg(hash, '') over (w rows between 1 following and unbounded following), '') as behind
    from nodes where size > 1 window w as (partition by level, key, pos // 16 order by pos)
), top_steps as (
    select level, pos,
        coalesce(string_agg(hash, '') over (w rows between unbounded preceding and 1 preceding), '') as before,
        coalesce(string_agg(hash, '') over (w rows between 1 following and unbounded following), '') as behind
    from tops where size > 1 window w as (partition by level, pos // 16 order by pos)
), ways as (
    select p.key, p.pos, s.level, s.before, s.behind
    from placed p join steps s on s.key = p.key and s.pos = p.pos // (16 ** s.level)::bigint
    union all
    select p.key, p.pos, 100 + t.level, t.before, t.behind
    from placed p join subroots r on r.key = p.key join top_steps t on t.pos = r.pos // (16 ** t.level)::bigint
), joined as (
    select key, pos, string_agg(before || behind, '' order by level) as siblings,
        list(before || '|' || behind order by level) as way
    from ways group by key, pos
), ends as (
    select p.doc_id, p.leaf, r.hash as subroot, (select hash from tops where size = 1) as root,
        sha256(coalesce(j.siblings, '')) as proof_sha256,
        list_reduce(
            list_prepend(coalesce(p.tampered, p.leaf), coalesce(j.way, [])),
            lambda digest, step: sha256(split_part(step, '|', 1) || digest || split_part(step, '|', 2))
        ) as folded_root
    from placed p join subroots r on r.key = p.key left join joined j on j.key = p.key and j.pos = p.pos
)
select *, folded_root = root as verified from ends
"""
