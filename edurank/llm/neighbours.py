"""Nearest neighbours by inner product with one vantage-point tree per shard.

One more coordinate gives all vectors the same length, so the largest inner
product is the smallest Euclidean distance and the triangle inequality holds.  A
tree's leaf is skipped for a query if the distances to the vantage points above
it show that its points are farther than the worst neighbour found, times a
factor: one is exact, more skips more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edurank.llm.common import shares, table
from edurank.plans.materialize import materialize

NEIGHBOURS = 20
QUERY_EVERY = 20
FACTOR = 1.0
SHARD = 4_096
LEAF = 128
# Queries that one task puts to one tree.
QUERIES = 8_192
# Numbers held at once when inner products are added in order.
HELD = 1 << 21
# Rounding of a matrix product, as a share of the product of the lengths per component.
ROUNDING = 1e-15


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def inner_products(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, added from the first component to the last."""
    return np.cumsum(points * query, axis=1)[:, -1]


@dataclass
class VantageTree:
    """Points in leaf order, and for every leaf the range of its distances to each vantage point above."""

    ids: np.ndarray
    points: np.ndarray
    vantages: np.ndarray
    leaves: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]
    length: float

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, length: float) -> VantageTree:
        """``length`` is the largest Euclidean norm of all shards."""
        lifted = np.column_stack((points, np.sqrt(np.maximum(0, length**2 - (points**2).sum(axis=1)))))
        vantages: list[np.ndarray] = []
        order: list[np.ndarray] = []
        leaves = []
        todo = [(np.arange(len(points)), [], [])]
        done = 0
        while todo:
            rows, above, distances = todo.pop()
            if len(rows) > LEAF:
                vantage = lifted[rows[len(rows) // 2]]
                far = np.sqrt(((lifted[rows] - vantage) ** 2).sum(axis=1))
                inside = far <= np.median(far)
                if not inside.all():
                    above = [*above, len(vantages)]
                    vantages.append(vantage)
                    for side in (inside, ~inside):
                        todo.append((rows[side], above, [*(d[side] for d in distances), far[side]]))
                    continue
            low = np.array([d.min() for d in distances])
            high = np.array([d.max() for d in distances])
            leaves.append((done, done + len(rows), np.array(above, np.int64), low, high))
            order.append(rows)
            done += len(rows)
        turn = np.concatenate(order)
        return cls(ids[turn], points[turn], np.array(vantages).reshape(len(vantages), lifted.shape[1]), leaves, length)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, id, inner product) of the ``k`` nearest points of other ids."""
        lifted = np.column_stack((queries, np.zeros(len(queries))))
        to_vantage = np.sqrt(np.maximum(0, ((lifted[:, None, :] - self.vantages[None, :, :]) ** 2).sum(axis=2)))
        bound = np.zeros((len(queries), len(self.leaves)))
        for n, (_, _, above, low, high) in enumerate(self.leaves):
            if len(above):
                distance = to_vantage[:, above]
                bound[:, n] = np.maximum(np.maximum(distance - high, low - distance), 0).max(axis=1)
        turn = np.argsort(bound, axis=1, kind="stable")
        best = np.full((len(queries), k), -np.inf)
        near = np.zeros((len(queries), k), self.ids.dtype)
        square = (queries**2).sum(axis=1) + self.length**2
        slack = ROUNDING * (queries.shape[1] + 1) * square
        for step in range(len(self.leaves)):
            leaf = turn[:, step]
            worst = np.sqrt(np.maximum(0, square - 2 * best[:, -1] + 1e-12 * square))
            open_ = bound[np.arange(len(queries)), leaf] * factor <= worst * (1 + 1e-9) + 1e-9
            for n in np.unique(leaf[open_]):
                self._meet(n, np.flatnonzero(open_ & (leaf == n)), queries, own, slack, best, near)
        row, place = np.nonzero(np.isfinite(best))
        return row, near[row, place], best[row, place]

    def _meet(
        self, leaf: int, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, slack: np.ndarray, best: np.ndarray, near: np.ndarray
    ) -> None:
        """Bring the points of a leaf into the best of the queries ``rows``, ordered by (inner product, smaller id).

        The matrix product only rules out points below the worst place beyond its
        rounding; all others, however many tie, are compared by the exact order.
        """
        k = best.shape[1]
        a, b = self.leaves[leaf][:2]
        about = np.where(self.ids[a:b] == own[rows, None], -np.inf, queries[rows] @ self.points[a:b].T)
        both = np.concatenate((best[rows], about), axis=1)
        least = np.partition(both, both.shape[1] - k, axis=1)[:, -k]
        q, p = np.nonzero((about >= (least - slack[rows])[:, None]) & (about > -np.inf))
        if not len(q):
            return
        each = max(1, HELD // queries.shape[1])
        score = np.concatenate(
            [inner_products(self.points[a + p[i : i + each]], queries[rows[q[i : i + each]]]) for i in range(0, len(q), each)]
        )
        met = np.unique(q)
        q = np.concatenate((np.repeat(met, k), q))
        ids = np.concatenate((near[rows[met]].ravel(), self.ids[a + p]))
        score = np.concatenate((best[rows[met]].ravel(), score))
        order = np.lexsort((ids, -score, q))
        starts = np.searchsorted(q[order], met)
        first = order[starts[:, None] + np.arange(k)]
        best[rows[met]], near[rows[met]] = score[first], ids[first]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = NEIGHBOURS,
    factor: float = FACTOR,
    shard: int = SHARD,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``vectors`` for each row of ``queries``.

    The score is the inner product in double precision; ties go to the smaller
    id, however many tie; rows of the query's own id are no candidates.  Null ids and unusable
    vectors take no part, vectors of another length are not compared.  Of equal
    vectors only the ``k + 1`` smallest ids can be a neighbour, so no more of
    them enter a tree.  Queries that repeat an id and vector count once.
    """
    if factor < 1:
        raise ValueError("a factor below one would keep leaves that exact search skips")

    def taken(df: DataFrame) -> DataFrame:
        kept = df.where(F.col(vec_id).isNotNull() & usable(F.col(vector)))
        return kept.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    same = Window.partitionBy("v").orderBy("id")
    candidates = materialize(
        taken(vectors).distinct().withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).drop("place")
    )
    asked = materialize(taken(queries).distinct())
    norm = F.sqrt(F.aggregate(F.col("v"), F.lit(0.0), lambda s, x: s + x * x))
    n, length = candidates.select(F.count("*"), F.max(norm)).first()
    n_shards, n_groups = shares(n, shard), shares(asked.count(), QUERIES)
    length = float(length or 0.0)

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        return df.select(
            F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other),
            F.size("v").alias("width"),
            "id",
            "v",
        )

    points = dealt(candidates, "shard", n_shards, "asker", n_groups)
    askers = dealt(asked, "asker", n_groups, "shard", n_shards)

    def run(own: pa.Table, other: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not len(own) or not len(other):
            return pa.Table.from_pylist([], schema=schema)
        own = own.sort_by("id")
        tree = VantageTree.build(own.column("id").to_numpy(), _matrix(own.column("v")), length)
        ids, parts = other.column("id").to_numpy(), []
        matrix = _matrix(other.column("v"))
        for at in range(0, len(ids), 256):
            row, found, score = tree.search(matrix[at : at + 256], ids[at : at + 256], k, factor)
            parts.append(pa.Table.from_arrays([pa.array(ids[at + row]), pa.array(found), pa.array(score)], schema=schema))
        return pa.concat_tables(parts)

    key = ["shard", "asker", "width"]
    partial = points.groupBy(*key).cogroup(askers.groupBy(*key)).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(ranks))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


ORACLE = """
with usable as (
    select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored as (
    select q.vec_id as query_id, c.vec_id,
           list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) as score
    from usable q join usable c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
    where q.vec_id % 20 = 0
), ranked as (
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""
