"""Nearest neighbours by inner product from a vantage-point tree per shard.

Adding to every vector of a shard a coordinate that lifts it to the largest length there, and a zero
to the query, turns the largest inner product into the smallest distance, for which the triangle
inequality holds. A subtree is skipped if FACTOR times its lower bound exceeds the distance of the
worst neighbour found; with factor one the search is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentrace.llm.batches import fields
from agentrace.llm.registry import query, table

SHARD_ROWS, BLOCK_QUERIES, LEAF = 8192, 4096, 96
FACTOR = 1.15
#: Distinct vectors kept beyond k while scores still come from a matrix product.
SPARE = 4


class Node:
    """Rows of a subtree, or a vantage point with two children and their ranges of distance."""

    def __init__(self, rows, vantage=None, children=(), ranges=()):
        self.rows, self.vantage, self.children, self.ranges = rows, vantage, children, ranges


def vantage_tree(points: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Node:
    """A tree over ``rows`` of ``points``: the vantage point is the row farthest from the first."""
    if len(rows) <= leaf:
        return Node(rows)
    from_first = np.linalg.norm(points[rows] - points[rows[0]], axis=1)
    vantage = points[rows[int(from_first.argmax())]]
    far = np.linalg.norm(points[rows] - vantage, axis=1)
    inside = far <= np.median(far)
    if inside.all():
        return Node(rows)
    children, ranges = [], []
    for side in (inside, ~inside):
        children.append(vantage_tree(points, rows[side], leaf))
        ranges.append((far[side].min(), far[side].max()))
    return Node(None, vantage, children, ranges)


class Search:
    """All queries of a block walk a tree together; each keeps its best distinct vectors."""

    def __init__(self, vectors: np.ndarray, queries: np.ndarray, k: int, factor: float):
        lengths = np.einsum("ij,ij->i", vectors, vectors)
        self.most = lengths.max()
        self.points = np.column_stack((vectors, np.sqrt(np.maximum(self.most - lengths, 0))))
        self.vectors, self.queries, self.factor = vectors, queries, factor
        self.lifted = np.column_stack((queries, np.zeros(len(queries))))
        self.square = np.einsum("ij,ij->i", queries, queries) + self.most
        self.score = np.full((len(queries), k), -np.inf)
        self.row = np.full((len(queries), k), -1)

    def run(self) -> np.ndarray:
        root = vantage_tree(self.points, np.arange(len(self.points)))
        self.visit(root, np.arange(len(self.queries)))
        return self.row

    def visit(self, node: Node, active: np.ndarray) -> None:
        if node.vantage is None:
            self.take(node.rows, active)
            return
        far = np.linalg.norm(self.lifted[active] - node.vantage, axis=1)
        bounds = np.array([np.maximum(far - hi, lo - far) for lo, hi in node.ranges])
        first = bounds.argmin(axis=0)
        for turn in (0, 1):
            for side in (0, 1):
                mine = np.flatnonzero((first == side) == (turn == 0))
                reach = self.radius(active[mine])
                mine = mine[bounds[side, mine] * self.factor <= reach]
                if mine.size:
                    self.visit(node.children[side], active[mine])

    def radius(self, active: np.ndarray) -> np.ndarray:
        """Distance of the worst vector kept, a little enlarged against rounding."""
        square = self.square[active] - 2 * self.score[active, -1]
        return np.sqrt(np.maximum(square, 0)) * (1 + 1e-9) + 1e-9 * math.sqrt(self.most)

    def take(self, rows: np.ndarray, active: np.ndarray) -> None:
        score = self.queries[active] @ self.vectors[rows].T
        better = (score > self.score[active, -1][:, None]).any(axis=1)
        active, score = active[better], score[better]
        if not active.size:
            return
        score = np.hstack((self.score[active], score))
        row = np.hstack((self.row[active], np.broadcast_to(rows, (len(active), len(rows)))))
        best = np.argsort(-score, axis=1, kind="stable")[:, : self.score.shape[1]]
        self.score[active] = np.take_along_axis(score, best, axis=1)
        self.row[active] = np.take_along_axis(row, best, axis=1)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def shard_neighbours(ids, vectors, query_ids, queries, k: int, factor: float):
    """Arrays (query position, vector id, score): the k best of one shard for every query.

    Rows repeated with id and vector count once. Equal vectors are one point of the tree; of their
    ids the k + 1 smallest can matter, as one may be the query's own. Scores of what is found are
    computed anew, component by component, so that equal vectors tie exactly.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    distinct, of = np.unique(vectors, axis=0, return_inverse=True)
    once = np.unique(np.column_stack((ids, of.ravel())), axis=0, return_index=True)[1]
    ids, vectors, of = ids[once], vectors[once], of.ravel()[once]
    by_vector = np.argsort(of, kind="stable")
    start = np.searchsorted(of[by_vector], np.arange(len(distinct) + 1))
    found = Search(distinct, queries, k + 1 + SPARE, factor).run()
    out = []
    for q, rows in enumerate(found):
        rows = rows[rows >= 0]
        mine = np.concatenate([by_vector[start[r] : min(start[r + 1], start[r] + k + 1)] for r in rows])
        mine = mine[ids[mine] != query_ids[q]]
        score = np.cumsum(vectors[mine] * queries[q], axis=1)[:, -1]
        best = np.lexsort((ids[mine], -score))[:k]
        out.append((np.full(len(best), q), ids[mine][best], score[best]))
    return [np.concatenate(c) for c in zip(*out)]


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best vectors by inner product.

    The query's own id is left out; ties go to the smaller id; with fewer candidates all come.
    Vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null
    id, take no part; vectors meet only queries of their own length. Rows repeated with id and
    vector count once; a repeated query is answered once. An empty side gives no rows.

    Shards and query blocks are dealt by a hash of the id, so each holds a bounded share of the rows
    whatever the vectors are, and every block meets every shard once. The tree of a shard covers
    all its rows. What moves on is k rows per query and shard.
    """

    def chosen(df):
        vector = F.col(vector_col)
        return df.where(F.col(id_col).isNotNull() & usable(vector)).select(
            F.col(id_col).cast("long").alias("vec_id"),
            vector.cast("array<double>").alias("vector"),
            F.size(vector).alias("width"),
        )

    rows, asked = chosen(vectors), chosen(queries)
    shards = max(1, math.ceil(rows.count() / shard_rows))
    blocks = max(1, math.ceil(asked.count() / block_queries))
    dealt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("shard", dealt(shards, 1)).withColumn("block", every(blocks))
    right = (
        asked.withColumn("vector_hash", F.xxhash64("vector"))
        .withColumn("block", dealt(blocks, 2))
        .withColumn("shard", every(shards))
    )
    schema = fields(
        left, query_id="bigint", vector_hash="bigint", vec_id="bigint", score="double"
    )
    arrow = pa.schema(
        [("query_id", pa.int64()), ("vector_hash", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
    )

    def search(mine: pa.Table, asking: pa.Table) -> pa.Table:
        if not mine.num_rows or not asking.num_rows:
            return arrow.empty_table()
        width = mine.column("width")[0].as_py()
        names = asking.column("vec_id").to_numpy()
        hashes = asking.column("vector_hash").to_numpy()
        once = np.unique(np.column_stack((names, hashes)), axis=0, return_index=True)[1]
        names, hashes = names[once], hashes[once]
        at, ids, score = shard_neighbours(
            mine.column("vec_id").to_numpy(),
            matrix(mine.column("vector"), width),
            names,
            matrix(asking.column("vector"), width)[once],
            k,
            factor,
        )
        return pa.table([names[at], hashes[at], ids, score], schema=arrow)

    keys = ["width", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)
    best = Window.partitionBy("query_id", "vector_hash").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(c.e, q.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 20
"""


@query("op9_nearest_vectors", NEAREST_SQL)
def op9_nearest_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
