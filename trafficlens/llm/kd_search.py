"""Exact top-k by inner product with KD-trees: one tree a shard, boxes bound what they can hold.

A tree splits its vectors at the median of the widest dimension until few are left, and keeps the
tight bounding box of every leaf. No vector in a box scores more than the sum, over dimensions, of
the larger of query times lower and query times upper edge. A query visits the leaves of a tree
best bound first and stops when the bound falls below its kth score. That score is carried from
tree to tree: a first round searches one shard, its kth score prunes all others.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Vectors in a shard at most, on average; in a leaf at most; queries that one task searches.
SHARD = 8192
LEAF = 64
BLOCK = 1024
SCALE = 256


class KdTree:
    """Leaves of a median-split tree: rows in leaf order, and each leaf's box."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        order, self.bounds = [], [0]
        todo = [np.argsort(ids, kind="stable")]
        while todo:
            rows = todo.pop()
            spread = vectors[rows].max(axis=0) - vectors[rows].min(axis=0)
            if len(rows) <= LEAF or not spread.any():
                order.append(rows)
                self.bounds.append(self.bounds[-1] + len(rows))
                continue
            at = np.argsort(vectors[rows, int(np.argmax(spread))], kind="stable")
            todo += [rows[at[len(rows) // 2 :]], rows[at[: len(rows) // 2]]]
        order = np.concatenate(order)
        self.vectors, self.ids = vectors[order], ids[order]
        starts = self.bounds[:-1]
        self.low = np.minimum.reduceat(self.vectors, starts, axis=0)
        self.high = np.maximum.reduceat(self.vectors, starts, axis=0)

    def search(self, query: np.ndarray, own, k: int, least: int | None):
        """The k best (score, id) other than ``own``; none below ``least``, which others reach."""
        bound = np.where(query > 0, query * self.high, query * self.low).sum(axis=1)
        best = []
        for leaf in np.argsort(-bound, kind="stable").tolist():
            if least is not None and bound[leaf] < least:
                break
            a, b = self.bounds[leaf], self.bounds[leaf + 1]
            scores = self.vectors[a:b] @ query
            near = np.arange(b - a) if least is None else np.flatnonzero(scores >= least)
            best += [(-s, i) for s, i in zip(scores[near].tolist(), self.ids[a:b][near].tolist(), strict=True) if i != own]
            if len(best) >= k:
                best = sorted(best)[:k]
                least = -best[-1][0] if least is None else max(least, -best[-1][0])
        return [(-s, i) for s, i in sorted(best)[:k]]


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dims, v): floor(scale * x) of vectors without null or non-finite components.

    A null vector, or a row with a null id, takes no part.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    v = F.transform("embedding", lambda c: F.floor(c * float(scale)).cast("long"))
    return rows.select("vec_id", F.size("embedding").alias("dims"), v.alias("v"))


def _matrix(column, dims: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten().to_numpy()).reshape(-1, dims)


HITS = "query_id long, score long, vec_id long"


def _searched(queries: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """HITS of query blocks (dims, shard, block, query_id, v, least) in their shards' trees."""

    def rows(key, left, right):
        import pyarrow as pa

        found = []
        if left.num_rows and right.num_rows:
            dims = key[0].as_py()
            tree = KdTree(_matrix(right.column("v"), dims), right.column("vec_id").to_numpy())
            least = left.column("least").to_pylist()
            for i, (q, own) in enumerate(zip(_matrix(left.column("v"), dims), left.column("query_id").to_pylist(), strict=True)):
                found += [(own, s, other) for s, other in tree.search(q, own, k, least[i])]
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "score", "vec_id"), columns, strict=True)})

    keys = ["dims", "shard", "block"]
    # both sides come from one table: new names tell their columns apart
    queries, shards = queries.toDF(*queries.columns), shards.toDF(*shards.columns)
    return queries.groupBy(*keys).cogroup(shards.groupBy(*keys)).applyInArrow(rows, HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = F.struct((-F.col("score")).alias("down"), F.col("vec_id"))
    return hits.distinct().groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(order)), 1, k).alias("best"))


def top_inner_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best partners of each query, exactly.

    Queries are the vectors whose id is divisible by ``every``; partners are all other ids of the
    same number of dimensions. Scores are inner products of floor(scale * x) in 64-bit integers
    (components up to 2**24 in 64 dimensions are safe). Ties go to the smaller id; a query with
    fewer partners gets all. Vectors that are null or hold null or non-finite components take no
    part, nor do rows with a null id. Repeated rows count once. An empty table gives no rows.
    """
    rows = stored(whole_numbers(vectors, scale).distinct(), "whole")
    counts = rows.groupBy("dims").agg(F.ceil(F.count("*") / SHARD).alias("shards"))
    shard = F.pmod(F.xxhash64("vec_id"), F.col("shards"))
    placed = stored(rows.join(counts, "dims").withColumn("shard", shard), "shards")
    asked = placed.where(F.pmod("vec_id", F.lit(every)) == 0)
    block = F.floor(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 << 20)))
    per = asked.groupBy("dims").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    asked = asked.join(per, "dims").withColumn("block", F.pmod(block, F.col("blocks")).cast("long"))
    asked = asked.select("dims", "shards", "blocks", "shard", "block", F.col("vec_id").alias("query_id"), "v")
    trees = placed.join(per, "dims").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    trees = trees.select("dims", "shard", "block", "vec_id", "v")
    # round one: the first shard; its kth score is one that the answer reaches
    home = asked.withColumns({"shard": F.lit(0).cast("long"), "least": F.lit(None).cast("long")})
    columns = ["dims", "shard", "block", "query_id", "v", "least"]
    first = stored(_searched(home.select(columns), trees.where("shard = 0"), k), "first")
    reached = _best(first, k).where(F.size("best") >= k).select("query_id", (-F.element_at("best", -1)["down"]).alias("least"))
    # round two: all other shards
    others = asked.where("shards > 1").withColumn("shard", F.explode(F.sequence(F.lit(1).cast("long"), F.col("shards") - 1)))
    others = others.join(reached, "query_id", "left").select(columns)
    more = _searched(others, trees.where("shard > 0"), k)
    best = _best(first.union(more), k).select("query_id", F.posexplode("best").alias("at", "hit"))
    return best.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.down")).alias("score")
    )
