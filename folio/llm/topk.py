"""Exact top-k search by inner product: KD-trees per shard.

Vectors are dealt to shards of bounded size and each shard gets a KD-tree: median splits along the widest dimension,
down to leaves, each node with its tight bounding box. A box bounds a query's product with every vector inside by
sum(max(q * low, q * high)). A query visits the leaves best bound first, and stops at the first whose bound is below
its kth score so far. The search runs in two waves: in the first, every block of queries searches one shard; its kth
scores are then carried to all other shards, where they cut off boxes from the start. Bounds are never rounded down,
and a leaf whose bound equals the kth score is opened, so ties are settled exactly.

A task holds one shard and one block of queries, both of bounded size, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import stored

#: Vectors of a shard and queries of a block, about; shards at least; vectors of a leaf; queries scored at a time.
SHARD_ROWS, BLOCK_ROWS, LEAST_SHARDS, LEAF_ROWS, STRIP = 8192, 4096, 24, 256, 512


class KDTree:
    """Tight boxes around median splits. Rows are whole numbers of any size; vectors without a component are one leaf."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(rows))
        self.rows = rows
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, end, left child, right child (-1: leaf)
        self.low, self.high = [], []
        self._grow(0, len(rows), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, a: int, b: int, leaf: int) -> int:
        own = self.rows[self.order[a:b]]
        low, high = own.min(0), own.max(0)
        at = len(self.nodes)
        self.nodes.append((a, b, -1, -1))
        self.low.append(low)
        self.high.append(high)
        widest = int(np.argmax(high - low)) if len(low) else 0
        if b - a > leaf and len(low) and high[widest] > low[widest]:
            middle = (a + b) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, widest], middle - a)]
            self.nodes[at] = (a, b, self._grow(a, middle, leaf), self._grow(middle, b, leaf))
        return at

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of each query's product with each node's rows."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.high.T + down @ self.low.T

    def reachable_leaves(self, bounds: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """queries x nodes: leaves all of whose ancestors may hold a score as high as the kth."""
        live, leaves = np.zeros(bounds.shape, bool), np.zeros(bounds.shape, bool)
        live[:, 0] = bounds[:, 0] >= kth
        for n, (_, _, left, right) in enumerate(self.nodes):  # parents come before their children
            if left < 0:
                leaves[:, n] = live[:, n]
            else:
                for child in (left, right):
                    live[:, child] = live[:, n] & (bounds[:, child] >= kth)
        return leaves


def _upwards(bounds: np.ndarray, exact) -> np.ndarray:
    """Bounds as floats that are never below them."""
    out = bounds.astype(np.float64)
    return out if exact in (np.float32, np.float64) else np.nextafter(out, np.inf)


def _long(score: np.ndarray) -> np.ndarray:
    """Scores as longs; those beyond a long's range as its ends."""
    if score.dtype != object:
        return score.astype(np.int64)
    ends = np.iinfo(np.int64)
    return np.array([[min(max(int(x), ends.min + 2), ends.max) for x in row] for row in score], np.int64).reshape(score.shape)


def search_shard(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k best of this shard that aren't below its kth score so far: query index, vec_id, score."""
    by_id = np.argsort(ids, kind="stable")
    ids, rows = ids[by_id], rows[by_id]
    most = lambda x: max(1, int(x.max(initial=0)), -int(x.min(initial=0)))  # noqa: E731  # the lowest long has no positive
    top = most(rows) * most(queries) * max(rows.shape[1], 1)
    # whole numbers below 2**24 and 2**52 are exact as floats; products beyond 64 bits are made of Python's integers
    exact = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 52 else np.int64 if top < 1 << 62 else object
    tree = KDTree(rows)
    cast, n = rows.astype(exact), len(rows)
    low, high = tree.low.astype(exact), tree.high.astype(exact)
    tree.low, tree.high = low, high
    found = []
    none = np.iinfo(np.int64).min + 1  # so that its negative is a number too
    for a in range(0, len(queries), STRIP):
        q, own_ids = queries[a : a + STRIP].astype(exact), query_ids[a : a + STRIP]
        limit = kth[a : a + STRIP].astype(np.float64)
        bounds = _upwards(tree.bounds(q), exact)
        open_ = tree.reachable_leaves(bounds, limit)
        leaves = np.flatnonzero(open_.any(0))
        # best first: each query's leaves in order of their bounds
        rank = np.argsort(np.where(open_[:, leaves], -bounds[:, leaves], np.inf), axis=1, kind="stable")
        best_score = np.full((len(q), k), none, np.int64)
        best_row = np.full((len(q), k), n, np.int64)
        for step in range(len(leaves)):
            leaf_of = leaves[rank[:, step]]
            go = open_[np.arange(len(q)), leaf_of] & (bounds[np.arange(len(q)), leaf_of] >= limit)
            if not go.any():
                break
            for leaf in np.unique(leaf_of[go]):
                who = np.flatnonzero(go & (leaf_of == leaf))
                first, end = tree.nodes[leaf][:2]
                members = tree.order[first:end]
                score = _long(q[who] @ cast[members].T)
                take = (score >= limit[who, None]) & (ids[members][None, :] != own_ids[who, None])
                for i in np.flatnonzero(take.any(1)):
                    j = np.flatnonzero(take[i])
                    s = np.concatenate([best_score[who[i]], score[i, j]])
                    m = np.concatenate([best_row[who[i]], members[j]])
                    keep = np.lexsort((m, -s))[:k]  # rows are in order of vec_id
                    best_score[who[i]], best_row[who[i]] = s[keep], m[keep]
                    if s[keep[-1]] > none:
                        limit[who[i]] = max(limit[who[i]], np.nextafter(float(s[keep[-1]]), -np.inf) if abs(int(s[keep[-1]])) >= 1 << 53 else float(s[keep[-1]]))
        qi, slot = np.nonzero(best_row < n)
        found.append((qi + a, ids[best_row[qi, slot]], best_score[qi, slot]))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*found))


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.int64).reshape(len(vectors), -1)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products, ties to the smaller vec_id.

    Both frames have vec_id and vector (array<bigint>). Rows with a null vec_id, a null vector or a null component take
    no part; a query meets candidates of its own length only, and never those with its own vec_id. Repeated candidates
    are ranked each. A query with fewer candidates gets all; with none, no row. Empty tables give an empty result.
    Vectors without a component score 0 with each other. A score beyond a long's range counts as its end.
    """
    valid = lambda df: df.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())).select(F.col("vec_id").cast("long").alias("vec_id"), "vector", F.size("vector").alias("dims"))
    candidates, queries = stored(valid(candidates), "vectors"), stored(valid(queries), "queries")
    n, m = candidates.count(), queries.count()
    shards, blocks = max(LEAST_SHARDS, -(-n // SHARD_ROWS)), max(1, -(-m // BLOCK_ROWS))
    shard_of, block_of = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(blocks)).cast("int")
    everywhere = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    dealt = candidates.withColumn("shard", shard_of).select("*", everywhere("block", blocks))
    asked = queries.withColumn("block", block_of)
    home = F.pmod(F.col("block") * 7, F.lit(shards)).cast("int")

    def run(pdf):
        own, ask = pdf[~pdf.asks], pdf[pdf.asks]
        if not len(own) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        kth = ask.kth.to_numpy(np.float64)
        qi, vec, score = search_shard(own.vec_id.to_numpy(np.int64), _stacked(own.vector), ask.vec_id.to_numpy(np.int64), _stacked(ask.vector), kth, k)
        return pd.DataFrame({"query_id": ask.vec_id.to_numpy(np.int64)[qi], "vec_id": vec, "score": score})

    def wave(own: DataFrame, ask: DataFrame) -> DataFrame:
        both = own.select("shard", "block", "dims", "vec_id", "vector", F.lit(False).alias("asks"), F.lit(0.0).alias("kth")).unionByName(
            ask.select("shard", "block", "dims", "vec_id", "vector", F.lit(True).alias("asks"), F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
        )
        return both.groupBy("shard", "block", "dims").applyInPandas(run, "query_id long, vec_id long, score long")

    first = stored(wave(dealt.where(F.col("shard") == home), asked.select("*", home.alias("shard"), F.lit(None).cast("double").alias("kth"))), "first")
    # a query has k rows of the first wave at most
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), F.when(F.abs(F.col("low")) < 2**53, F.col("low").cast("double")).otherwise(F.col("low").cast("double") - F.abs(F.col("low").cast("double")) * 2.0**-50).alias("kth"))
    rest = asked.join(kth, "vec_id", "left").select("*", everywhere("shard", shards)).where(F.col("shard") != home)
    later = wave(dealt.where(F.col("shard") != home), rest)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(later).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir):
    """Vectors of floor(64 * x); those that are null or hold a component that is null or not finite take no part."""
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    whole = x.where(~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    vectors = whole.select("vec_id", F.transform("embedding", lambda e: F.floor(e.cast("double") * 64).cast("long")).alias("vector"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.vector, c.vector), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vector) = len(c.vector) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
