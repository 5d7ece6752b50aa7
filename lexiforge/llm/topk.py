"""Operator 6: exact top-k inner products by MaxScore over sharded postings.

Vector components become integers.  A term is a dimension with a sign: its postings in a shard are the vectors whose
component has that sign.  A query gains only from the terms with the signs of its own components, and a term's bound is the
query's weight times the largest component in the shard.  Terms are ordered by bound; with the k-th best score so far as
threshold, the longest run of small terms whose bounds add up to less is non-essential: a vector outside the postings of
all essential terms cannot reach the threshold.  The essential postings are traversed, and the candidates are probed in the
other dimensions, bound after bound, while they can still compete.  A shard gives its k best for each query; shards merge.

Shards are hash buckets of about ``shard_rows`` vectors and queries come in blocks of ``block_rows``; a task sees one block
and one shard.  That is a stated query set against all rows, in blocks: neither side is broadcast or held whole.

Defined results: a vector that is null or holds a null or a non-finite component takes no part; vectors of unequal length
are compared over the dimensions that both have; an empty vector scores 0 with everything; equal scores go to the smaller
id; rows that repeat an id are candidates each; a query row that repeats is asked once, and rows that share an id but not the
vector are queries of their own, each with its ranks (their id is never their candidate); a null id takes no part; a score beyond the 64-bit range is the nearest 64-bit number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
K = 10
SHARD_ROWS = 8192
BLOCK_ROWS = 1024
#: Integers that a double holds exactly.
EXACT = 2 ** 53


def _matrix(column: pa.ChunkedArray, width: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), zero-padded to ``width``; int64, or Python integers where products could overflow."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), lengths)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, at] = values
    return out


class Shard:
    """The vectors of a shard, in id order, with the largest component of each term."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.columns = np.ascontiguousarray(self.vectors.T)
        self.top = np.stack([self.vectors.max(axis=0, initial=0), -self.vectors.min(axis=0, initial=0)])
        self.postings: dict[tuple[int, int], np.ndarray] = {}

    def posting(self, dim: int, sign: int) -> np.ndarray:
        if (dim, sign) not in self.postings:
            c = self.columns[dim]
            self.postings[dim, sign] = np.flatnonzero(c < 0 if sign else c > 0)
        return self.postings[dim, sign]

    def _best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[order], scores[order]

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k best and their scores."""
        if len(self.ids) == 0:
            return np.zeros(0, np.int64), np.zeros(0)
        sign = (query < 0).astype(int)
        bound = np.abs(query) * self.top[sign, np.arange(len(query))]
        terms = np.argsort(bound, kind="stable")
        terms = terms[query[terms] != 0]
        upto = np.cumsum(bound[terms])
        # A first threshold: the k largest components of the strongest term, and the neighbours by id as ties go.
        seed = np.arange(min(len(self.ids), 4 * k))
        if len(terms):
            strong = self.posting(int(terms[-1]), int(sign[terms[-1]]))
            top = 4 * k
            if len(strong) > top:
                weight = np.abs(self.columns[terms[-1]][strong])
                strong = strong[np.argpartition(-weight, top)[:top]]
            seed = np.union1d(seed, strong)
        seed = seed[self.ids[seed] != query_id]
        rows, scores = self._best(seed, self.vectors[seed] @ query, k)
        threshold = scores[k - 1] if len(scores) == k else -np.inf
        split = int(np.searchsorted(upto, threshold, side="left")) if threshold > 0 else 0
        other, essential = terms[:split], terms[split:]
        if split == 0:
            candidates = np.arange(len(self.ids))
        else:
            hit = np.zeros(len(self.ids), bool)
            for t in essential:
                hit[self.posting(int(t), int(sign[t]))] = True
            candidates = np.flatnonzero(hit)
        candidates = candidates[self.ids[candidates] != query_id]
        partial = self.vectors[np.ix_(candidates, essential)] @ query[essential] if split else self.vectors[candidates] @ query
        for j in range(split - 1, -1, -1):
            competitive = partial + upto[j] >= threshold
            if not competitive.all():
                candidates, partial = candidates[competitive], partial[competitive]
            partial = partial + query[other[j]] * self.columns[other[j]][candidates]
        return self._best(candidates, partial, k)


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE,
          shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row where ``is_query`` holds."""
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"))
    v = v.where(F.col("id").isNotNull() & _usable(F.col("v")))
    size = v.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("long")).alias("q"), F.max(F.size("v")).alias("w")).first()
    shards, blocks = max(1, -(-size["n"] // shard_rows)), max(1, -(-(size["q"] or 0) // block_rows))
    width = size["w"] or 0
    # The hash of the whole row deals out rows that share an id.
    data = v.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    # a row that repeats is asked once; rows that share an id but not the vector are queries of their own
    asks = v.where("asks").select("id", "v", F.xxhash64("v").alias("query")).dropDuplicates(["id", "query"])
    asked = asks.select("id", "v", "query", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
                                   F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))

    def task(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, a, b = left.column("id").to_numpy(), _matrix(left.column("v"), width, scale), _matrix(right.column("v"), width, scale)
        query_ids, queries = right.column("id").to_numpy(), right.column("query").to_numpy()
        if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1) >= EXACT:
            a, b = (np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (a, b))
            return _plain(ids, a, query_ids, queries, b, k)
        shard, out = Shard(ids, a), []
        for q, key, x in zip(query_ids, queries, b):
            rows, scores = shard.search(q, x, k)
            out.append((np.full(len(rows), q), np.full(len(rows), key), shard.ids[rows], scores.astype(np.int64)))
        return _table(out)

    found = data.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(task, "query_id long, query long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _table(out: list[tuple]) -> pa.Table:
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
    return pa.table(dict(zip(("query_id", "query", "vec_id", "score"), columns)))


def _plain(ids: np.ndarray, a: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, b: np.ndarray, k: int) -> pa.Table:
    """Components too large for exact doubles: every product in Python integers, one query at a time."""
    out = []
    for q, key, x in zip(query_ids, queries, b):
        scores = [min(max(int(s), -2**63), 2**63 - 1) for s in (a @ x if a.shape[1] else [0] * len(ids))]
        best = sorted((-s, i) for s, i in zip(scores, ids.tolist()) if i != q)[:k]
        out.append((np.full(len(best), q), np.full(len(best), key), np.array([i for _, i in best], np.int64), np.array([-s for s, _ in best], np.int64)))
    return _table(out)
