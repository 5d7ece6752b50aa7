"""Exact top-k against brute force, on the rows that the docstring names."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score long, shard int"


def make_vectors():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(220)]
    rows += [(100, rows[100][1]), (0, rows[7][1]), (33, rows[33][1]), (400, rows[100][1])]  # repeated row, shared id, ties
    rows += [(300, None), (301, [1.0, None]), (302, [1.0, math.nan]), (303, [math.inf, 1.0]), (None, [1.0] * 8), (500, []), (600, [0.5, -0.25])]
    return rows


def brute(rows, k):
    own = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for q, x in {(i, tuple(v)) for i, v in own if i % 100 == 0}:
        best = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in own if i != q)[:k]
        out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(best))
    return out


@pytest.mark.parametrize("k,shard_rows,block_rows", [(10, 8192, 1024), (3, 40, 2), (500, 60, 1024)])
def test_top_k_is_exact(spark, k, shard_rows, block_rows):
    rows = make_vectors()
    v = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    got = topk.top_k(v, F.col("vec_id") % 100 == 0, k=k, shard_rows=shard_rows, block_rows=block_rows).collect()
    assert Counter(map(tuple, got)) == brute(rows, k)


def test_large_components_and_no_rows(spark):
    rows = [(i, [float(2 ** 60 + i), 3e20 if i == 2 else 1.0]) for i in range(4)]
    v = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA.replace("float", "double"))
    got = topk.top_k(v, F.col("vec_id") == 0, k=2).collect()
    assert [(r.rank, r.score) for r in got] == [(1, 2 ** 63 - 1), (2, 2 ** 63 - 1)]
    assert topk.top_k(v.where("vec_id > 9"), F.col("vec_id") == 0).collect() == []
