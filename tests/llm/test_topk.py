"""Top-k against exact arithmetic over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wardstream.llm import topk
from wardstream.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, score string, rank int"


def brute(rows, k, every):
    ok = [(i, [int(math.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if i % every == 0:
            own = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out |= {(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(own)}
    return sorted(out)


def run(spark, rows, k=5, every=3):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    out = topk.top_k(spark, df, F.col("vec_id") % every == 0, k)
    return sorted(tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect())


@pytest.fixture
def small(monkeypatch):
    for name, v in (("SHARD_ROWS", 16), ("MOST_QUERIES", 8), ("TILE_ROWS", 7), ("TILE_QUERIES", 4), ("FAN", 2)):
        monkeypatch.setattr(topk, name, v)


def test_ties_and_tiles(spark, small):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(3)]) for i in range(90)]
    rows += [(200 + i, [1.0, 1.0, 1.0]) for i in range(40)]
    rnd.shuffle(rows)
    assert run(spark, rows) == brute(rows, 5, 3)


def test_edge_rows(spark, small):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [0.5, 0.5]), (4, [1.0]), (12, [3.0]), (15, []), (5, [-1e-9, 0.0]), (7, [0.1, 0.1])]
    assert run(spark, rows) == brute(rows, 5, 3)


def test_large_components(spark, small):
    rows = [(i, [1e9 * i, -1e8 + i, 3.0]) for i in range(12)] + [(21, [1e300, 1.0, 1.0]), (22, [-1e300, 1.0, 1.0])]
    assert run(spark, rows) == brute(rows, 5, 3)


def test_repeated_rows(spark, small):
    rows = [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [2.0])]
    got = run(spark, rows)
    assert got == [(0, 1, 1, 64 * 128), (0, 2, 1, 64 * 128), (0, 3, 2, 64 * 128)]


def test_empty(spark):
    assert run(spark, []) == []


def test_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.001", "embeddings").collect()]
    assert run(spark, rows, 20, 20) == brute(rows, 20, 20)
