"""Exact top-k search by tiled matrix products.

Vectors are made integers, floor(64 * x).  Queries and candidates are dealt to the cells of a grid (query group by
shard); a cell multiplies tiles of its queries with tiles of its shard, keeps each tile's best k for each query, and
hands on one block of top lists.  Blocks are merged in a tree, ``FAN`` at a time, so no task ever holds more than
``FAN`` lists of a query.

Vectors that are null, or hold null or a non-finite component, take no part, nor do rows without a vec_id (a result
couldn't name them).  A query's own row is every row of its vec_id; other repeated rows are candidates each.  Vectors
compare with those of their own length only.  Ties go to the smaller vec_id; a query with fewer candidates than k gets
all of them, and none if there are none.  Scores past 64 bits are ranked exactly and returned as the nearest long.
Other columns are not read.  Components that fit two bytes as integers travel as such, so a vector that goes to each
group of queries is a quarter of its doubles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

SCALE = 64
#: Rows of a shard, and bytes of a group of queries (as doubles): what a cell holds at most, give or take what hashing
#: spreads.  A shard goes to every group, so groups are as large as a worker's memory allows.
SHARD_ROWS, GROUP_BYTES, MOST_QUERIES = 1 << 13, 48 << 20, 1 << 14
#: Rows of a tile.
TILE_QUERIES, TILE_ROWS = 256, 1 << 12
FAN = 16

LISTS = "query_group long, block long, shard long, query_ids binary, ids binary, scores binary"
SCHEMA = pa.schema([("query_group", pa.int64()), ("block", pa.int64()), ("shard", pa.int64()), ("query_ids", pa.binary()), ("ids", pa.binary()), ("scores", pa.binary())])
NONE = np.iinfo(np.int64).max  # of an id: no candidate


def matrices(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of the vectors: ids, ascending, and integer components (as float64, exact, or as Python integers)."""
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for column in ("small", "embedding"):
        own_rows = t.filter(pc.is_valid(t.column(column)))
        if not own_rows.num_rows:
            continue
        ids, vectors = own_rows.column("vec_id").to_numpy(), own_rows.column(column).combine_chunks()
        starts, sizes = vectors.offsets.to_numpy()[:-1], np.diff(vectors.offsets.to_numpy())
        flat = vectors.values.to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            own = np.flatnonzero(sizes == d)
            x = flat[starts[own][:, None] + np.arange(d)].astype(np.float64) if d else np.zeros((len(own), 0))
            if column == "embedding":
                with np.errstate(over="ignore"):
                    scaled = SCALE * x
                if d and np.isinf(scaled).any():
                    x = np.array([[int(v) * SCALE if abs(v) > 2**60 else int(np.floor(SCALE * v)) for v in r] for r in x], object)
                else:
                    x = np.floor(scaled)
            found.setdefault(int(d), []).append((ids[own], x))
    out = {}
    for d, parts in sorted(found.items()):
        if any(x.dtype == object for _, x in parts):
            parts = [(i, np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)) for i, x in parts]
        ids, x = (np.concatenate(z) for z in zip(*parts, strict=True))
        order = np.argsort(ids, kind="stable")
        out[d] = ids[order], x[order]
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k entries of highest score, ties to the smaller id, in that order; ids broadcast over rows."""
    ids = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((ids, -scores), axis=1)[:, :k] if scores.dtype != object else np.array([sorted(range(scores.shape[1]), key=lambda j: (-s[j], i[j]))[:k] for s, i in zip(scores, ids, strict=True)], int).reshape(len(scores), -1)
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def tile(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of one tile for each query; entries that are none have the id ``NONE``."""
    most = float(max((abs(a).max(initial=0) for a in (q, x)), default=0)) if q.dtype != object and x.dtype != object else np.inf
    bound, width = most * most * max(1, q.shape[1]), x.shape[0]
    if bound >= 2.0**52:
        q, x = (np.array([[int(v) for v in r] for r in a], object).reshape(a.shape) for a in (q, x))
    scores = q @ x.T if q.shape[1] else np.zeros((len(q), width))
    mine = ids[None, :] == own[:, None]
    if bound * width < 2.0**52:  # score and column as one number, so that a partition breaks ties too
        joint = scores * width + (width - 1 - np.arange(width))
        joint[mine] = -np.inf
        if width > k:
            joint = -np.partition(-joint, k - 1, axis=1)[:, :k]
        none = np.isneginf(joint)
        joint[none] = 0
        score = np.floor(joint / width)
        at = (width - 1 - (joint - score * width)).astype(np.int64)
        return score.astype(np.int64), np.where(none, NONE, ids[at])
    scores = scores.astype(np.int64) if scores.dtype != object else scores
    shown, got = best(scores, np.where(mine, NONE, np.broadcast_to(ids, scores.shape)), min(width, k + int(mine.sum(1).max(initial=0))))
    return shown, got


def ordered(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As best(), but entries that are none come last."""
    least = -(2**62) if scores.dtype != object else -(1 << 4096)
    return best(np.where(ids == NONE, least, scores), ids, k)


def cell(k: int):
    def run(key, t):
        group, part = (x.as_py() for x in key)
        rows, block = [], 0
        left, right = matrices(t.filter(t.column("is_query"))), matrices(t.filter(pc.invert(t.column("is_query"))))
        for d, (own, q) in left.items():
            ids, x = right.get(d, (np.zeros(0, np.int64), np.zeros((0, d))))
            for a in range(0, len(own), TILE_QUERIES):
                o, lists = own[a : a + TILE_QUERIES], None
                for b in range(0, len(ids), TILE_ROWS):
                    new = tile(q[a : a + TILE_QUERIES], o, x[b : b + TILE_ROWS], ids[b : b + TILE_ROWS], k)
                    lists = ordered(*(np.concatenate(p, axis=1) for p in zip(lists, new, strict=True)), k) if lists else ordered(*new, k)
                if lists:
                    rows.append(packed(group, block, part, o, *lists, k))
                block += 1
        return pa.Table.from_pylist(rows, schema=SCHEMA)

    return run


def packed(group: int, block: int, shard: int, own: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> dict:
    """Rows of exactly k entries; scores as text where they don't fit 64 bits."""
    pad = k - ids.shape[1]
    ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=NONE)
    scores = np.pad(scores, ((0, 0), (0, pad)), constant_values=0)
    scores = np.where(ids == NONE, 0, scores)
    if scores.dtype == object and all(abs(int(s)) < 2**62 for r in scores for s in r):
        scores = scores.astype(np.int64)
    body = b"L" + np.ascontiguousarray(scores, np.int64).tobytes() if scores.dtype != object else b"T" + " ".join(str(int(s)) for r in scores for s in r).encode()
    return {"query_group": group, "block": block, "shard": shard, "query_ids": own.astype(np.int64).tobytes(), "ids": np.ascontiguousarray(ids, np.int64).tobytes(), "scores": body}


def unpacked(r: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, ids = np.frombuffer(r["query_ids"], np.int64), np.frombuffer(r["ids"], np.int64).reshape(-1, k)
    body = r["scores"]
    scores = np.frombuffer(body, np.int64, offset=1) if body[:1] == b"L" else np.array([int(x) for x in body[1:].split()], object)
    return own, scores.reshape(-1, k), ids


def merge(k: int):
    """Merges the lists of one block of queries from a group of shards."""
    def run(key, t):
        group, block, part = (x.as_py() for x in key)
        lists: dict = {}
        for r in t.to_pylist():
            own, scores, ids = unpacked(r, k)
            if (before := lists.get(r["query_ids"])) is not None:
                if before[0].dtype != scores.dtype:
                    before, scores = (before[0].astype(object), before[1]), scores.astype(object)
                scores, ids = ordered(np.concatenate([before[0], scores], 1), np.concatenate([before[1], ids], 1), k)
            lists[r["query_ids"]] = scores, ids
        return pa.Table.from_pylist([packed(group, block, part, np.frombuffer(q, np.int64), s, i, k) for q, (s, i) in lists.items()], schema=SCHEMA)

    return run


def result(k: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                own, scores, ids = unpacked(r, k)
                there = ids != NONE
                if scores.dtype == object:
                    scores = np.array([[max(-(2**63), min(2**63 - 1, int(s))) for s in row] for row in scores], np.int64)
                rank = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), ids.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, there.sum(1))), pa.array(rank[there]), pa.array(ids[there]), pa.array(scores[there])], ["query_id", "rank", "vec_id", "score"])

    return run


def valid(embedding: Column) -> Column:
    x = embedding.cast("array<double>")
    return embedding.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id and score: the k best candidates of each row for which ``is_query`` holds."""
    prepare(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    n, n_queries, longest = rows.agg(F.count("*"), F.count_if("is_query"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    # Components that fit two bytes as integers travel so.
    fits = F.forall("embedding", lambda v: (v >= -512) & (v < 512))
    small = F.when(fits, F.transform("embedding", lambda v: F.floor(v * SCALE).cast("short")))
    rows = rows.select("vec_id", "is_query", small.alias("small"), F.when(~fits, F.col("embedding")).alias("embedding"))
    per_group = max(1, min(MOST_QUERIES, GROUP_BYTES // (8 * max(1, longest))))
    shards, groups = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_queries // per_group))

    def deal(column: str, into: int, salt: int) -> Column:
        return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(into)).cast("long")

    def every(into: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(into - 1).cast("long")))

    queries = rows.where("is_query").dropDuplicates(["vec_id", "small", "embedding"]).withColumn("query_group", deal("vec_id", groups, 1)).withColumn("shard", every(shards))
    # Repeated ids must not all lie in one shard: what deals a candidate is its id and vector, and a row's own number where
    # these are equal too would not be the same if a task ran again.
    spread = F.pmod(F.xxhash64("vec_id", "small", "embedding", F.lit(2)), F.lit(shards)).cast("long")
    tiles = rows.withColumn("is_query", F.lit(False)).withColumn("shard", spread).withColumn("query_group", every(groups))
    keep = ["query_group", "shard", "is_query", "vec_id", "small", "embedding"]
    lists = queries.select(*keep).union(tiles.select(*keep)).groupBy("query_group", "shard").applyInArrow(cell(k), LISTS)
    left = shards
    while left > 1:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN)).select("query_group", "block", "shard", "query_ids", "ids", "scores").groupBy("query_group", "block", "shard").applyInArrow(merge(k), LISTS)
        left = -(-left // FAN)
    return lists.select("query_ids", "ids", "scores").mapInArrow(result(k), "query_id long, rank int, vec_id long, score long")
