"""N-gram Jaccard join: size-aware, small sets by enumerated subsets, large sets by inverted lists.

Two documents link when their sets of distinct 5-word shingles have a Jaccard similarity of 0.75 or more
(100 * intersection >= 75 * union, in integers).  The join is exact up to 64-bit hashes of shingles and sets.

1. ``signatures``: one pass gives each document its set size and the set's signature.  Documents of one
   signature are one *node*; copies are never paired.
2. A fixed-size sketch of how common shingles are (those met twice within a block of documents) gives a global
   order, rare first.  Any order gives the same links; this one keeps lists short.
3. Nodes of at most ``boundary`` shingles are listed under every subset of the size that a partner of each
   possible size must share with them; larger ones under the first shingles of their order that any partner
   must share one of.  ``boundary`` minimises the postings of both kinds, from the histogram of sizes.
4. Members of one subset's list link with its smallest member or with none.  In each other list a few central members
   are compared with those of other components; links make components; two or three such rounds make one component
   of a large group of near copies without making its pairs.
5. Lists that still hold several components have the pairs across them looked at, by sizes and places first, if
   they have no more than ``SHORT`` entries.  Longer ones are taken apart by *differences* from their member p of most links.
   With D(x) the symmetric difference of x and p, and E(x) = 7 |D(x)| - |x|, sets x and y link exactly if
   E(x) + E(y) <= 14 |D(x) & D(y)|.  The member of least E settles all pairs with a sum of 0 or less; of the others two that are
   near p must share a difference, so each is listed under the first differences of its own (rare ones first).  A set that
   shares less with p than any partner must share with it has to share shingles besides p's, so it is listed under the
   first of these, and near ones under all of theirs, which are few.  Only pairs of different components in such a list,
   at places that still allow it, are compared.  What all members have in common, the core of a group of near copies or a
   passage in otherwise different texts, is in no such list.  So a pair that is in no list together cannot link, and
   every pair within a list is compared, excluded by a bound or already connected.

The sets of listed nodes are written once, in buckets by node, with the parities of their slots; all comparisons read
these, not the texts, and move only the pairs: with the parities first, which rule out most that don't link, and with
whole sets where these allow a link.

Nulls, empty texts and texts without words: an empty set, linked with nothing, component_id is the own doc_id.
Fewer than five words: the whole sequence is the only shingle.  Repeated rows and equal ids: each row is a row of the
result; equal sets share a component.  A null doc_id takes its component's least id, if there is one.  Other columns are
not read.  Ties in all choices go to a hash or the lesser id and don't change the result.  A very long text is one set of
8 bytes a shingle, handled whole.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, U, batch, buffers, chunks, mix, prepare, release, released, texts, windows, words

SHINGLE = 5
#: Similarity as a fraction.
NUM, DEN = 75, 100
#: One-byte slots of the sketch; the broadcast has this size at any input.
SLOTS = 1 << 22
#: Shingles that a block holds before what it repeats is counted.
BLOCK = 1 << 21
#: From this estimate of its count on a shingle's list is dealt by rows, not by key.
HOT = 1 << 10
#: Bits of the filter of documents whose sets are sent; of fixed size as well.
FILTER = 1 << 24
LARGEST_BOUNDARY = 24
#: Rounds that compare members of each list with the rest, at most; they end when one adds less than this share of all links.
ROUNDS, WORTH = 4, 0.02
#: Members that a round compares with the rest, in lists of more than so many entries.
PICKS, LONG = 4, 8
#: Up to so many entries of a list are looked at pair by pair, which costs an entry about as much as its differences do.
SHORT = 1024
#: Bytes of sets in a file of their table.
SET_BYTES = 32 << 20

SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("slots", pa.binary())])
POSTS = pa.schema([("bucket", pa.int64()), ("hot", pa.bool_()), ("posts", pa.binary())])
FLAT = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())])
BLOBS = pa.schema([("node", pa.int64()), ("bits", pa.binary()), ("shingles", pa.binary())])
POST = np.dtype([("key", np.uint64), ("node", np.int64), ("size", np.int32), ("pos", np.int32)])


def needed(s, t):
    """The least intersection of sets of sizes s and t that link."""
    return -(-NUM * (s + t) // (DEN + NUM))


def prefix(s: int) -> int:
    """So many of a set's first shingles hold one that any linked set, however large or small, shares."""
    return s - -(-NUM * s // DEN) + 1


def least_partner(s: int) -> int:
    return -(-NUM * s // DEN)


def shared_sizes(s: int, boundary: int) -> list[int]:
    """The sizes of shared subsets by which a set of s shingles can meet a partner of up to ``boundary``."""
    return sorted({needed(s, t) for t in range(least_partner(s), min(boundary, DEN * s // NUM) + 1) if needed(s, t) <= min(s, t)})


def n_subsets(s: int, boundary: int) -> int:
    return sum(comb(s, c) for c in shared_sizes(s, boundary))


def best_boundary(histogram: dict[int, int]) -> int:
    """The size up to which subsets are enumerated: the least total of postings (those of larger sets, and of the
    small ones that a larger one may link with, are prefixes)."""
    def cost(b: int) -> int:
        return sum(n * ((n_subsets(s, b) if s <= b else 0) + (prefix(s) if s > b or DEN * s // NUM > b else 0)) for s, n in histogram.items())
    return min(range(LARGEST_BOUNDARY + 1), key=lambda b: (cost(b), b))


def shingle_sets(col) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes."""
    data, offsets = buffers(col)
    for lo, hi in chunks(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        _, _, h, first = words(data[offsets[lo] : offsets[hi]], at, lower=True)
        g = windows(h, SHINGLE, 0)
        for r in range(hi - lo):
            a, b = first[r], first[r + 1]
            if b - a >= SHINGLE:
                x = np.sort(g[a : b - SHINGLE + 1])
                yield lo + r, x[np.r_[True, x[1:] != x[:-1]]]
            else:
                yield lo + r, windows(h[a:b], b - a, int(b - a)) if b > a else np.zeros(0, np.uint64)


def signature(x: np.ndarray) -> int:
    both = mix(x, 2).sum(dtype=np.uint64) ^ mix(mix(x, 3).sum(dtype=np.uint64, keepdims=True) + U(len(x)), 4)[0]
    return int(both.astype(np.int64))


@released
def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size and node of each document; besides, rows without a document that hold the slots of the shingles
    that a block repeats, and how often."""
    block, n = [], 0

    def repeated() -> Iterator[pa.RecordBatch]:
        x = np.sort(np.concatenate(block))
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        count = np.diff(np.r_[first, len(x)])
        more = count > 1
        if more.any():
            slots = np.stack([(x[first[more]] & U(SLOTS - 1)).astype(np.uint32), count[more].astype(np.uint32)])
            yield batch({"doc_id": [None], "n_shingles": [None], "node": [None], "slots": [slots.tobytes()]}, SETS)

    seen: set[int] = set()
    for b in batches:
        sizes, nodes = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
        for r, x in shingle_sets(b.column("text")):
            sizes[r] = len(x)
            if len(x):
                nodes[r] = signature(x)
                if nodes[r] not in seen:
                    seen.add(nodes[r])
                    block.append(x)
                    n += len(x)
                if n >= BLOCK:
                    yield from repeated()
                    block, n = [], 0
                    seen.clear()
        yield batch({"doc_id": b.column("doc_id"), "n_shingles": sizes, "node": pa.array(nodes, mask=sizes == 0), "slots": pa.nulls(len(b), pa.binary())}, SETS)
    if n:
        yield from repeated()


@released
def slot_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by slot, summed within a task."""
    for b in batches:
        for blob in b.column("slots"):
            slots, count = np.frombuffer(blob.as_buffer(), np.uint32).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(count.astype(np.int64))], ["slot", "n"])


def ranked(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A set in the global order: rare first, then by hash."""
    w = weights[(x & U(SLOTS - 1)).astype(np.int64)]
    return x[np.argsort(w, kind="stable")] if w.any() else x


def postings(weights, boundary: int, buckets: int):
    """A function that lists each node, once a task, under its subsets or its prefix; lists as blobs by bucket."""
    shift = U(64 - (buckets - 1).bit_length()) if buckets > 1 else None

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, found, n, seen = weights.value, [], 0, set()

        def flush() -> pa.RecordBatch:
            p = np.concatenate(found)
            bucket = (p["key"] >> shift).astype(np.int64) if shift is not None else np.zeros(len(p), np.int64)
            hot = w[(p["key"] & U(SLOTS - 1)).astype(np.int64)] >= HOT.bit_length()
            rows: dict = {"bucket": [], "hot": [], "posts": []}
            for is_hot in (False, True):
                own = np.flatnonzero(hot == is_hot)
                own = own[np.argsort(bucket[own], kind="stable")]
                cut = np.flatnonzero(np.diff(bucket[own], prepend=-1))
                for i, part in zip(cut, np.split(own, cut[1:]) if len(cut) else [], strict=True):
                    rows["bucket"].append(int(bucket[own[i]]))
                    rows["hot"].append(is_hot)
                    rows["posts"].append(packed(p[part]))
            return batch(rows, POSTS)

        for b in batches:
            for _, x in shingle_sets(b.column("text")):
                s = len(x)
                node = signature(x) if s else 0
                if not s or node in seen:
                    continue
                seen.add(node)
                keys, pos = [], []
                if s <= boundary:
                    for c in shared_sizes(s, boundary):
                        sub = np.array(list(combinations(x.tolist(), c)), np.uint64)
                        keys.append(windows(sub.ravel(), c, 100 + c)[::c])
                        pos.append(np.full(len(sub), -c))
                if s > boundary or DEN * s // NUM > boundary:
                    keys.append(ranked(x, w)[: prefix(s)])
                    pos.append(np.arange(prefix(s)))
                p = np.zeros(sum(map(len, keys)), POST)
                p["key"], p["node"], p["size"], p["pos"] = np.concatenate(keys), node, s, np.concatenate(pos)
                found.append(p)
                n += len(p)
            if n >= 1 << 19:
                yield flush()
                found, n = [], 0
        if n:
            yield flush()

    return run


def packed(p: np.ndarray) -> bytes:
    """Postings by key, column by column and byte by byte, which leaves runs of zeros."""
    p = p[np.argsort(p["key"], kind="stable")]
    parts = []
    for f in POST.names:
        x = np.diff(p[f], prepend=p[f].dtype.type(0)) if f == "key" else np.ascontiguousarray(p[f])
        parts.append(x.view(np.uint8).reshape(len(p), -1).T.tobytes())
    return zstandard.compress(b"".join(parts), 1)


def posts_of(blob) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob.as_buffer()), np.uint8)
    n = len(raw) // POST.itemsize
    out, at = np.zeros(n, POST), 0
    for f in POST.names:
        width = POST[f].itemsize
        x = np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(POST[f]).ravel()
        out[f] = np.cumsum(x, dtype=np.uint64) if f == "key" else x
        at += n * width
    return out


#: Lists of up to so many entries are compared in blocks of lists, all pairs at once.
BLOCKS = 16


def of_use(size: np.ndarray, pos: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which entries have another one in their list that sizes and places allow to link: a place i in a set of size s
    leaves a reach of 4s - 7i, and each one's reach must be 3 times the other's size."""
    reach, keep = 4 * size.astype(np.int64) - 7 * pos, np.zeros(len(size), bool)
    for m in range(2, min(BLOCKS, int(n.max(initial=0))) + 1):
        at = first[n == m]
        for lo in range(0, len(at), step := max(1, (1 << 19) // m**2)):
            i = at[lo : lo + step, None] + np.arange(m)
            one = reach[i][:, :, None] >= 3 * size[i][:, None, :]
            one &= one.transpose(0, 2, 1) & ~np.eye(m, dtype=bool)
            keep[i] = one.any(2)
    for f, m in zip(first[n > BLOCKS], n[n > BLOCKS], strict=True):
        i = f + np.argsort(size[f : f + m], kind="stable")
        s, v = size[i], reach[i]
        most = np.maximum.accumulate(v)  # among the first, by size; and the second of these
        second = np.r_[np.iinfo(np.int64).min, np.maximum.accumulate(np.minimum(v[1:], most[:-1]))]
        last = np.searchsorted(s, v // 3, "right") - 1
        best = np.where((np.arange(m) <= last) & (v == most[last]), second[last], most[last])
        keep[i] = (last >= 0) & (best >= 3 * s)
    return keep


def lists(t: pa.Table) -> pa.Table:
    """The lists of one bucket, without entries that no other one of their list can link with."""
    p = np.concatenate([posts_of(x) for x in t.column("posts")])
    p = p[np.lexsort((p["pos"], p["node"], p["key"]))]
    same = (p["key"][1:] == p["key"][:-1]) & (p["node"][1:] == p["node"][:-1])
    p = p[np.r_[True, ~same]]  # a node that several tasks met
    first = np.flatnonzero(np.r_[True, p["key"][1:] != p["key"][:-1]])
    n = np.diff(np.r_[first, len(p)])
    subsets = p["pos"] < 0
    p = p[np.repeat(n > 1, n) & (subsets | of_use(p["size"], p["pos"], first, n))]
    release()
    return pa.Table.from_arrays([pa.array(np.ascontiguousarray(p[f]).astype(np.int64 if f == "key" else p[f].dtype)) for f in POST.names], schema=FLAT)


@released
def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column("posts"):
            p = posts_of(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[f]).astype(np.int64 if f == "key" else p[f].dtype)) for f in POST.names], schema=FLAT)


def least_both(s: Column, t: Column) -> Column:
    return F.ceil(NUM * (s + t) / F.lit(DEN + NUM))


def may_link(a: str, b: str, boundary: int) -> Column:
    """What sizes and places in the order of two entries of a list (structs) still allow; two small sets meet by subsets."""
    s, t, i, j = (F.col(f"{x}.{f}") for f in ("size", "pos") for x in (a, b))
    return (F.greatest(s, t) > boundary) & (F.least(s - i, t - j) >= least_both(s, t))


def marks(t: pa.Table) -> pa.Table:
    """A part of the filter of nodes: one bit for each slot that occurs."""
    part = int(t.column("part")[0].as_py())
    bits = np.zeros(1 << 13, np.uint8)
    bits[t.column("slot").to_numpy()] = 1
    return pa.table({"part": [part], "bits": [np.packbits(bits).tobytes()]}, schema=pa.schema([("part", pa.int64()), ("bits", pa.binary())]))


def parities(x: np.ndarray) -> bytes:
    """A set's size, and for each of two to four times as many slots whether it holds an odd number of shingles."""
    n = 1 << (2 * len(x) - 1).bit_length()
    odd = np.bincount((x & U(n - 1)).astype(np.int64), minlength=n) & 1
    return np.uint32(len(x)).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


@released
def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose parities allow a link: each slot in which they differ holds a shingle that one set lacks, and linked
    sets of s and t shingles have at most (s + t) / 7 of these."""
    for b in batches:
        ok = np.zeros(len(b), bool)
        for i, (x, y) in enumerate(zip(b.column("sa"), b.column("sb"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
            s, t = (int(z[:4].view(np.uint32)[0]) for z in (x, y))
            u, v = sorted((np.unpackbits(z[4:]) for z in (x, y)), key=len)
            v = np.bitwise_xor.reduce(v.reshape(-1, len(u)), axis=0) if len(v) > len(u) else v
            ok[i] = 7 * int((u != v).sum()) <= s + t
        yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], ["a", "b"])


def blobs(bits):
    """A function that gives the sets of the documents that the filter lets pass, once a task; only these are hashed."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, seen = np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool), set()
        for b in batches:
            ids = b.column("doc_id")
            slot = ids.fill_null(0).to_numpy() & (FILTER - 1)
            b = b.filter(pa.array(inside[slot] | ids.is_null().to_numpy(zero_copy_only=False)))
            rows: dict = {"node": [], "bits": [], "shingles": []}
            for _, x in shingle_sets(b.column("text")):
                if len(x) and (node := signature(x)) not in seen:
                    seen.add(node)
                    rows["node"].append(node)
                    rows["bits"].append(parities(x))
                    rows["shingles"].append(x.tobytes())
            if rows["node"]:
                yield batch(rows, BLOBS)

    return run


@released
def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, z = b.column("sa"), b.column("sb")
        ok = np.zeros(len(b), bool)
        for i in range(len(b)):
            x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (a, z))
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok[i] = DEN * both >= NUM * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], ["a", "b"])


def sets_of(spark: SparkSession, docs: DataFrame, own: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes' sets and their parities, from one document of each, in one pass over the texts."""
    slot = F.col("doc_id").bitwiseAND(FILTER - 1)
    parts = own.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").select(F.shiftright(slot, 13).alias("part"), slot.bitwiseAND((1 << 13) - 1).alias("slot")).distinct()
    bits = np.zeros(FILTER >> 3, np.uint8)
    for r in parts.groupBy("part").applyInArrow(marks, "part long, bits binary").toLocalIterator():  # FILTER bits at most
        bits[r.part << 10 : (r.part + 1) << 10] = np.frombuffer(r.bits, np.uint8)
    sets = docs.mapInArrow(blobs(spark.sparkContext.broadcast(bits.tobytes())), "node long, bits binary, shingles binary")
    return sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("bits").alias("bits"), F.first("shingles").alias("shingles"))


@contextmanager
def bucketed(sets: DataFrame, total: int, scratch: Scratch) -> Iterator[DataFrame]:
    """The sets as a table in the shared folder, dealt by node, so that joins with it move the other side only."""
    spark, name, path = scratch.spark, f"sets_{uuid.uuid4().hex}", scratch.path("listed")
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SET_BYTES))
    sets.repartition(files, "node").write.format("parquet").bucketBy(files, "node").option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch.remove(path)


def with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str, what: str = "shingles") -> DataFrame:
    both = pairs.join(sets.select(F.col("node").alias(a), F.col(what).alias("sa")), a)
    return both.join(sets.select(F.col("node").alias(b), F.col(what).alias("sb")), b).select(*pairs.columns, "sa", "sb")


def linked(sets: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs of nodes whose sets link: by the sets themselves, where their parities allow it."""
    left = scratch.keep(with_sets(pairs.select("a", "b"), sets, "a", "b", "bits").mapInArrow(possible, "a long, b long"), "possible")
    return scratch.keep(with_sets(left, sets, "a", "b").mapInArrow(compare, "a long, b long"), "links")


def components(edges: DataFrame, scratch: Scratch, before: DataFrame | None = None) -> DataFrame:
    """node and root, the least node it is connected with; large-star and small-star in turn until nothing changes.  With
    the components of earlier edges only their roots are connected anew, if the edges connect any."""
    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    own = edges.select("a", "b")
    for c in ("a", "b") if before is not None else ():
        own = own.join(before.select(F.col("node").alias(c), F.col("root").alias("__root")), c, "left").withColumn(c, F.coalesce("__root", c)).drop("__root")
    now = scratch.keep(own.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = mark(now)
    if not state[0] and before is not None:
        return before
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = scratch.keep(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        last, now = now, scratch.keep(small, "small")
        scratch.drop(last, large)
        if (new := mark(now)) == state:
            break
        state = new
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if before is None:
        return roots
    moved = before.join(roots.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    return scratch.keep(moved.select("node", F.coalesce("to", "root").alias("root")).union(roots), "roots")


def by_subsets(found: DataFrame) -> DataFrame:
    """Links (a, b) in the lists of subsets: who shares c shingles links if they need no more, and needs least with
    the smallest."""
    small = found.where("pos < 0")
    least = small.groupBy("key").agg(F.min(F.struct("size", "node")).alias("m"))
    pairs = small.join(least, "key").where((F.col("node") != F.col("m.node")) & (least_both(F.col("size"), F.col("m.size")) <= -F.col("pos")))
    return pairs.select(F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b")).distinct()


def placed(found: DataFrame, roots: DataFrame, links: DataFrame) -> DataFrame:
    """The entries of lists of prefixes as structs, with their component and number of links so far."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    out = found.join(roots.join(ends, "node", "left"), "node", "left")
    return out.select("key", F.struct(F.coalesce("root", "node").alias("root"), "node", "size", "pos", F.coalesce("n_links", F.lit(0)).alias("n_links")).alias("x"))


def unsettled(entries: DataFrame, picks: list[Column], scratch: Scratch) -> DataFrame:
    """Entries (x) of the lists that hold several components, each with the one of least ``picks[0]`` (p) and the length of
    the list (n); in long lists also with those of least other picks, one row for each, not ``first``."""
    least = [F.min(F.struct(k.alias("by"), F.col("x"))).alias(f"p{i}") for i, k in enumerate(picks)]
    ends = entries.groupBy("key").agg(*least, F.min("x.root").alias("low"), F.max("x.root").alias("high"), F.count("*").alias("n")).where("low < high")
    every = F.array_distinct(F.array(*(F.col(f"p{i}.x") for i in range(len(picks)))))
    ends = ends.select("key", "n", F.posexplode(F.when(F.col("n") > LONG, every).otherwise(F.array("p0.x"))).alias("turn", "p"))
    ends = scratch.keep(ends.select("key", "n", (F.col("turn") == 0).alias("first"), "p"), "ends")
    return scratch.keep(entries.join(ends, "key"), "unsettled")


def chosen(turn: int) -> list[Column]:
    """Which members of a list a round compares with the others, other ones in each: those that have linked most, or that
    have few rare shingles before the list's own; they are most like the others."""
    hashed = [F.xxhash64(F.col("x.node"), F.lit(turn * PICKS + i)) for i in range(PICKS - 2)]
    return [-F.col("x.n_links"), F.col("x.pos") / F.col("x.size"), *hashed] if turn else [F.col("x.pos") / F.col("x.size"), F.col("x.pos") - F.col("x.size"), *hashed]


def one_against_all(both: DataFrame, boundary: int) -> DataFrame:
    """Pairs (a, b) of the chosen members of each list with those of other components."""
    pairs = both.where(F.col("x.root") != F.col("p.root")).where(may_link("x", "p", boundary))
    return pairs.select(F.least("x.node", "p.node").alias("a"), F.greatest("x.node", "p.node").alias("b")).distinct()


def across(both: DataFrame, boundary: int) -> DataFrame:
    """All pairs (a, b) of different components that are in a list together and may link."""
    other = both.where(F.col("x.root") != F.col("p.root")).select("key", F.col("x").alias("y"))
    pairs = other.join(both.select("key", "x", (F.col("x.root") == F.col("p.root")).alias("main")), "key")
    pairs = pairs.where((F.col("x.root") != F.col("y.root")) & (F.col("main") | (F.col("x.node") < F.col("y.node"))) & may_link("x", "y", boundary))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


@released
def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node in a group: its set's size, how many shingles it shares with the group's member p, and how many only
    one of the two has."""
    for b in batches:
        size, both, far = (np.zeros(len(b), np.int64) for _ in range(3))
        for i, (x, p) in enumerate(zip(b.column("sb"), b.column("sa"), strict=True)):
            x, p = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(p.as_buffer(), np.uint64)
            size[i], both[i] = len(x), len(np.intersect1d(x, p, assume_unique=True))
            far[i] = len(x) + len(p) - 2 * both[i]
        yield pa.RecordBatch.from_arrays([b.column("p"), b.column("node"), pa.array(size), pa.array(both), pa.array(far)], ["p", "node", "size", "both", "far"])


POSTED = ["root", "main", "near", "e", "far", "size", "both", "node"]


def first_differences(weights):
    """A function that lists a node under its first differences from p.

    Near ones by all differences (``need`` is what a near partner must share of them; null: there is none): rare shingles of
    their own first, then what p has of common ones, last what p alone has or lacks.  All by what p lacks (``own``): far ones
    by as many as their prefix has, near ones by all, which are few.
    """
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value

        def weight(x: np.ndarray) -> np.ndarray:
            return w[(x & U(SLOTS - 1)).astype(np.int64)].astype(np.int64)

        for b in batches:
            rows, keys = [np.zeros((3, 0), np.int64)], [np.zeros(0, np.uint64)]
            for i, (x, p) in enumerate(zip(b.column("sb"), b.column("sa"), strict=True)):
                x, p = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(p.as_buffer(), np.uint64)
                more, less = np.setdiff1d(x, p, assume_unique=True), np.setdiff1d(p, x, assume_unique=True)
                salt, need = mix(np.array([b.column("p")[i].as_py()]).view(np.uint64), 5), b.column("need")[i].as_py()
                own = more[np.lexsort((more, weight(more)))][: None if b.column("near")[i].as_py() else prefix(len(x))]
                parts = [(own, 7, 1)]
                if need is not None and need <= len(more) + len(less):
                    every, rank = np.r_[more, less], np.r_[weight(more), 1 + weight(p).max(initial=0) - weight(less)]
                    parts.append((every[np.lexsort((every, rank))][: len(every) - need + 1], 6, 0))
                for found, seed, is_own in parts:
                    keys.append(mix(found ^ salt, seed))
                    rows.append(np.stack([np.full(len(found), i), np.arange(len(found)), np.full(len(found), is_own)]))
            row, pos, is_own = np.concatenate(rows, axis=1)
            taken = [b.column(c).take(pa.array(row)) for c in POSTED]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(pos), pa.array(is_own.astype(bool)), *taken], ["key", "pos", "own", *POSTED])

    return run


def by_differences(both: DataFrame, sets: DataFrame, roots: DataFrame, tried: DataFrame | None, weights, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect what is in a list together (x, with its member p), found by differences from p."""
    groups = both.select(F.col("p.node").alias("p"), F.col("x.node").alias("node")).distinct()
    d = scratch.keep(with_sets(groups, sets, "p", "node").mapInArrow(apart, "p long, node long, size long, both long, far long"), "apart").withColumn("e", 7 * F.col("far") - F.col("size"))
    least = d.groupBy("p").agg(F.min(F.struct("e", "node")).alias("m"))
    free = d.join(least, "p").where((F.col("e") + F.col("m.e") <= 0) & (F.col("node") != F.col("m.node")))
    free = scratch.keep(free.select(F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b")).distinct(), "free")
    roots = components(free, scratch, roots)

    # Near: so much is shared with p that what a partner must share may all be p's.
    d = d.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("near", F.col("both") >= F.ceil(NUM * F.col("size") / F.lit(DEN)))
    d = scratch.keep(d, "rooted")
    near = d.where("near")
    least = near.groupBy("p").agg(F.min(F.struct("e", "node", "root")).alias("m"))
    other = near.join(least, "p").where(F.col("root") != F.col("m.root")).groupBy("p").agg(F.min("e").alias("o"))
    left = d.groupBy("p").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("p")
    left = scratch.keep(left.join(least, "p").join(other, "p", "left"), "groups")
    d = d.join(left, "p").withColumn("main", F.col("root") == F.col("m.root"))
    need = F.when(F.col("near"), F.ceil((F.col("e") + F.when(F.col("main"), F.col("o")).when(F.col("o").isNotNull(), F.col("m.e"))) / F.lit(14)))
    posts = with_sets(d.withColumn("need", need).select("p", *POSTED, "need"), sets, "p", "node")
    posts = scratch.keep(posts.mapInArrow(first_differences(weights), "key long, pos long, own boolean, root long, main boolean, near boolean, e long, far long, size long, both long, node long"), "differences")

    def meet(x: DataFrame, y: DataFrame, shared, whole, once) -> DataFrame:
        room = F.least(whole("x") - F.col("x.pos"), whole("y") - F.col("y.pos"))
        pairs = y.alias("y").join(x.alias("x"), F.col("x.key") == F.col("y.key")).where((F.col("x.root") != F.col("y.root")) & (once | (F.col("x.node") < F.col("y.node"))) & (room >= shared))
        return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    by_all = posts.where("not own")
    pairs = meet(by_all, by_all.where("not main"), F.ceil((F.col("x.e") + F.col("y.e")) / F.lit(14)), lambda x: F.col(f"{x}.far"), F.col("x.main"))
    # Of a pair with a far member, at least so many shared shingles are not p's.
    by_own = posts.where("own")
    rest = F.greatest(F.lit(1), least_both(F.col("x.size"), F.col("y.size")) - F.least("x.both", "y.both"))
    pairs = pairs.union(meet(by_own, by_own.where("not near"), rest, lambda x: F.col(f"{x}.size") - F.col(f"{x}.both"), F.col("x.near"))).distinct()
    pairs = scratch.keep(pairs.join(tried, ["a", "b"], "left_anti") if tried else pairs, "candidates")
    return free.union(linked(sets, pairs, scratch))


def jaccard_join(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (the set's signature, null for empty sets) and component_id of every document."""
    own, labels, scratch = classes(spark, documents)
    least = labels.groupBy("label").agg(F.min("least_doc").alias("component_id"))
    least = scratch.keep(labels.join(least, "label").select("node", "component_id"), "classes")
    out = own.where("node is not null").join(least, "node").select("doc_id", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.union(own.where("node is null").select("doc_id", "n_shingles", "node", F.col("doc_id").alias("component_id")))


def classes(spark: SparkSession, documents: DataFrame) -> tuple[DataFrame, DataFrame, Scratch]:
    """doc_id, n_shingles and node of every document; least_doc and label, the component's least node, of every node."""
    prepare(spark)
    docs, scratch = texts(documents), Scratch(spark, "ngram-join")
    sets = scratch.keep(docs.mapInArrow(signatures, "doc_id long, n_shingles long, node long, slots binary"), "sets")
    own = sets.where("n_shingles is not null").select("doc_id", "n_shingles", "node")
    nodes = own.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_doc"))

    histogram = own.where(F.col("n_shingles") > 0).groupBy(F.least("n_shingles", F.lit(4 * LARGEST_BOUNDARY)).alias("s")).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("t")).collect()
    if not histogram:
        return own, nodes.withColumn("label", F.col("node")), scratch
    boundary = best_boundary({r.s: r.n for r in histogram})
    weights = np.zeros(SLOTS, np.uint8)
    heavy = sets.where("slots is not null").select("slots").mapInArrow(slot_weights, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n >= 4")
    for b in heavy.select("slot", F.ceil(F.log2("n")).cast("byte").alias("w")).toArrow().to_batches():  # SLOTS rows at most
        weights[b.column(0).to_numpy()] = b.column(1).to_numpy()
    weights = spark.sparkContext.broadcast(weights)
    buckets = 1 << max(4, (sum(r.t for r in histogram) // 1_000_000).bit_length())

    posted = scratch.keep(docs.mapInArrow(postings(weights, boundary, buckets), "bucket long, hot boolean, posts binary"), "posts")
    entry = "key long, node long, size int, pos int"
    cold = posted.where("not hot").select("bucket", "posts").groupBy("bucket").applyInArrow(lists, entry)
    rows = posted.where("hot").select("posts").mapInArrow(flat, entry).distinct()
    more = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    found = scratch.keep(cold.union(rows.join(more, "key", "left_semi").select(*cold.columns)), "lists")
    scratch.drop(posted)

    links, tried = scratch.keep(by_subsets(found), "links"), None
    lists_left = found.where("pos >= 0")
    members = lists_left.groupBy("node").agg(F.first("size").alias("size"))
    total = 8 * members.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    with bucketed(sets_of(spark, docs, own, members.select("node")), total, scratch) as listed:
        roots = components(links, scratch)
        for turn in range(ROUNDS):
            both = unsettled(placed(lists_left, roots, links), chosen(turn), scratch)
            # A settled list stays so, and one of two members has had its pair compared.
            lists_left = both.where("first and n > 2").select("key", "x.node", "x.size", "x.pos")
            pairs = one_against_all(both, boundary)
            pairs = scratch.keep(pairs.join(tried, ["a", "b"], "left_anti") if tried else pairs, "pairs")
            if not pairs.take(1):
                break
            new = linked(listed, pairs, scratch)
            tried = scratch.keep(tried.union(pairs), "tried") if tried else pairs
            links = scratch.keep(links.union(new), "links")
            roots = components(new, scratch, roots)
            if new.count() < WORTH * links.count():
                break
        both = unsettled(placed(lists_left, roots, links), [F.struct(-F.col("x.n_links"), F.xxhash64("x.node"))], scratch)
        rest = across(both.where(F.col("n") <= SHORT), boundary)
        rest = scratch.keep(rest.join(tried, ["a", "b"], "left_anti") if tried else rest, "rest")
        last, long = [linked(listed, rest, scratch)], both.where(F.col("n") > SHORT)
        if long.take(1):
            last.append(scratch.keep(by_differences(long, listed, roots, tried, weights, scratch), "links"))
        roots = components(reduce(DataFrame.union, last), scratch, roots)
    scratch.drop(found, both)

    return own, scratch.keep(nodes.join(roots, "node", "left").select("node", "least_doc", F.coalesce("root", "node").alias("label")), "nodes"), scratch


def one_of_each(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The documents with their own columns, of each component one: that of least doc_id (of several such rows that of
    least node, then of least text; a null doc_id only if there is no other).  Documents without words stay, and so do
    columns of any name and kind; repeated rows are one document; a very long text is handled whole; an empty table
    stays empty."""
    _, labels, scratch = classes(spark, documents)
    keep = labels.groupBy("label").agg(F.min(F.struct(F.col("least_doc").isNull().alias("unknown"), "least_doc", "node")).alias("k"))
    keep = scratch.keep(keep.select(F.col("k.node").alias("kept"), F.coalesce("k.least_doc", F.lit(0)).alias("kept_doc"), F.col("k.unknown").alias("kept_unknown")), "kept")
    names, own = documents.columns, [f"c{i}" for i in range(len(documents.columns))]  # whatever they are called
    doc_id, text = own[names.index("doc_id")], own[names.index("text")]
    docs = documents.toDF(*own)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = [signature(x) if len(x) else None for _, x in shingle_sets(b.column(text))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes, pa.int64())], [*own, "node"])

    # Rows without words meet nothing, but must not all meet in one task either; nor must copies.
    docs = docs.mapInArrow(run, docs.withColumn("node", F.lit(None).cast("long")).schema)
    docs = docs.withColumns({"key": F.coalesce("node", F.xxhash64(doc_id)), "doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), "unknown": F.col(doc_id).isNull()})
    same = (F.col("key") == F.col("kept")) & (F.col("doc") == F.col("kept_doc")) & (F.col("unknown") == F.col("kept_unknown"))
    docs = docs.join(keep, same, "left").where(F.col("node").isNull() | F.col("kept").isNotNull())
    turn = F.row_number().over(Window.partitionBy("key", "doc", "unknown").orderBy(text))
    return docs.withColumn("turn", turn).where(F.col("node").isNull() | (F.col("turn") == 1)).select(*own).toDF(*names)
