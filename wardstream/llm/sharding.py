"""Sharding by sampled splitters.

Rows are ordered by (hash of the text, doc_id), so equal texts stand together.  Size-weighted samples of that key give
splitters at quantiles of the bytes; rows are range-partitioned by them.  A text that is drawn for more than one
splitter has a range of its own.  A range that came out too full is subdivided: by its keys, or, where it has a single
one (a group of equal texts may be larger than a shard), by doc_id.  A shard is the run of ranges that lie in its share
of the bytes, by the ranges' exact sums; a range that two shards would share is overfull for the first and subdivided
at the row where its share ends.  Law ``bytes``: no two shards differ by more than two of the largest sizes.  A group of
equal texts lies in one shard unless such a cut falls into it; then it lies in consecutive ones.

Size is the UTF-8 bytes of the text (null: none) plus ``OVERHEAD``.  Null texts are a group of their own and have
the checksum of the empty text.  A null doc_id comes first among equal texts; repeated rows take places next to each
other.  Other columns are not read.  An empty table gives an empty result; with fewer rows than shards some shards stay
empty.  Very long texts are one row of their size; a shard that holds one may be larger by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .ordered import running

OVERHEAD = 16
#: Ranges aimed at, and samples drawn for each; sample and splitters have that bound at any input.
RANGES, SAMPLES = 2048, 16
#: Bytes that a range should hold; a table of more than RANGES of them has fuller ranges.
RANGE_BYTES = 8 << 20


def keys(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(F.col("text").isNull(), text).alias("key"),
    )


def splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Keys that cut the rows into about ``ranges`` ranges of about equal bytes, from a size-weighted sample; a key that
    holds a range or more is cut off on both sides."""
    draws = ranges * SAMPLES
    chance = F.col("size") * F.lit(draws / max(1, total))
    # A uniform number that the row decides, so a task that runs again draws the same sample.
    uniform = F.pmod(F.xxhash64("doc_id", "key", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.select("key", (F.floor(chance) + (uniform < chance - F.floor(chance)).cast("long")).alias("weight")).where("weight > 0")
    drawn = drawn.groupBy("key").agg(F.sum("weight").alias("weight")).sort("key").collect()  # about ``draws`` rows at most
    cuts, seen, n = set(), 0, sum(r.weight for r in drawn)
    for r in drawn:
        before, seen = seen, seen + r.weight
        due = seen * ranges // n - before * ranges // n
        if due:
            cuts.add(r.key)
        if due > 1 and r.key < 2**63 - 1:
            cuts.add(r.key + 1)
    return sorted(cuts)


def ranged(cuts):
    """A function that numbers each row's range by binary search."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = np.searchsorted(cuts.value, b.column("key").to_numpy(), "right").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], [*b.schema.names, "part"])

    return run


def shards(spark: SparkSession, documents: DataFrame, n_shards: int) -> DataFrame:
    """doc_id, size, text_crc32, key, shard and slot of every document."""
    rows = Scratch(spark, "sharding").keep(keys(documents), "keys")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = max(1, min(RANGES, max(4 * n_shards, total // RANGE_BYTES)))
    cuts = spark.sparkContext.broadcast(np.array(splitters(rows, total, ranges), np.int64))
    rows = rows.mapInArrow(ranged(cuts), "doc_id long, size long, text_crc32 long, key long, part long")
    # Overfull ranges are cut by the key's place inside them and, where there is a single key, by doc_id's.
    full = rows.groupBy("part").agg(F.sum("size").alias("bytes"), *(f(c).cast("double").alias(n) for c, f, n in (("key", F.min, "low"), ("key", F.max, "high"), ("doc_id", F.min, "first"), ("doc_id", F.max, "last"))))
    full = full.withColumn("pieces", F.ceil(F.col("bytes") / F.lit(2.0 * max(1.0, total / ranges))).cast("long"))
    rows = rows.join(F.broadcast(full), "part")  # 2 * RANGES rows at most

    def place(column: str, low: str, high: str):
        return F.floor((F.coalesce(F.col(column).cast("double"), F.col(low)) - F.col(low)) / (F.col(high) - F.col(low) + 1) * F.col("pieces"))

    piece = F.when(F.col("pieces") <= 1, 0).when(F.col("low") < F.col("high"), place("key", "low", "high")).otherwise(F.coalesce(place("doc_id", "first", "last"), F.lit(0)))
    rows = rows.select("doc_id", "size", "text_crc32", "key", F.struct("part", piece.cast("long").alias("piece")).alias("part"), F.lit(1).cast("long").alias("one"), F.lit(0).alias("whole"))
    placed = running(rows, ["whole"], "part", [F.col("key"), F.col("doc_id"), F.col("size")], {"bytes_before": "size", "rows_before": "one"})
    # What lies before a range and in it, in exact sums; a row's middle decides only where a range meets two shards.
    pieces = rows.groupBy("part").agg(F.sum("size").alias("piece_bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece of a range
    pieces = pieces.select(F.col("part").alias("piece"), F.coalesce(F.sum("piece_bytes").over(before), F.lit(0)).alias("piece_before"), "piece_bytes")
    placed = placed.join(F.broadcast(pieces), F.col("part") == F.col("piece"))

    def shard_at(doubled: str):
        return F.least(F.lit(n_shards - 1), F.expr(f"({doubled}) * {n_shards}L div {max(1, 2 * total)}L")).cast("int")

    low, high = shard_at("2 * piece_before"), shard_at("2 * (piece_before + piece_bytes) - 1")
    placed = placed.withColumn("shard", F.when(low == high, low).otherwise(shard_at("2 * bytes_before + size")))
    first = placed.groupBy("shard").agg(F.min("rows_before").alias("first_row")).withColumnRenamed("shard", "shard__s")  # n_shards rows
    out = placed.join(F.broadcast(first), F.col("shard") == F.col("shard__s"))
    return out.select("doc_id", "size", "text_crc32", "key", "shard", (F.col("rows_before") - F.col("first_row")).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(spark, table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
