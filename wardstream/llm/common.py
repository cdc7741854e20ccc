"""Pieces that several operators of this subpackage use.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere here.  A batch of texts is handled as one UTF-8 buffer (the
Arrow string buffer itself), so splitting and hashing are numpy passes and no Python string is made.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import spread

WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes handed to Python at once; a batch of texts must fit in a small worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bytes of text that one numpy pass works on.
CHUNK = 1 << 18

U = np.uint64
_STEP, _A, _B = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_P = U(0xD6E8FEB86659FD93)
_PINV = U(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits (SplitMix64's last step)."""
    x = x + U((int(_STEP) * (int(seed) + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * _A
    x = (x ^ (x >> U(27))) * _B
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, CHUNK + 1)
        for k, p in enumerate((_P, _PINV)):
            full = np.full(n, p, np.uint64)
            full[0] = 1
            _POWERS[k] = np.cumprod(full, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small; texts differ in length by orders of magnitude."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        digits = (now or "").rstrip("bB")
        if not digits.isdigit() or not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        at = tempfile.mkdtemp(prefix="checkpoints-")  # one machine: every task sees it
        spark.sparkContext.setCheckpointDir(at)
    if not at:
        raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
    return at.rstrip("/")


class Scratch:
    """Tables in the shared folder: written once, read by every later step, so a lost executor costs its tasks only.

    ``drop`` removes a table that no later step reads; what the returned DataFrame reads stays until the
    shared folder is cleaned.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.at}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def remove(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.remove(t._scratch_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty), whatever other columns there are; the rows of a table that is too small
    for a row group a core are dealt out."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return spread(own, "doc_id")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column (null: empty) and each row's offset in them, first to last."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes, a single longer row alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hash() has the hash of any span of the bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * _powers(len(total))[1][start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool, separator: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a batch: start and end in ``data``, hash, and each row's first word (one more at the end)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~separator[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, span_hash(prefix_hash(data), start, end), np.searchsorted(start, offsets)


def windows(h: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hashes of every k consecutive words of ``h``, rows not regarded; empty if there are fewer."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - k + 1, salt, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * _A
        out ^= out >> U(29)
    return mix(out, k)


def release() -> None:
    """Gives back what this worker has freed, so that an idle one doesn't hold the memory of its largest batch."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(f):
    """A function over batches after which the worker's memory is given back."""
    @wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def public_vocabulary(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
