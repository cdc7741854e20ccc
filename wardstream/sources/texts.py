"""Reading and writing observations and models."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import guard_code
from ..operators.classify import Model

LABELS = ("authority", "social_proof", "scarcity", "urgency", "emotional_appeal", "expertise_signaling", "semantic_traps", "template_fitting")


def guarded(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds input_code: -9 for texts that are null, empty or too long."""
    return df.withColumn("input_code", guard_code(F.col(text)))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a text and its labels."""
    return spark.read.schema("text string, label struct<" + ", ".join(f"{n}: int" for n in LABELS) + ">").json(path)


def write_labelled(df: DataFrame, path: str) -> None:
    df.select("text", F.struct(*LABELS).alias("label")).write.json(path)


def checked_model(vocabulary: DataFrame, intercept: float, threshold: float) -> Model:
    """A model of finite weights and distinct tokens, rounded to five decimals."""
    rounded = vocabulary.select("token", F.round("idf", 5).alias("idf"), F.round("coef", 5).alias("coef"))
    bad = rounded.where("token IS NULL OR idf IS NULL OR coef IS NULL OR isnan(idf) OR isnan(coef) OR abs(idf) = double('infinity') OR abs(coef) = double('infinity')")
    if bad.limit(1).count() or rounded.groupBy("token").count().where("count > 1").limit(1).count():
        raise ValueError("a vocabulary has distinct tokens and finite weights")
    return Model(rounded, intercept, threshold)


ENTRY = np.dtype([("hash", "<u8"), ("idf", "<f4"), ("coef", "<f4")])


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for blob in b.column("content"):
            e = np.frombuffer(blob.as_buffer(), ENTRY, offset=12)
            yield pa.RecordBatch.from_arrays([pa.array(e["hash"].astype(np.int64)), pa.array(np.round(e["idf"].astype(float), 5)), pa.array(np.round(e["coef"].astype(float), 5))], ["hash", "idf", "coef"])


def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a file: whether its length fits its count, and entries are sorted, distinct and finite."""
    for b in batches:
        out = []
        for blob in b.column("content"):
            data = blob.as_buffer()
            ok = len(data) >= 12 and len(data) == 12 + ENTRY.itemsize * int(np.frombuffer(data, "<u4", 1)[0])
            if ok:
                e = np.frombuffer(data, ENTRY, offset=12)
                ok = bool(np.isfinite(np.frombuffer(data, "<f4", 2, 4)).all() and (e["hash"][1:] > e["hash"][:-1]).all() and np.isfinite(e["idf"]).all() and np.isfinite(e["coef"]).all())
            out.append(ok)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.bool_())], ["ok"])


def read_binary_model(spark: SparkSession, path: str) -> Model:
    """A model of a count, threshold and intercept, then entries (hash, idf, coef) sorted by hash.  Only the first 12 bytes
    come to the driver; ``classify`` looks its texts' items up by their hashes."""
    file = spark.read.format("binaryFile").load(path).select("content")
    if not all(r.ok for r in file.mapInArrow(sound, "ok boolean").collect()):
        raise ValueError("a model's length must fit its count, and its entries must be sorted, distinct and finite")
    _, threshold, intercept = struct.unpack("<Iff", bytes(file.select(F.substring("content", 1, 12)).first()[0]))
    return Model(file.mapInArrow(entries, "hash long, idf double, coef double"), intercept, threshold)
