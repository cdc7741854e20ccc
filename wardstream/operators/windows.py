"""Ordered state over a session as windows: every function adds columns to rows of one partition and order, so Spark
shuffles once for all that share them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = 64
RECENT = 8


def session(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def ring_stats(df: DataFrame, value: str, keys: list[str], order: list[str], size: int = RING) -> DataFrame:
    """mean, variance and trend (least-squares slope) of the last ``size`` values, missing ones being 0."""
    w = session(keys, order)
    last = w.rowsBetween(1 - size, 0)
    df = df.withColumn("__rn", F.row_number().over(w)).withColumn("__v", F.col(value).cast("long"))
    df = df.withColumn("__s", F.sum("__v").over(last)).withColumn("__q", F.sum(F.col("__v") * F.col("__v")).over(last)).withColumn("__sx", F.sum(F.col("__v") * F.col("__rn")).over(last))
    # The newest value stands at size - 1.
    xy = (size - 1 - F.col("__rn")) * F.col("__s") + F.col("__sx")
    sx, sxx = size * (size - 1) // 2, (size - 1) * size * (2 * size - 1) // 6
    mean = F.col("__s").cast("double") / size
    slope = (size * xy - sx * F.col("__s")).cast("double") / (size * sxx - sx * sx) if size > 1 else F.lit(0.0)
    variance = (size * F.col("__q") - F.col("__s") * F.col("__s")).cast("double") / (size * size)
    return df.withColumns({"mean": mean, "variance": variance, "trend": slope}).drop("__rn", "__v", "__s", "__q", "__sx")


def run_length(df: DataFrame, name: str, starts: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Adds the place of each row in its run; a run begins where ``starts`` holds."""
    w = session(keys, order)
    df = df.withColumn("__start", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("__run", F.sum("__start").over(w))
    return df.withColumn(name, F.row_number().over(session([*keys, "__run"], order))).drop("__start", "__run")


def repetition(df: DataFrame, value: str, keys: list[str], order: list[str], most: int = 3) -> DataFrame:
    """repetitions: rows up to this one that hold the same value; is_stuck from ``most`` on."""
    w = session(keys, order)
    df = df.withColumn("__before", F.lag(value).over(w))
    df = run_length(df, "repetitions", ~F.col(value).eqNullSafe(F.col("__before")) | (F.row_number().over(w) == 1), keys, order)
    return df.withColumn("is_stuck", F.col("repetitions") >= most).drop("__before")


def unique_recent(df: DataFrame, value: str, keys: list[str], order: list[str], size: int = RECENT) -> DataFrame:
    return df.withColumn("unique_patterns", F.size(F.array_distinct(F.collect_list(value).over(session(keys, order).rowsBetween(1 - size, 0)))))


def confidence(df: DataFrame, value: str, keys: list[str], order: list[str], least: float, decay: int) -> DataFrame:
    """decay_count (strict falls in a row), is_low, is_decaying, and confidence_trend, the mean change over the last 8."""
    w = session(keys, order)
    df = df.withColumn("__before", F.lag(value).over(w))
    df = run_length(df, "__fall", ~(F.col(value) < F.col("__before")), keys, order)
    df = df.withColumn("decay_count", F.col("__fall") - 1)
    last = w.rowsBetween(1 - RECENT, 0)
    n = F.count(value).over(last)
    trend = F.when(n < 2, 0.0).otherwise((F.col(value) - F.first(value).over(last)) / (n - 1))
    return df.withColumns({"is_low": F.col(value) < least, "is_decaying": F.col("decay_count") >= decay, "confidence_trend": trend}).drop("__before", "__fall")


def cusum(df: DataFrame, value: str, keys: list[str], order: list[str], mean: int, slack: int, limit: int) -> DataFrame:
    """s_high, s_low and anomaly of the two-sided test, from prefix sums and their running minimum."""
    w = session(keys, order)
    v = F.col(value)
    df = df.withColumn("__up", F.sum(v - mean - slack).over(w)).withColumn("__down", F.sum(mean - v - slack).over(w))
    high = F.col("__up") - F.least(F.lit(0), F.min("__up").over(w))
    low = F.col("__down") - F.least(F.lit(0), F.min("__down").over(w))
    return df.withColumns({"s_high": high, "s_low": low}).withColumn("anomaly", (F.col("s_high") > limit) | (F.col("s_low") > limit)).drop("__up", "__down")


def msb(v: Column) -> Column:
    """The place of the highest bit; 0 for 0."""
    return F.length(F.bin(v)) - 1


UNSEEN = 4294967295


def thresholds(top: Column, bottom: Column) -> dict[str, Column]:
    """The high, low and warning threshold that an envelope of magnitudes gives; before any row (null) the high one is
    out of reach."""
    high = F.when(top.isNull(), F.lit(UNSEEN)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.least(top, F.lit(31)) + 1) - 1)
    low = F.when(bottom > 0, F.call_function("shiftleft", F.lit(1).cast("long"), bottom)).otherwise(0)
    return {"threshold_high": high.cast("long"), "threshold_low": low.cast("long"), "threshold_warn": F.when(top.isNull(), 0).otherwise(F.floor(high * 4 / F.lit(5))).cast("long")}


def monitor(df: DataFrame, value: str, keys: list[str], order: list[str], k: int, after: bool = True) -> DataFrame:
    """state against the envelope of all earlier rows' magnitudes, and the thresholds that the envelope gives after the
    row, or before it."""
    w = session(keys, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__m", msb(F.col(value).cast("long"))).withColumn("__hi", F.max("__m").over(before)).withColumn("__lo", F.min("__m").over(before))
    state = F.when(F.col("__m") > F.col("__hi") + k, "High").when((F.col("__lo") > k) & (F.col("__m") < F.col("__lo") - k), "Low").otherwise("Stable")
    top, bottom = (F.max("__m").over(w), F.min("__m").over(w)) if after else (F.col("__hi"), F.col("__lo"))
    df = df.withColumn("state", state).withColumn("__top", top).withColumn("__bottom", bottom)
    return df.withColumns(thresholds(F.col("__top"), F.col("__bottom"))).drop("__m", "__hi", "__lo", "__top", "__bottom")


def kernel_depth(df: DataFrame, admitted: str, keys: list[str], order: list[str], most: int) -> DataFrame:
    """mem_rank: admitted rows so far; depth_exceeded: admitted past ``most``; step_count."""
    df = df.withColumn("mem_rank", F.sum(F.col(admitted).cast("int")).over(session(keys, order)))
    return df.withColumn("depth_exceeded", F.col(admitted) & (F.col("mem_rank") > most)).withColumn("step_count", F.least(F.lit(most), F.col("mem_rank")))
