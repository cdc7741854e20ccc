"""Resource functions over a table of host samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decisions as D


def rss_ratio(rss: Column, ceiling: Column) -> Column:
    return F.when(ceiling > 0, rss / ceiling)


def environmental_entropy(rss_share: Column, iowait: Column, load: Column) -> Column:
    """0 to 1000; what can't be measured counts as 1 for memory and load, and 0 for iowait."""
    return F.floor(F.least(F.lit(1000.0), 500 * F.coalesce(rss_share, F.lit(1.0)) + 250 * F.coalesce(iowait, F.lit(0.0)) + 250 * F.least(F.coalesce(load / 10, F.lit(1.0)), F.lit(1.0)))).cast("int")


def pressure(rss: Column, ceiling: Column) -> Column:
    return F.when(ceiling > 0, F.floor(F.least(F.lit(100.0), 100 * rss / ceiling))).otherwise(100).cast("int")


def check_code(rss: Column, ceiling: Column) -> Column:
    return F.when((ceiling == 0) | (rss >= ceiling), -5).otherwise(0)


def ceiling_of(total: Column, fraction: float) -> Column:
    """The ceiling that is a share of the memory; 0 where that can't be measured."""
    return F.when(total > 0, F.floor(total * F.lit(float(fraction)))).otherwise(0).cast("long")


def check_with_entropy(rss: Column, ceiling: Column, entropy: Column) -> Column:
    """A struct of code and, where memory allows, the fresh record's entropy; unmeasured memory counts as exhausted."""
    code = F.when((ceiling == 0) | rss.isNull(), -5).otherwise(check_code(rss, ceiling))
    return F.struct(code.alias("code"), F.when(code == 0, entropy).alias("entropy"))


def body_output(rss: Column, ceiling: Column) -> Column:
    """A struct of code, error (the share of the ceiling), pressure and exhausted; all of memory where it isn't measured
    or there is no ceiling."""
    code = check_with_entropy(rss, ceiling, F.lit(0))["code"]
    ok = code == 0
    share = rss.cast("double") / F.when(ok, ceiling)
    return F.struct(code.alias("code"), F.when(ok, share).otherwise(1.0).alias("error"), F.when(ok, F.floor(share * 100)).otherwise(100).cast("int").alias("pressure"), (~ok).alias("exhausted"))


def admission(df: DataFrame, keys: list[str], order: list[str], policy: D.Policy = D.Policy(), retries: int = 3) -> DataFrame:
    """What a gate that samples the host before each batch decides, from a table of samples (entropy, pressure, rss,
    ceiling): of the first ``retries`` samples of a key the first that may proceed is admitted, if its memory allows.

    One row a key: attempts, code (0, -5 or, if none may proceed, -7) and waited_ms, the cooldowns before.  Where the code
    isn't 0 the caller takes the path under pressure.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    d = D.with_pressure(F.col("entropy"), F.lit(0), F.lit(False), F.col("pressure"), policy)
    df = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= retries).withColumn("__d", d)
    df = df.withColumn("__code", F.when(D.can_proceed(F.col("__d")), check_with_entropy(F.col("rss"), F.col("ceiling"), F.col("entropy"))["code"]))
    first = F.min(F.when(F.col("__code").isNotNull(), F.struct("__n", "__code")))
    out = df.groupBy(*keys).agg(first.alias("f"), F.max("__n").alias("n"), F.collect_list(F.struct("__n", F.greatest(F.lit(1), F.col("__d.cooldown_ms")).alias("ms"))).alias("waits"))
    waited = F.aggregate("waits", F.lit(0).cast("long"), lambda s, x: s + F.when(F.col("f").isNull() | (x["__n"] < F.col("f.__n")), x["ms"]).otherwise(0))
    return out.select(*keys, F.coalesce("f.__n", "n").alias("attempts"), F.coalesce("f.__code", F.lit(-7)).alias("code"), waited.alias("waited_ms"))


def cpu_deltas(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """cpu_load (percent) and iowait_ratio between consecutive samples of counters user, nice, system, idle and iowait."""
    w = Window.partitionBy(*keys).orderBy(*order)
    names = ("user", "nice", "system", "idle", "iowait")
    d = {n: F.col(n) - F.lag(n).over(w) for n in names}
    df = df.withColumns({f"__{n}": c for n, c in d.items()})
    total = sum((F.col(f"__{n}") for n in names[1:]), F.col("__user"))
    active = F.col("__user") + F.col("__nice") + F.col("__system")
    return df.withColumns({"cpu_load": F.when(total > 0, active / total * 100).otherwise(0.0), "iowait_ratio": F.when(total > 0, F.col("__iowait") / total).otherwise(0.0)}).drop(*(f"__{n}" for n in names))


def host_sample(spark) -> DataFrame:
    """One row from this host's /proc; null where it can't be read."""
    def lines(path: str) -> dict[str, list[str]]:
        try:
            with open(path) as f:
                return {x.split()[0].rstrip(":"): x.split()[1:] for x in f if x.split()}
        except OSError:
            return {}

    cpu, own, mem = lines("/proc/stat").get("cpu", []), lines("/proc/self/status"), lines("/proc/meminfo")
    load = next(iter(lines("/proc/loadavg")), None)
    n = [int(x) for x in cpu[:5]] + [None] * (5 - len(cpu[:5]))
    kb = lambda d, k: int(d[k][0]) * 1024 if k in d else None
    return spark.createDataFrame([(kb(own, "VmRSS"), kb(mem, "MemTotal"), float(load) if load else None, *n)], "rss long, total long, load double, user long, nice long, system long, idle long, iowait long")


def control_signals(e_sift: Column, e_body: Column, mean: Column, e_mem: Column, e_kernel: Column) -> Column:
    """An array of structs (stage, error, setpoint): errors in [0, 1]; only the memory keeps a reference, its mean."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))
    zero = F.lit(0.0)
    stages = (("sifter", e_sift, zero), ("memory", e_mem, mean / 65535), ("kernel", e_kernel, zero), ("body", e_body, zero))
    return F.array(*(F.struct(F.lit(n).alias("stage"), unit(e).alias("error"), s.cast("double").alias("setpoint")) for n, e, s in stages))
