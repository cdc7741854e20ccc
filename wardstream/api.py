"""The functions and results that callers know by name, as DataFrame functions.

``FUNCTIONS`` take a DataFrame or columns; ``RESULTS`` name the columns of ``pipeline(df, config, details=True)`` in which the
getters of a session's last result are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import decisions as D
from .functions import synapse as S
from .functions import text as T
from .operators import classify as C
from .operators import resources as R
from .operators import windows as W
from .plans.pipeline import pipeline


def calculate_halo(df: DataFrame, model: C.Model, text: str = "text") -> DataFrame:
    """Adds halo: the sifter's entropy, and the highest value for texts that are null, empty or too long."""
    out = C.sift(df, model, text)
    return out.select(*df.columns, F.when(T.guard_code(F.col(text)) == 0, F.col("entropy")).otherwise(T.U16).alias("halo"))


def calculate_halo_signal_legacy(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds halo: the word lists' total alone."""
    return T.bias_breakdown(df, text).select(*df.columns, F.col("total").alias("halo"))


def get_stability(low: Column, high: Column) -> Column:
    """The zone of a packed record's entropy."""
    return D.stability(S.unpacked(low, high)["entropy"])


def process_synapse(df: DataFrame, keys: list[str], order: list[str], surprise_threshold: int = 58000) -> DataFrame:
    """Adds code (0, or the error for which the ring doesn't take the record) of packed records low and high, and the
    ring's mean, variance and trend with the taken ones."""
    f = S.unpacked(F.col("low"), F.col("high"))
    code = F.coalesce(D.admission_code(f["entropy"], f["surprise"], f["bias"] == 1, surprise_threshold), F.lit(0))
    df = df.withColumns({"code": code, "__entropy": f["entropy"]}).withColumn("__taken", F.col("code") == 0)
    out = W.ring_stats(df, "__entropy", [*keys, "__taken"], order).drop("__entropy")
    return out.withColumns({n: F.when(F.col("__taken"), F.col(n)) for n in ("mean", "variance", "trend")}).drop("__taken")


def memory_stats(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """Adds mean, variance, trend and is_drifting of the last 64 values."""
    return W.ring_stats(df, value, keys, order).withColumn("is_drifting", F.abs("trend") > 10)


FUNCTIONS = {
    "calculate_halo": calculate_halo, "calculate_halo_signal_legacy": calculate_halo_signal_legacy, "calculate_utility": T.utility, "get_bias_breakdown": T.bias_breakdown,
    "check_resources": R.check_code, "get_resource_pressure": R.pressure, "get_system_cpu_load": R.cpu_deltas, "get_environmental_entropy": R.environmental_entropy,
    "get_stability": get_stability, "process_synapse": process_synapse, "memory_stats": memory_stats, "combined_risk_bits": S.combined_risk_bits, "pipeline": pipeline,
}
RESULTS = {
    "get_classifier_score": ("classifier_score",), "get_pid_state": ("fast", "slow", "prev_pressure"), "get_kernel_output": ("kernel_error", "kernel_stable", "kernel_depth"), "get_body_pressure": ("body_pressure",),
    "get_decision": ("decision",), "get_entropy": ("entropy",), "get_surprise": ("surprise",), "get_detection_flags": ("flags",), "get_oov_ratio": ("oov_byte",), "get_stages_executed": ("stages",), "get_step_count": ("step_count",),
}
