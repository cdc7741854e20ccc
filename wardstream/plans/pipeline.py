"""The whole pipeline over sessions: sift, memory, kernel, detection, risk, monitor, decision, without a loop.

A session's rows are taken in the order of seq; rows of equal seq are observations each, in the order of text, entropy,
surprise, has_bias and the other columns.  Null signals of the sifter are not expected.

Input rows: session_id, seq, text, objective, entropy, surprise, has_bias, probability, oov_byte; optionally
body_entropy and pressure (both null: no pressure path) and control (reset_detectors or reset_full, which take effect
before their own row, or end, after which the session begins anew).  All windows share the session's partitioning, so there is one
shuffle, unless a session may be longer than a row can carry: then the fold has its own, and its results are joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import text as T
from ..functions.lexicon import ERROR_MESSAGES
from ..operators import pid, windows

SIFT, MEMORY, KERNEL, DETECTION, MONITOR, BODY = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20


TOLERANCE = 0.15
#: Entropy below which the kernel's output is stable.
STABILITY = 50000


@dataclass(frozen=True)
class Config:
    policy: D.Policy = field(default_factory=D.Policy)
    gains: pid.Gains = field(default_factory=pid.Gains)
    surprise_threshold: int = 58000
    max_steps: int = 10
    max_repetitions: int = 3
    drift_threshold: float = 0.5
    min_confidence: float = 0.3
    decay_threshold: int = 3
    monitor_k: int = 3
    use_gate: bool = False
    patterns: tuple[str, ...] = ()

    def __post_init__(self):
        if not 1 <= self.monitor_k <= 5 or min(self.max_steps, self.max_repetitions, self.decay_threshold, self.surprise_threshold) < 1:
            raise ValueError("counts must be positive, and monitor_k from 1 to 5")
        if not (0 <= self.drift_threshold <= 1 and 0 <= self.min_confidence <= 1):
            raise ValueError("shares must lie in [0, 1]")

    def warnings(self) -> list[str]:
        """Thresholds of the policy that lie more than ``TOLERANCE`` off those of the risk; both may be wanted so."""
        out, g = [], self.gains
        for name, other, want in (("halt_entropy", "halt_gain", g.halt_gain), ("escalate_entropy", "0.8 halt_gain", 0.8 * g.halt_gain), ("warn_entropy", "warn_gain", g.warn_gain)):
            own = getattr(self.policy, name) / T.U16
            off = abs(own / want - 1) if min(own, want) > 1.2e-7 else abs(own - want)
            if off > TOLERANCE:
                out.append(f"{name} is a risk of {own:.4f}, {other} is {want:.4f}: {100 * off:.1f} % apart")
        return out


def pipeline(df: DataFrame, c: Config = Config(), details: bool = False) -> DataFrame:
    """session_id, seq, decision, stages, flags, oov_byte, entropy, surprise, monitor, body_pressure, step_count, risk; with
    ``details`` also classifier_score (of an optional column score; 0 for rows that end early), the kernel's output (null for
    these), and the session's state after the row: the ring's statistics and the integrators."""
    for name, kind in (("body_entropy", "int"), ("pressure", "int"), ("control", "string"), ("score", "double")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    total_order = ["seq", "text", "entropy", "surprise", "has_bias", "objective", "body_entropy", "pressure", "control", "oov_byte"]
    df = df.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(*total_order)))
    w = Window.partitionBy("session_id").orderBy("place")
    resets = lambda *names: F.sum(F.coalesce(F.col("control").isin(*names).cast("int"), F.lit(0))).over(w)
    ended = F.coalesce(F.sum(F.coalesce((F.col("control") == "end").cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumns({"full_epoch": resets("reset_full") + ended, "det_epoch": resets("reset_full", "reset_detectors") + ended})
    df = df.withColumn("pressed", F.col("pressure").isNotNull())
    df = df.withColumn("gated", F.coalesce(D.pressure_ordinal(F.col("pressure")) >= 2, F.lit(False)) & F.col("pressed"))
    df = df.withColumn("e_body", F.when(F.col("pressed"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("body_entropy") / 1000))).otherwise(0.0))
    df = df.withColumn("error", D.admission_code(F.col("entropy"), F.col("surprise"), F.col("has_bias"), c.surprise_threshold))
    df = df.withColumn("admitted", F.col("error").isNull() & ~F.col("gated"))
    df = windows.kernel_depth(df, "admitted", ["session_id", "full_epoch"], ["place"], c.max_steps)
    df = df.withColumn("class", F.when(~F.col("admitted"), 0).when(F.col("depth_exceeded"), 1).otherwise(2))

    df = windows.ring_stats(df, "entropy", ["session_id", "full_epoch", "admitted"], ["place"])
    detector = ["session_id", "full_epoch", "det_epoch", "class"]
    df = df.withColumn("confidence", F.col("entropy") / T.U16)
    df = windows.repetition(df, "text", detector, ["place"], c.max_repetitions)
    df = windows.confidence(df, "confidence", detector, ["place"], c.min_confidence, c.decay_threshold)
    df = windows.cusum(df, "entropy", detector, ["place"], 0, 50, 200)
    df = windows.monitor(df, "entropy", detector, ["place"], c.monitor_k)
    drift = T.drift_score(F.col("text"), F.col("objective"))
    tests = ((pid.STUCK, F.col("is_stuck")), (pid.DRIFTING, F.coalesce(drift > c.drift_threshold, F.lit(False))), (pid.LOW_CONFIDENCE, F.col("is_low")), (pid.DECAYING, F.col("is_decaying")), (pid.ANOMALY, F.col("anomaly")), (pid.ADVERSARIAL, T.is_adversarial(F.col("text"), list(c.patterns))))
    df = df.withColumn("flags", sum((F.when(t, bit).otherwise(0) for bit, t in tests), F.lit(0)))
    flag = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    gate = D.from_detection(F.when(flag(pid.ADVERSARIAL), 1).otherwise(0), F.when(flag(pid.ANOMALY), 0.9).otherwise(0.0), flag(pid.STUCK), flag(pid.DRIFTING), flag(pid.DECAYING), flag(pid.LOW_CONFIDENCE), F.col("entropy"), F.col("surprise"), c.policy)
    df = df.withColumn("gate", gate)
    df = df.withColumn("stopped", (F.col("class") == 2) & F.lit(c.use_gate) & (F.col("gate.severity") == 3))

    unit = F.col("entropy") / T.U16
    complete, so_far = F.col("class") == 2, Window.partitionBy("session_id", "full_epoch").orderBy("place")
    folded = complete & ~F.col("stopped")
    signals = {"e_sift": unit, "e_body": F.col("e_body"), "e_mem": F.least(F.lit(1.0), F.abs(F.col("entropy") - F.col("mean")) / T.U16), "e_kernel": unit, "prob": unit, "trend": F.col("trend"), "pressure": F.floor(F.col("e_body") * 100).cast("double")}
    if c.max_steps <= pid.MOST_IN_ROW:
        # So few rows of a session are folded that each row carries those up to it; nothing is joined back.
        row = F.when(folded, F.struct(*(v.cast("double").alias(n) for n, v in signals.items()), F.col("flags").alias("flags")))
        df = df.withColumn("rows", F.collect_list(row).over(so_far.rowsBetween(Window.unboundedPreceding, 0))).withColumn("pid", pid.after("rows", c.gains)).drop("rows")
        df = df.withColumns({"pure_risk": F.col("pid.risk"), "fast": F.col("pid.fast"), "slow": F.col("pid.slow"), "prev_pressure": F.col("pid.prev_pressure")})
    else:
        rows = df.where(folded).select("session_id", "full_epoch", "place", "flags", *(v.alias(n) for n, v in signals.items()))
        risks = pid.fold(rows, ["session_id", "full_epoch"], "place", c.gains).select("session_id", "place", F.col("risk").alias("pure_risk"), "fast", "slow", "prev_pressure")
        df = df.join(risks, ["session_id", "place"], "left")
        if details:
            df = df.withColumns({n: F.coalesce(F.last(F.when(folded, F.col(n)), ignorenulls=True).over(so_far), F.lit(0.0)) for n in ("fast", "slow", "prev_pressure")})
    risk = D.overridden(F.col("pure_risk"), F.lit(False), F.col("e_body") > 0.9, F.col("state") != "Stable", c.gains.halt_gain)
    df = df.withColumn("risk", F.when(folded, risk))
    level = F.col("pressure")
    out = F.when(F.col("gated"), D.with_pressure(F.col("body_entropy"), F.lit(0), F.lit(False), level, c.policy))
    out = out.when(F.col("error") == -3, D.halt("BiasHaloDetected")).when(F.col("error") == -2, D.halt("CognitiveInstability")).when(F.col("error") == -4, D.escalate("hallucination"))
    out = out.when(F.col("class") == 1, D.escalate("reasoning depth exceeded", 10000)).when(F.col("stopped"), F.col("gate")).otherwise(D.from_risk(F.col("risk"), c.gains.warn_gain, c.gains.halt_gain))
    own = F.when(F.col("error").isNotNull(), SIFT | MEMORY).when(F.col("class") == 1, SIFT | MEMORY | KERNEL).otherwise(SIFT | MEMORY | KERNEL | DETECTION | MONITOR)
    stages = F.when(F.col("gated"), BODY).otherwise(own.bitwiseOR(F.when(F.col("pressed"), BODY).otherwise(0)))
    more = []
    if details:
        live = lambda name, here: F.coalesce(F.last(F.when(here, F.col(name)), ignorenulls=True).over(so_far), F.lit(0.0)).alias(name)
        more = [F.when(complete, F.coalesce("score", F.lit(0.0))).otherwise(0.0).alias("classifier_score"), F.when(complete, unit).alias("kernel_error"), F.when(complete, F.col("entropy") < STABILITY).alias("kernel_stable"), F.when(complete, F.col("step_count")).alias("kernel_depth")]
        more += [live(n, F.col("admitted")) for n in ("mean", "variance", "trend")] + [F.col(n) for n in ("fast", "slow", "prev_pressure")]
    return df.select(
        "session_id", "seq", out.alias("decision"), stages.alias("stages"), F.when(complete, F.col("flags")).otherwise(0).alias("flags"), "oov_byte", "entropy", "surprise",
        F.when(complete, F.col("state")).otherwise("Stable").alias("monitor"), F.when(F.col("pressed"), F.col("pressure")).alias("body_pressure"), "step_count", F.round("risk", 6).alias("risk"), *more,
    )


def is_safe(decision: Column) -> Column:
    return decision["severity"] == 0


def passed(decided: DataFrame) -> DataFrame:
    """The gate before a consumer: rows that may proceed."""
    return decided.where(D.can_proceed(F.col("decision")))


class HaltedError(Exception):
    """A row was halted; ``code`` and ``reason`` say why."""

    def __init__(self, code: int, reason: str):
        super().__init__(f"{reason} ({code}): {ERROR_MESSAGES.get(code, 'exit')}")
        self.code, self.reason = code, reason


class BiasError(HaltedError):
    pass


class InstabilityError(HaltedError):
    pass


class ResourceError(HaltedError):
    pass


ERRORS = {-3: BiasError, -2: InstabilityError, -5: ResourceError, -7: ResourceError}


def strict(decided: DataFrame) -> DataFrame:
    """The rows as they are, if none is halted or ends the process; else the first such row's error is raised."""
    worst = decided.where(F.col("decision.severity") >= 3).orderBy("session_id", "seq").select("decision.code", "decision.reason").first()
    if worst:
        raise ERRORS.get(worst.code, HaltedError)(worst.code, worst.reason)
    return decided
