"""Decisions as CASE ladders over columns.

A decision is a struct of label, severity (0 to 4), code, reason and cooldown_ms.  Besides the ladders there is ``exit_now``,
which callers make themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import ERROR_CODES, ERROR_MESSAGES

LEVELS = ("Nominal", "Elevated", "Critical", "Emergency")
DALS = "ABCDE"


@dataclass(frozen=True)
class Policy:
    warn_entropy: int = 30000
    escalate_entropy: int = 40000
    halt_entropy: int = 50000
    warn_surprise: int = 42600
    escalate_surprise: int = 55700
    bias_escalates: bool = True
    escalate_pressure: str = "Critical"
    dal: str = "A"

    def __post_init__(self):
        if self.dal not in DALS or self.escalate_pressure not in LEVELS:
            raise ValueError("unknown assurance level or pressure level")


def decision(label: str, severity: int, code, reason, cooldown: Column | int) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(severity).alias("severity"), F.lit(code).cast("int").alias("code"), F.lit(reason).alias("reason"), (cooldown if isinstance(cooldown, Column) else F.lit(cooldown)).cast("int").alias("cooldown_ms"))


PROCEED = ("safe", 0, 0, "", 0)


def proceed() -> Column:
    return decision(*PROCEED)


def warn(reason: str) -> Column:
    return decision("warning", 1, 1, reason, 0)


def escalate(reason: str, cooldown: Column | int = 5000) -> Column:
    return decision("escalate", 2, 2, reason, cooldown)


def halt(error: str, cooldown: Column | int = 30000) -> Column:
    return decision("halt", 3, ERROR_CODES[error], error, cooldown)


def exit_now(error: str) -> Column:
    """The process is to end: severity 4, a code of its own, no cooldown."""
    return decision("exit", 4, -8, error, 0)


def can_proceed(d: Column) -> Column:
    return d["severity"] <= 1


def must_halt(d: Column) -> Column:
    return d["severity"] == 3


def is_blocking(d: Column) -> Column:
    return d["severity"] >= 2


def should_exit(d: Column) -> Column:
    return d["severity"] == 4


def halt_reason(d: Column) -> Column:
    """The error of a halt or an exit; else null."""
    return F.when(d["severity"] >= 3, d["reason"])


def error_message(code: Column) -> Column:
    """The message of an error's code; null for other codes."""
    out = F.lit(None).cast("string")
    for k, text in ERROR_MESSAGES.items():
        out = F.when(code == k, text).otherwise(out)
    return out


def code_name(code: Column) -> Column:
    """The decision that a code stands for."""
    return F.when(code == 0, "Proceed").when(code == 1, "Warn").when(code == 2, "Escalate").when(code.between(-8, -1), "Halt").when(code == -9, "Invalid").otherwise("Unknown")


def code_severity(code: Column) -> Column:
    """Severity by the code alone: an exit can't be told from a halt, and unknown codes are the severest."""
    return F.when(code.between(0, 2), code).when(code.between(-8, -1), 3).otherwise(4).cast("int")


def dal_of(code: Column) -> Column:
    """The assurance level that a control code configures; whatever isn't 0 to 3 is the least one."""
    return F.when(code == 0, "A").when(code == 1, "B").when(code == 2, "C").when(code == 3, "D").otherwise("E")


def requires_action(percent: Column) -> Column:
    return pressure_ordinal(percent) >= 2


def is_stable(entropy: Column, threshold: Column | int) -> Column:
    return entropy <= threshold


def zone_of_monitor(state: Column) -> Column:
    """The stability that a monitor's state means."""
    return F.when(state == "Stable", "Stable").otherwise("Unstable")


def any_detected(stuck: Column, drifting: Column, low: Column, decaying: Column, n_patterns: Column) -> Column:
    return stuck | drifting | low | decaying | (n_patterns > 0)


def is_high_risk(risk: Column) -> Column:
    return risk > 0.7


#: What an assurance level makes of decisions: from and to which severity, and what they become.
DOWNGRADES = {"A": (), "B": (3, 3, "escalate", "DAL B: Halt downgraded"), "C": (2, 3, "warning", "DAL C: Escalation downgraded"), "D": (2, 4, "warning", "DAL D: Capped at Warn"), "E": (0, 4, "safe", "")}


def downgraded(d: Column, dal: str) -> Column:
    """What an assurance level makes of a decision."""
    if not DOWNGRADES[dal]:
        return d
    low, high, label, reason = DOWNGRADES[dal]
    less = {"escalate": escalate(reason, d["cooldown_ms"]), "warning": warn(reason), "safe": proceed()}[label]
    return F.when(d["severity"].between(low, high), less).otherwise(d)


def ladder(entropy: Column, surprise: Column, has_bias: Column, p: Policy = Policy()) -> Column:
    d = F.when(entropy >= p.halt_entropy, halt("CognitiveInstability"))
    d = d.when(has_bias & F.lit(p.bias_escalates), escalate("BiasDetected")).when(entropy >= p.escalate_entropy, escalate("EntropyApproachingLimit"))
    d = d.when(surprise >= p.escalate_surprise, escalate("SurpriseElevated")).when(entropy >= p.warn_entropy, warn("entropy elevated"))
    return downgraded(d.when(surprise >= p.warn_surprise, warn("surprise elevated")).otherwise(proceed()), p.dal)


def pressure_level(percent: Column) -> Column:
    return F.when(percent <= 25, "Nominal").when(percent <= 50, "Elevated").when(percent <= 75, "Critical").otherwise("Emergency")


def pressure_ordinal(percent: Column) -> Column:
    return F.when(percent <= 25, 0).when(percent <= 50, 1).when(percent <= 75, 2).otherwise(3)


def with_pressure(entropy: Column, surprise: Column, has_bias: Column, percent: Column, p: Policy = Policy()) -> Column:
    hot = pressure_ordinal(percent) >= LEVELS.index(p.escalate_pressure)
    return F.when(entropy >= p.halt_entropy, downgraded(halt("CognitiveInstability"), p.dal)).when(hot, downgraded(escalate("ResourcePressure"), p.dal)).otherwise(ladder(entropy, surprise, has_bias, p))


def stability(entropy: Column) -> Column:
    return F.when(entropy > 50000, "Unstable").when(entropy >= 40000, "Pressure").otherwise("Stable")


def from_stability(zone: Column) -> Column:
    """Not subject to the assurance level."""
    return F.when(zone == "Unstable", halt("CognitiveInstability")).when(zone == "Pressure", warn("cognitive pressure detected")).otherwise(proceed())


def from_detection(n_patterns: Column, risk: Column, stuck: Column, drifting: Column, decaying: Column, low: Column, entropy: Column, surprise: Column, p: Policy = Policy()) -> Column:
    d = F.when(n_patterns > 0, halt("BiasHaloDetected")).when(risk > 0.85, halt("CognitiveInstability")).when(stuck, escalate("StuckAgent")).when(drifting, escalate("GoalDriftDetected"))
    d = d.when(decaying, warn("Confidence decay detected")).when(low, warn("Low model confidence"))
    return downgraded(d.otherwise(ladder(entropy, surprise, F.lit(False), Policy(**{**p.__dict__, "dal": "A"}))), p.dal)


def validate_code(entropy: Column, has_bias: Column) -> Column:
    return F.when(has_bias, -3).when(entropy > 40000, -2).otherwise(0)


def admission_code(entropy: Column, surprise: Column, has_bias: Column, surprise_threshold: int = 58000) -> Column:
    """Null for rows that working memory takes."""
    return F.when(has_bias, -3).when(entropy > 40000, -2).when(surprise > surprise_threshold, -4)


def overridden(risk: Column, bias: Column, exhausted: Column, unstable: Column, halt_gain: float = 1.0) -> Column:
    r = F.when(bias, F.greatest(risk, F.lit(halt_gain + 0.001))).otherwise(risk)
    r = F.when(exhausted, F.lit(1.0)).otherwise(r)
    r = F.when(unstable, F.greatest(r, F.lit(halt_gain))).otherwise(r)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), r))


#: Bits of the overrides.
OVERRIDES = {"bias": 1, "exhausted": 2, "unstable": 4}


def override_bits(bits: Column) -> Column:
    """The known bits of a mask."""
    return bits.bitwiseAND(7)


def contains(bits: Column, other: Column | int) -> Column:
    """Whether all of the other's bits are set."""
    return bits.bitwiseAND(other) == other


def overridden_by(risk: Column, bits: Column, halt_gain: float = 1.0) -> Column:
    """The risk after the overrides of a mask."""
    return overridden(risk, *(contains(bits, b) for b in OVERRIDES.values()), halt_gain)


def from_risk(risk: Column, warn_gain: float = 0.5, halt_gain: float = 1.0) -> Column:
    return F.when(F.isnan(risk), halt("CognitiveInstability", 0)).when(risk >= halt_gain, halt("CognitiveInstability")).when(risk >= warn_gain, escalate("PID risk elevated")).otherwise(proceed())
