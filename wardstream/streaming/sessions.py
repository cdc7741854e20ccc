"""The pipeline over a stream: one state for each session, rows of a micro-batch in the batch plan's order.

The state holds what the windows of the batch plan look back on: the last 64 admitted entropies, the run of equal texts, the
confidence run, the two sums, the envelope, the step count and the integrators.  A row whose seq is not above that
of its session's earlier micro-batches is late: it changes nothing and comes out as a row with ``late`` set and nothing
else but its keys, so that late rows can be counted.  All other rows are the batch plan's for the same input, whatever
the policy; ``tests`` hold the two together.

A session's state ends with a row of control ``end`` (after that row's own decision) and, where ``ttl_ms`` is given, when
nothing came for so long; a later row begins a new session.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import decisions as D
from ..functions.lexicon import ERROR_CODES, SPACE_JAVA
from ..operators import pid
from ..operators.windows import RING
from ..plans.pipeline import BODY, DETECTION, KERNEL, MEMORY, MONITOR, SIFT, Config

INPUT = "session_id long, seq long, text string, objective string, entropy int, surprise int, has_bias boolean, body_entropy int, pressure int, control string"
OUTPUT = "session_id long, seq long, stages int, flags int, monitor string, step_count long, risk double, label string, severity int, code int, reason string, cooldown_ms int, late boolean"
_SPACE = re.compile(SPACE_JAVA)
SAFE = D.PROCEED
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh_detectors() -> dict:
    return {"text": None, "run": 0, "last": None, "falls": 0, "high": 0, "low": 0, "top": None, "bottom": None}


def fresh() -> dict:
    return {"ring": [], "steps": 0, "fast": 0.0, "slow": 0.0, "pressure": 0.0, "detectors": fresh_detectors()}


def halt(error: str, cooldown: int = 30000) -> tuple:
    return "halt", 3, ERROR_CODES[error], error, cooldown


def escalate(reason: str, cooldown: int = 5000) -> tuple:
    return "escalate", 2, 2, reason, cooldown


def warn(reason: str) -> tuple:
    return "warning", 1, 1, reason, 0


def downgraded(d: tuple, dal: str) -> tuple:
    if not D.DOWNGRADES[dal] or not D.DOWNGRADES[dal][0] <= d[1] <= D.DOWNGRADES[dal][1]:
        return d
    _, _, label, reason = D.DOWNGRADES[dal]
    return {"escalate": escalate(reason, d[4]), "warning": warn(reason), "safe": SAFE}[label]


def ladder(e: int, s: int, bias: bool, p: D.Policy) -> tuple:
    """As the batch plan's, before the assurance level."""
    if e >= p.halt_entropy:
        return halt("CognitiveInstability")
    if bias and p.bias_escalates:
        return escalate("BiasDetected")
    if e >= p.escalate_entropy:
        return escalate("EntropyApproachingLimit")
    if s >= p.escalate_surprise:
        return escalate("SurpriseElevated")
    return warn("entropy elevated") if e >= p.warn_entropy else warn("surprise elevated") if s >= p.warn_surprise else SAFE


def level(percent: int) -> int:
    return 0 if percent <= 25 else 1 if percent <= 50 else 2 if percent <= 75 else 3


def under_pressure(e: int, percent: int, p: D.Policy) -> tuple:
    if e < p.halt_entropy and level(percent) >= D.LEVELS.index(p.escalate_pressure):
        return downgraded(escalate("ResourcePressure"), p.dal)
    return downgraded(ladder(e, 0, False, p), p.dal)


def gate(flags: int, e: int, s: int, p: D.Policy) -> tuple:
    """What the detections alone decide."""
    for bit, d in ((pid.ADVERSARIAL, halt("BiasHaloDetected")), (pid.ANOMALY, halt("CognitiveInstability")), (pid.STUCK, escalate("StuckAgent")), (pid.DRIFTING, escalate("GoalDriftDetected")), (pid.DECAYING, warn("Confidence decay detected")), (pid.LOW_CONFIDENCE, warn("Low model confidence"))):
        if flags & bit:
            return downgraded(d, p.dal)
    return downgraded(ladder(e, s, False, p), p.dal)


def folded(text: str) -> str:
    return text.translate(_FOLD)


def detect(d: dict, row, c: Config) -> tuple[int, str]:
    """Flags and monitor state, with the detectors moved on."""
    e, conf = row.entropy, row.entropy / 65535
    d["run"] = d["run"] + 1 if d["run"] and d["text"] == row.text else 1
    d["text"] = row.text
    d["falls"] = d["falls"] + 1 if d["last"] is not None and conf < d["last"] else 0
    d["last"] = conf
    d["high"], d["low"] = max(0, d["high"] + e - 50), max(0, d["low"] - e - 50)
    goal = [w for w in _SPACE.split(row.objective or "") if w][:8]
    seen = [w for w in _SPACE.split(row.text or "") if w][:8]
    drifting = bool(goal) and 1 - sum(w in goal for w in seen) / len(goal) > c.drift_threshold
    flags = pid.STUCK * (d["run"] >= c.max_repetitions) + pid.DRIFTING * drifting + pid.LOW_CONFIDENCE * (conf < c.min_confidence) + pid.DECAYING * (d["falls"] >= c.decay_threshold) + pid.ANOMALY * (d["high"] > 200 or d["low"] > 200)
    if row.text is not None and folded(row.text) in {folded(p) for p in c.patterns[-8:]}:
        flags += pid.ADVERSARIAL
    bit = max(0, e.bit_length() - 1)
    state = "Stable"
    if d["top"] is not None:
        state = "High" if bit > d["top"] + c.monitor_k else "Low" if d["bottom"] > c.monitor_k and bit < d["bottom"] - c.monitor_k else "Stable"
    d["top"], d["bottom"] = (bit, bit) if d["top"] is None else (max(d["top"], bit), min(d["bottom"], bit))
    return flags, state


def step(state: dict, row, c: Config) -> tuple:
    """stages, flags, monitor, step_count, risk and the five fields of the decision."""
    if row.control == "reset_full":
        state.update(fresh())
    elif row.control == "reset_detectors":
        state["detectors"] = fresh_detectors()
    pressed = row.pressure is not None
    if pressed and row.pressure > 50:
        return BODY, 0, "Stable", min(c.max_steps, state["steps"]), None, *under_pressure(row.body_entropy, row.pressure, c.policy)
    body = BODY if pressed else 0
    e_body = pid.unit(row.body_entropy / 1000) if pressed else 0.0
    if row.has_bias or row.entropy > 40000 or row.surprise > c.surprise_threshold:
        d = halt("BiasHaloDetected") if row.has_bias else halt("CognitiveInstability") if row.entropy > 40000 else escalate("hallucination")
        return SIFT | MEMORY | body, 0, "Stable", min(c.max_steps, state["steps"]), None, *d
    ring = state["ring"] = [*state["ring"], row.entropy][-RING:]
    state["steps"] += 1
    if state["steps"] > c.max_steps:
        return SIFT | MEMORY | KERNEL | body, 0, "Stable", c.max_steps, None, *escalate("reasoning depth exceeded", 10000)
    flags, monitor = detect(state["detectors"], row, c)
    stages = SIFT | MEMORY | KERNEL | DETECTION | MONITOR | body
    if c.use_gate and (d := gate(flags, row.entropy, row.surprise, c.policy))[1] == 3:
        return stages, flags, monitor, state["steps"], None, *d
    n, total = len(ring), sum(ring)
    xy = sum((RING - n + i) * v for i, v in enumerate(ring))
    sx, sxx = RING * (RING - 1) // 2, (RING - 1) * RING * (2 * RING - 1) // 6
    trend = (RING * xy - sx * total) / (RING * sxx - sx * sx)
    x = row.entropy / 65535
    risk = pid.risk_of(state, c.gains, x, e_body, min(1.0, abs(row.entropy - total / RING) / 65535), x, x, pid.unit(abs(trend / 65535)), pid.unit(int(e_body * 100) / 100), flags)
    if e_body > 0.9:
        risk = 1.0
    if monitor != "Stable":
        risk = max(risk, c.gains.halt_gain)
    risk = pid.unit(risk)
    d = halt("CognitiveInstability") if risk >= c.gains.halt_gain else escalate("PID risk elevated") if risk >= c.gains.warn_gain else SAFE
    return stages, flags, monitor, state["steps"], round(risk, 6), *d


#: The batch plan's order of rows of equal seq; nulls first.
ORDER = ["seq", "text", "entropy", "surprise", "has_bias", "objective", "body_entropy", "pressure", "control"]


def place(row) -> tuple:
    return tuple((v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0) for v in (getattr(row, n) for n in ORDER))


def run_sessions(stream: DataFrame, config: Config = Config(), ttl_ms: int | None = None) -> DataFrame:
    """The decisions of a stream of INPUT rows, as OUTPUT rows in append mode."""
    names = [x.split()[0] for x in OUTPUT.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        memory = json.loads(state.get[0]) if state.exists else fresh() | {"seq": None}
        rows = pd.concat(list(batches)).astype(object)
        out, last, ended = [], memory["seq"], False
        for row in sorted(rows.where(rows.notna(), None).itertuples(index=False), key=place):
            if last is not None and row.seq <= last:
                out.append((row.session_id, row.seq, *[None] * (len(names) - 3), True))
                continue
            if ended:
                memory, ended = fresh() | {"seq": None}, False
            memory["seq"] = int(row.seq)
            out.append((row.session_id, row.seq, *step(memory, row, config), False))
            if row.control == "end":
                ended, last = True, None
        if ended:
            state.remove()
        else:
            state.update((json.dumps(memory),))
            if ttl_ms is not None:
                state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=names).astype(object)

    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy("session_id").applyInPandasWithState(run, OUTPUT, "memory string", "append", timeout)
