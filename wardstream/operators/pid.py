"""The leaky-integrator risk score.

Its clamps and its freeze near the limit make it no window function: it is a fold over a session's rows in order.  Short
sessions (``most`` rows or fewer, as the pipeline's are by its depth) are one aggregate over their collected structs,
in the JVM.  Sessions of any length are sorted within their partition and folded as a stream of Arrow batches, with
the state of one session at a time, so memory does not grow with a session.  Both give the same rows; arithmetic is in
doubles, and a null signal counts as 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STUCK, DRIFTING, LOW_CONFIDENCE, DECAYING, ANOMALY, ADVERSARIAL = 1, 2, 4, 8, 16, 32
#: The signals of a row.
SIGNALS = ("e_sift", "e_body", "e_mem", "e_kernel", "prob", "trend", "pressure")


@dataclass(frozen=True)
class Gains:
    kp: float = 1.0
    ki_fast: float = 0.5
    ki_slow: float = 0.3
    kd: float = 2.0
    kf: float = 0.3
    warn_gain: float = 0.5
    halt_gain: float = 1.0
    slow_decay: float = 0.99
    step_change: float = 0.5

    def __post_init__(self):
        if not (0 < self.warn_gain < self.halt_gain) or not 0.899 < self.slow_decay < 1.0:
            raise ValueError("gains must rise from warn to halt, and the decay lie in (0.899, 1)")
        if min(self.kp, self.ki_fast, self.ki_slow, self.kd, self.kf, self.step_change) < 0:
            raise ValueError("gains can't be negative")


def _clamp(x: str) -> str:
    return f"greatest(0D, least(1D, {x}))"


def _step(g: Gains, keep: bool = True) -> str:
    """SQL of the state after a row: s is the state (a fast, c slow, p the last pressure; and all rows' results, or the
    last row's risk), r the row."""
    bind = lambda name, value, inner: f"element_at(transform(array({value}), {name} -> {inner}), 1)"
    signals = "named_struct(" + ", ".join(f"'{n}', {_clamp(e)}" for n, e in (("x", "r.e_sift"), ("b", "r.e_body"), ("m", "r.e_mem"), ("q", "r.e_kernel"), ("f", "r.prob"), ("t", "abs(r.trend / 65535D)"), ("p", "r.pressure / 100D"))) + ")"
    def gain(value: float, flag: int, by: float, other: tuple[int, float] | None = None) -> str:
        rest = f"WHEN r.flags & {other[0]} <> 0 THEN {value * other[1]!r}D " if other else ""
        return f"CASE WHEN r.flags & {flag} <> 0 THEN {value * by!r}D {rest}ELSE {value!r}D END"

    gains = f"named_struct('kp', ({gain(g.kp, STUCK, 1.3)}) * CASE WHEN abs(v.p - s.p) > {g.step_change!r}D THEN 2D ELSE 1D END, 'kif', {gain(g.ki_fast, DECAYING, 1.3)}, 'kis', {gain(g.ki_slow, STUCK, 1.3)}, 'kd', {gain(g.kd, ANOMALY, 1.5, (DRIFTING, 1.2))}, 'kf', {gain(g.kf, LOW_CONFIDENCE, 1.5)})"
    est = "k.kp * v.p + k.kif * s.a + k.kis * s.c + k.kd * v.t + k.kf * v.f"
    fast = f"CASE WHEN ({est}) < {g.halt_gain!r}D THEN {_clamp('0.9D * s.a + ' + _clamp('v.x + 0.5D * v.b + 0.3D * v.q'))} ELSE s.a * 0.999D END"
    slow = f"CASE WHEN ({est}) < {g.halt_gain!r}D THEN {_clamp(repr(g.slow_decay) + 'D * s.c + ' + _clamp('v.x + 0.5D * v.m + 0.3D * v.q'))} ELSE s.c * 0.999D END"
    risk = _clamp("k.kp * v.p + k.kif * n.a + k.kis * n.c + k.kd * v.t + k.kf * v.f")
    if not keep:
        return bind("v", signals, bind("k", gains, bind("n", f"named_struct('a', {fast}, 'c', {slow})", f"CAST(named_struct('a', n.a, 'c', n.c, 'p', v.p, 'risk', {risk}) AS {LAST})")))
    state = f"named_struct('a', n.a, 'c', n.c, 'p', v.p, 'out', concat(s.out, array(named_struct('seq', r.seq, 'risk', {risk}, 'fast', n.a, 'slow', n.c, 'pressure', v.p))))"
    return bind("v", signals, bind("k", gains, bind("n", f"named_struct('a', {fast}, 'c', {slow})", f"CAST({state} AS {STATE})")))


LAST = "struct<a: double, c: double, p: double, risk: double>"
STATE = "struct<a: double, c: double, p: double, out: array<struct<seq: bigint, risk: double, fast: double, slow: double, pressure: double>>>"


#: Rows of a session up to which the fold is one aggregate.
MOST_IN_ROW = 256


def after(rows: str, gains: Gains = Gains()) -> Column:
    """The state (fast, slow, prev_pressure) and risk after the rows of an array of structs of SIGNALS and flags, in its
    order; the risk is null where there are none."""
    start = f"CAST(named_struct('a', 0D, 'c', 0D, 'p', 0D, 'risk', NULL) AS {LAST})"
    state = f"aggregate({rows}, {start}, (s, r) -> {_step(gains, keep=False)})"
    return F.expr(f"element_at(transform(array({state}), x -> named_struct('fast', x.a, 'slow', x.c, 'prev_pressure', x.p, 'risk', x.risk)), 1)")


def unit(x: float | None) -> float:
    return 1.0 if x is None else max(0.0, min(1.0, x))


def risk_of(state: dict, g: Gains, x, b, m, q, f, t, p, flags) -> float:
    """The risk of a row with signals in [0, 1]; the state (fast, slow, pressure) moves on."""
    kp = g.kp * (1.3 if flags & STUCK else 1) * (2 if abs(p - state["pressure"]) > g.step_change else 1)
    fast = g.ki_fast * (1.3 if flags & DECAYING else 1)
    slow = g.ki_slow * (1.3 if flags & STUCK else 1)
    trend = g.kd * (1.5 if flags & ANOMALY else 1.2 if flags & DRIFTING else 1)
    conf = g.kf * (1.5 if flags & LOW_CONFIDENCE else 1)

    def total() -> float:
        return kp * p + fast * state["fast"] + slow * state["slow"] + trend * t + conf * f

    if total() < g.halt_gain:
        state["fast"] = unit(0.9 * state["fast"] + unit(x + 0.5 * b + 0.3 * q))
        state["slow"] = unit(g.slow_decay * state["slow"] + unit(x + 0.5 * m + 0.3 * q))
    else:
        state["fast"] *= 0.999
        state["slow"] *= 0.999
    state["pressure"] = p
    return unit(total())


def streamed(n_keys: int, g: Gains):
    """A function over rows sorted by key (the first columns) and order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            own = list(zip(*(b.column(i).to_pylist() for i in range(n_keys)), strict=True))
            columns = [b.column(n).to_pylist() for n in (*SIGNALS, "flags")]
            out: list[list[float]] = [[], [], [], []]
            for k, (x, body, m, q, f, trend, p, flags) in zip(own, zip(*columns, strict=True), strict=True):
                if state is None or k != key:
                    key, state = k, {"fast": 0.0, "slow": 0.0, "pressure": 0.0}
                signals = (unit(x), unit(body), unit(m), unit(q), unit(f), unit(None if trend is None else abs(trend / 65535)), unit(None if p is None else p / 100))
                risk = risk_of(state, g, *signals, flags or 0)
                for column, v in zip(out, (risk, state["fast"], state["slow"], state["pressure"]), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n_keys + 1)), *(pa.array(c, pa.float64()) for c in out)], [*b.schema.names[: n_keys + 1], "risk", "fast", "slow", "prev_pressure"])

    return run


def fold(df: DataFrame, keys: list[str], seq: str = "seq", gains: Gains = Gains(), most: int | None = None) -> DataFrame:
    """keys, seq, risk, and the state after the row (fast, slow, prev_pressure), of rows with SIGNALS and flags; ``most`` bounds
    the rows of a session where the caller knows a bound."""
    rows = df.select(*keys, F.col(seq).cast("long").alias(seq), *(F.col(c).cast("double").alias(c) for c in SIGNALS), F.col("flags").cast("int").alias("flags"))
    if most is None or most > MOST_IN_ROW:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys) + 1])
        return rows.repartition(*keys).sortWithinPartitions(*keys, seq).mapInArrow(streamed(len(keys), gains), f"{schema}, risk double, fast double, slow double, prev_pressure double")
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), *SIGNALS, "flags"))).alias("rows"))
    start = f"CAST(named_struct('a', 0D, 'c', 0D, 'p', 0D, 'out', array()) AS {STATE})"
    out = grouped.withColumn("o", F.explode(F.expr(f"aggregate(rows, {start}, (s, r) -> {_step(gains)}).out")))
    return out.select(*keys, F.col("o.seq").alias(seq), "o.risk", "o.fast", "o.slow", F.col("o.pressure").alias("prev_pressure"))
