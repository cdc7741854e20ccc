"""The stream gives what the batch plan gives, whatever the micro-batches."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardstream.functions import decisions as D
from wardstream.plans import catalogue
from wardstream.plans.pipeline import Config, HaltedError, passed, pipeline, strict
from wardstream.streaming import sessions


def test_stream_equals_batch(spark, tmp_path):
    rows = catalogue.from_events(lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet"), True, True)
    names = [x.split()[0] for x in sessions.INPUT.split(", ")]
    config = Config(max_steps=5)
    want = pipeline(rows, config).select("session_id", "seq", "stages", "flags", "monitor", "step_count", F.round("risk", 5), "decision.*").collect()
    for i in range(2):  # two micro-batches, the later rows in the second
        rows.select(*names).where((F.col("seq") <= 30) if i == 0 else (F.col("seq") > 30)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sessions.INPUT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sessions.run_sessions(stream, config).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert spark.table("decided").where("late").count() == 0
    got = spark.table("decided").drop("late").withColumn("risk", F.round("risk", 5)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


NAMES = [x.split()[0] for x in sessions.INPUT.split(", ")]
WANTED = ("session_id", "seq", "stages", "flags", "monitor", "step_count", "risk", "decision.*")


def observations(seed, n=500):
    """Sessions with repeated seq, equal rows, null texts, pressure, resets and ends."""
    rnd, rows = random.Random(seed), []
    for _ in range(n):
        pressed = rnd.random() < 0.3
        rows.append((rnd.randrange(12), rnd.randrange(60), rnd.choice([None, "view", "View", "click of", "\u212Aill", "kill", "a b"]), rnd.choice([None, "", "view click of"]), rnd.choice([0, 100, 9000, 19000, 30000, 36000, 41000]), rnd.choice([0, 43000, 57000, 59000]), rnd.random() < 0.05,
                     rnd.choice([0, 500, 950, 31000, 60000]) if pressed else None, rnd.choice([10, 40, 60, 90]) if pressed else None, rnd.choices([None, "reset_full", "reset_detectors", "end"], [20, 1, 1, 1])[0]))
    return rows + rows[:20]


def stepped(rows, config):
    """The stream's function over all rows in one micro-batch."""
    out, frame = [], pd.DataFrame(rows, columns=NAMES).astype(object)
    for _, own in frame.where(frame.notna(), None).groupby("session_id"):
        memory = sessions.fresh()
        for row in sorted(own.itertuples(index=False), key=sessions.place):
            out.append((row.session_id, row.seq, *sessions.step(memory, row, config)))
            if row.control == "end":
                memory = sessions.fresh()
    return out


def same(got, want):
    """Equal rows, risks up to the last place of their rounding."""
    a, b = (sorted(((str((*r[:6], *r[7:])), r[6] or 0.0) for r in rows)) for rows in (got, want))
    return len(a) == len(b) and all(x[0] == y[0] and abs(x[1] - y[1]) < 2e-6 for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("dal", D.DALS)
def test_same_decisions_at_each_level(spark, dal):
    for i, (gate, patterns, policy) in enumerate([(False, (), D.Policy(dal=dal)), (True, ("KILL", "view"), D.Policy(dal=dal, escalate_pressure="Emergency", halt_entropy=35000)), (True, (), D.Policy(dal=dal, warn_entropy=100, bias_escalates=False))]):
        rows, config = observations(i), Config(policy=policy, use_gate=gate, patterns=patterns, max_steps=7)
        df = spark.createDataFrame([(*r, 0) for r in rows], sessions.INPUT + ", oov_byte int")
        got = pipeline(df, config).selectExpr(*WANTED).collect()
        assert len(got) == len(rows) and same(got, stepped(rows, config))


def test_late_rows_ends_and_expiry(spark, tmp_path):
    def row(seq, control=None):
        return (1, seq, "a", "b", 20000, 0, False, None, None, control)

    for part in ([row(1), row(2), row(2)], [row(2), row(1), row(3, "end"), row(4)], [row(5)]):
        spark.createDataFrame(part, sessions.INPUT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sessions.INPUT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sessions.run_sessions(stream, Config(max_steps=9), ttl_ms=3_600_000).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    got = sorted((r.seq, r.late, r.step_count) for r in spark.table("late").collect())
    assert [x for x in got if x[1]] == [(1, True, None), (2, True, None)]
    assert [x for x in got if not x[1]] == [(1, False, 1), (2, False, 2), (2, False, 3), (3, False, 4), (4, False, 1), (5, False, 2)]


def test_strict_and_passed(spark):
    rows = [(1, 1, "a", "b", 100, 0, False, 0), (1, 2, "a", "b", 100, 0, True, 0)]
    out = pipeline(spark.createDataFrame(rows, "session_id long, seq long, text string, objective string, entropy int, surprise int, has_bias boolean, oov_byte int"))
    assert [r.seq for r in passed(out).collect()] == [1] and strict(out.where("seq = 1")).count() == 1
    with pytest.raises(HaltedError, match="BiasHaloDetected"):
        strict(out)


def test_config_warnings():
    assert [w.split()[0] for w in Config().warnings()] == ["halt_entropy", "escalate_entropy"]


def test_long_sessions(spark, monkeypatch):
    """Folded in the row, or apart and joined back: the same results and states."""
    from wardstream.operators import pid

    df = spark.createDataFrame([(*r, 0) for r in observations(5)], sessions.INPUT + ", oov_byte int")
    config = Config(max_steps=20, use_gate=True, policy=D.Policy(dal="B"))
    names = ("session_id", "seq", "decision.label", "risk", "round(fast, 9) AS fast", "round(slow, 9) AS slow", "prev_pressure", "round(trend, 9) AS trend")
    a = sorted(map(tuple, pipeline(df, config, details=True).selectExpr(*names).collect()), key=str)
    monkeypatch.setattr(pid, "MOST_IN_ROW", 5)
    assert sorted(map(tuple, pipeline(df, config, details=True).selectExpr(*names).collect()), key=str) == a
