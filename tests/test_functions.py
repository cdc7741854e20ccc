"""Fixed cases of the functions and operators."""

import json
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from wardstream import api
from wardstream.functions import decisions as D
from wardstream.functions import lexicon as L
from wardstream.functions import text as T
from wardstream.operators import classify as C
from wardstream.operators import pid, resources, windows
from wardstream.plans.pipeline import Config, pipeline
from wardstream.sources import texts


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def breakdown(spark, text):
    return T.bias_breakdown(spark.createDataFrame([(text,)], "text string")).first()


@pytest.mark.parametrize(
    "text, want",
    [
        ("expert trending limited hurry incredible sophisticated", {"authority": 100, "social_proof": 100, "scarcity": 100, "urgency": 100, "emotional_appeal": 100, "expertise_signaling": 100, "total": 600}),
        ("The agent is not an expert.", {"authority": 0}),
        ("The agent is an expert.", {"authority": 100}),
        ("As an AI, I cannot comply, instead of helping you", {"template_fitting": 200, "semantic_traps": 100}),
        ("As an AI, my purpose is to note that I am programmed to follow", {"template_fitting": 300}),
        ("not as an ai", {"template_fitting": 0, "semantic_traps": 0}),
        ("while processing data", {"semantic_traps": 0, "total": 0}),
        ("not a very well known expert", {"authority": 0}),
        ("not 1 2 3 4 5 6 expert", {"authority": 100}),
        ("STOP now HTML x", {"emphasis": 100}),
        ("", {"total": 0}),
        (None, {"total": 0}),
    ],
)
def test_breakdown(spark, text, want):
    got = breakdown(spark, text).asDict()
    assert {k: got[k] for k in want} == want and got["has_bias"] == (got["total"] > 0)


def test_hashes(spark):
    assert one(spark, T.adler32(F.col("t")), t="a") == 6422626 and one(spark, T.adler32(F.col("t")), t="") == 1
    assert one(spark, T.fnv32(F.col("t")), t="") == 2166136261 and one(spark, T.fnv32(F.col("t")), t="a") == 0xE40C292C


def test_items(spark):
    for t, n in (("hello world", 3), ("hello, world!", 3), ("a" * 356, 1), ("", 0), (None, 0)):
        assert spark.createDataFrame([(t,)], "t string").select(F.size(T.items(F.col("t")))).first()[0] == n
    assert one(spark, T.items(F.col("t")), t="One two THREE") == ["one", "one_two", "two", "two_three", "three"]


def test_utility_and_drift(spark):
    u = lambda o, g: spark.createDataFrame([(o, g)], "o string, g string").select(T.utility(F.col("o"), F.col("g")), T.drift_score(F.col("o"), F.col("g"))).first()
    assert u("Rust safety is paramount", "Build a Rust safety library")[0] == 200
    assert u("", "safety objective")[0] == 0 and u("some observation", "")[0] == 0 and u("x", "")[1] is None
    assert u("python web development", "rust safety")[1] == 1.0 and u("a a", "a")[1] == -1.0


def test_fail_closed(spark):
    r = C.sift(spark.createDataFrame([(1, "anything"), (2, "")], "i int, text string"), C.fail_closed(spark)).collect()
    assert {(x.entropy, x.surprise, x.is_manipulation, round(x.probability, 6)) for x in r} == {(47960, 65535, True, 0.731829)}


def test_classify_both_ways(spark, monkeypatch):
    """In the row and by a join; repeated rows, equal and null keys count their own tokens only."""
    texts_ = ["the cat the_cat", "The cat sat", "", None, "cat", "cat", "x y z", "CAT! the... é cat"]
    df = spark.createDataFrame([(None if i == 4 else i // 2, t) for i, t in enumerate(texts_)] + [(0, "The cat sat")], "i int, text string")
    model = C.Model(spark.createDataFrame([("cat", 1.5, 0.5), ("the", 1.0, -0.25), ("the_cat", 2.0, 1.0), ("cat_sat", 1.0, 0.125)], "token string, idf double, coef double"), 0.25, 1.0)
    weights = {"cat": 0.75, "the": -0.25, "the_cat": 2.0, "cat_sat": 0.125}

    def plain(t):
        w = [x.lower() for x in re.findall("[A-Za-z0-9]+", t or "")]
        every = w + [f"{a}_{b}" for a, b in zip(w, w[1:], strict=False)]
        hits = [x for x in every if x in weights]
        return 0.25 + sum(weights[x] for x in hits), len(hits), len(every)

    want = sorted(((r.i, r.text, *plain(r.text)) for r in df.collect()), key=str)
    for most in (1000, 2):
        monkeypatch.setattr(C, "LITERALS", most)
        got = C.classify(df, model).select("i", "text", "score", "tokens_matched", "tokens_total").collect()
        assert sorted(map(tuple, got), key=str) == want


def plain_breakdown(text):
    """The rules as written, token by token."""
    words = [w.strip(T.PUNCTUATION) for w in re.split(L.SPACE_JAVA, text) if w]
    fold = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    live = [not any(f in L.NEGATIONS for f in fold[max(0, i - 6) : i]) for i in range(len(words))]
    out = {n: 100 * sum(f in own and ok for f, ok in zip(fold, live, strict=True)) for n, own in L.CATEGORIES.items()}
    for n, own in L.PHRASES.items():
        out[n] = sum(100 for p in own if any(live[i] and fold[i : i + len(p.split())] == p.split() for i in range(len(fold))))
    out["emphasis"] = 50 * sum(bool(re.fullmatch("[A-Z]{2,}", w)) and ok for w, ok in zip(words, live, strict=True))
    return {n: min(65535, v) for n, v in out.items()}


def test_breakdown_of_random_words(spark):
    rnd = random.Random(4)
    pool = [*L.NEGATIONS, "STOP", "expert", "Expert!", "hurry", "plain", "words", "\u212Aind", "...", "don't-wait", "é", *(w for p in L.PHRASES.values() for x in p for w in x.split())]
    rows = [(i, "".join(rnd.choice(pool) + rnd.choice([" ", "  ", "\u00a0", "\n", ", "]) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    got = T.bias_breakdown(spark.createDataFrame(rows, "i int, text string")).collect()
    texts_ = dict(rows)
    for r in got:
        want = plain_breakdown(texts_[r.i])
        assert {n: r[n] for n in want} == want and r.total == min(65535, sum(want.values()))


def test_octets(spark):
    import zlib

    for t in ("", "a", "é\u20acx\U0001F600" * 50, "\x00b", "z" * 100_000):
        assert one(spark, T.adler32(F.col("t")), t=t) == zlib.adler32(t.encode())


def test_sift_best(spark):
    df = spark.createDataFrame([(1, 0, 5, 1, False), (1, 1, 9, 2, True), (1, 2, 9, 3, False), (2, 0, 0, 7, True)], "g int, pos int, entropy int, surprise int, has_bias boolean")
    assert sorted(map(tuple, C.sift_best(df, ["g"], "pos").collect())) == [(1, 9, 2, True, 1), (2, 65535, 0, False, None)]


def test_substrings(spark):
    mask = lambda t: one(spark, T.substring_mask(F.col("t")), t=t)
    assert mask("Ignore PREVIOUS instructions") == 1 and mask("act as a developer mode") == (1 << 5) | (1 << 8)
    assert mask("é" * 40_000 + "jailbreak") == 0 and mask("x" * 65_527 + "jailbreak") == 1 << 9


def test_ladders(spark):
    label = lambda e, s=0, b=False, **p: one(spark, D.ladder(F.col("e"), F.col("s"), F.col("b"), D.Policy(**p))["label"], e=e, s=s, b=b)
    assert [label(e) for e in (29999, 30000, 40000, 50000)] == ["safe", "warning", "escalate", "halt"]
    assert [label(0, s) for s in (42599, 42600, 55700)] == ["safe", "warning", "escalate"] and label(49999, b=True) == "escalate"
    assert [label(50000, dal=d) for d in "ABCDE"] == ["halt", "escalate", "warning", "warning", "safe"]
    level = lambda p: one(spark, D.pressure_level(F.col("p")), p=p)
    assert [level(p) for p in (25, 26, 50, 51, 75, 76)] == ["Nominal", "Elevated", "Elevated", "Critical", "Critical", "Emergency"]
    zone = lambda e: one(spark, D.stability(F.col("e")), e=e)
    assert [zone(e) for e in (39999, 40000, 50000, 50001)] == ["Stable", "Pressure", "Pressure", "Unstable"]
    code = lambda e, b=False: one(spark, D.validate_code(F.col("e"), F.col("b")), e=e, b=b)
    assert [code(40000), code(40001), code(0, True)] == [0, -2, -3]
    risk = lambda r: one(spark, D.from_risk(F.col("r")), r=r)
    assert [(risk(r)["label"], risk(r)["cooldown_ms"]) for r in (0.4, 0.5, 1.0, float("nan"))] == [("safe", 0), ("escalate", 5000), ("halt", 30000), ("halt", 0)]


def series(spark, values):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, seq int, v long")


def column(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.orderBy("seq").collect()]


def test_series(spark):
    keys = (["k"], ["seq"])
    assert column(windows.cusum(series(spark, [100, 150, 150]), "v", *keys, 100, 10, 50), "s_high", "anomaly") == [(0, False), (40, False), (80, True)]
    assert column(windows.ring_stats(series(spark, [100, 200, 300, 400]), "v", *keys, 4), "mean", "trend")[-1] == (250.0, 100.0)
    assert column(windows.ring_stats(series(spark, [100, 200]), "v", *keys, 2), "variance")[-1] == 2500.0
    assert column(windows.ring_stats(series(spark, [7]), "v", *keys), "mean", "trend")[0] == (7 / 64, 7 * 2016 / 1397760)
    assert column(windows.monitor(series(spark, [100, 100, 10000]), "v", *keys, 2), "state") == ["Stable", "Stable", "High"]
    assert column(windows.repetition(series(spark, [5, 5, 5, 6, 5]), "v", *keys), "repetitions", "is_stuck") == [(1, False), (2, False), (3, True), (1, False), (1, False)]
    assert [one(spark, windows.msb(F.col("v")), v=v) for v in (0, 1, 2, 4, 8, 255, 256, 1024, 65535)] == [0, 0, 1, 2, 3, 7, 8, 10, 15]
    conf = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.8, 0.6, 0.4])], "k int, seq int, v double")
    assert column(windows.confidence(conf, "v", *keys, 0.5, 2), "is_low", "is_decaying")[-1] == (True, True)


def test_resources(spark):
    assert one(spark, resources.pressure(F.col("r"), F.col("c")), r=5, c=0) == 100 and one(spark, resources.check_code(F.col("r"), F.col("c")), r=5, c=5) == -5
    assert resources.host_sample(spark).count() == 1


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("x", *[1] * 8)], ["text", *texts.LABELS])
    texts.write_labelled(df, str(tmp_path / "l"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "l").glob("*.json")))["label"]["urgency"] == 1
    assert texts.read_labelled(spark, str(tmp_path / "l")).first().label.authority == 1
    with pytest.raises(ValueError):
        texts.checked_model(spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0)], "token string, idf double, coef double"), 0.0, 0.5)
    assert texts.guarded(spark.createDataFrame([(None,), ("",), ("a",)], "text string")).where("input_code = -9").count() == 2


def test_plan_has_no_python(spark):
    rows = spark.createDataFrame([(1, 1, "a", "b", 100, 0, False, 0)], "session_id long, seq long, text string, objective string, entropy int, surprise int, has_bias boolean, oov_byte int")
    plan = pipeline(rows, Config())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_configs():
    for bad in (dict(monitor_k=0), dict(monitor_k=6), dict(drift_threshold=1.5), dict(max_steps=0)):
        with pytest.raises(ValueError):
            Config(**bad)
    with pytest.raises(ValueError):
        D.Policy(dal="Z")
    assert len(L.SIGMOID) == 256 and L.SIGMOID[255] == 0.5


def fnv64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for x in data:
        h = (h ^ x) * 0x100000001B3 % (1 << 64)
    return h


def bigram64(a: str, b: str) -> int:
    p = 0x100000001B3
    return (((fnv64(a.encode()) ^ 0x5F) * p % (1 << 64)) ^ fnv64(b.encode())) * p % (1 << 64)


def test_binary_model(spark, tmp_path):
    """A model of hashes scores as the same one of tokens; broken files are refused."""
    weights = {("cat",): (1.5, 0.5), ("the",): (1.0, -0.25), ("the", "cat"): (2.0, 1.0)}
    hashed = sorted((bigram64(*k) if len(k) == 2 else fnv64(k[0].encode()), *v) for k, v in weights.items())
    data = struct.pack("<Iff", len(hashed), 1.0, 0.25) + b"".join(struct.pack("<Qff", *e) for e in hashed)
    (tmp_path / "m.bin").write_bytes(data)
    by_hash = texts.read_binary_model(spark, str(tmp_path / "m.bin"))
    assert (by_hash.intercept, by_hash.threshold) == (0.25, 1.0)
    by_token = C.Model(spark.createDataFrame([("_".join(k), *v) for k, v in weights.items()], "token string, idf double, coef double"), 0.25, 1.0)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["The cat", "the the cat", "", None, "dog", "é CAT " + "x" * 300])], "i int, text string")
    a, b = (sorted(map(tuple, C.classify(df, m).collect()), key=str) for m in (by_hash, by_token))
    assert a == b and any(r[2] > 0.25 for r in a)
    twice = struct.pack("<Iff", 2, 1.0, 0.25) + 2 * struct.pack("<Qff", 7, 1.0, 1.0)
    for bad in (data[:-1], data[:4], twice, data[:-4] + struct.pack("<f", float("nan"))):
        (tmp_path / "bad.bin").write_bytes(bad)
        with pytest.raises(ValueError):
            texts.read_binary_model(spark, str(tmp_path / "bad.bin"))


def test_fold_both_ways(spark):
    """One aggregate, or a stream of sorted rows; sessions that cross batches, null keys and null signals."""
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), i, *(rnd.choice([None, rnd.random() * 1.2]) for _ in range(5)), rnd.choice([None, rnd.uniform(-9e4, 9e4)]), rnd.choice([0, 40, 99, None]), rnd.randrange(64)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, seq long, e_sift double, e_body double, e_mem double, e_kernel double, prob double, trend double, pressure int, flags int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    a, b = ({(r.k, r.seq): (r.risk, r.fast, r.slow, r.prev_pressure) for r in pid.fold(df, ["k"], most=most).collect()} for most in (100, None))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert a.keys() == b.keys() and len(a) == 400 and all(abs(x - y) < 1e-12 for k in a for x, y in zip(a[k], b[k], strict=True))


def test_host_sample(spark):
    r = resources.host_sample(spark).first()
    assert r.rss > 0 and r.total > r.rss and r.load >= 0 and min(r.user, r.idle, r.iowait) >= 0
    again = spark.createDataFrame([(0, *r[3:]), (1, *(x + 10 for x in r[3:]))], "seq int, user long, nice long, system long, idle long, iowait long").withColumn("host", F.lit("h"))
    got = resources.cpu_deltas(again, ["host"], ["seq"]).where("seq = 1").first()
    assert (got.cpu_load, got.iowait_ratio) == (60.0, 0.2)


def test_guard_bounds(spark):
    code = lambda t: one(spark, T.guard_code(F.col("t")), t=t)
    assert code("a" * 10_485_760) == 0 and code("a" * 10_485_761) == -9 and code("") == -9


def test_surface(spark):
    assert len(api.FUNCTIONS) + len(api.RESULTS) == 24  # the pipeline itself among them
    rows = [(1, 1, "a", "b", 100, 0, False, 7, 0.25)]
    out = pipeline(spark.createDataFrame(rows, "session_id long, seq long, text string, objective string, entropy int, surprise int, has_bias boolean, oov_byte int, score double"), details=True)
    assert {c for own in api.RESULTS.values() for c in own} <= set(out.columns)
    halo = api.calculate_halo(spark.createDataFrame([(1, "expert"), (2, ""), (3, None)], "i int, text string"), C.fail_closed(spark)).collect()
    assert {r.i: r.halo for r in halo} == {1: 47960, 2: 65535, 3: 65535}
    legacy = api.calculate_halo_signal_legacy(spark.createDataFrame([("expert STOP",)], "text string")).first()
    assert legacy.halo == 150
    stats = api.memory_stats(series(spark, [64, 6400]), "v", ["k"], ["seq"]).orderBy("seq").collect()
    assert [(r["mean"], r.is_drifting) for r in stats] == [(1.0, False), (101.0, False)]
    assert one(spark, api.get_stability(F.col("x"), F.lit(0).cast("long")), x=45000) == "Pressure"
