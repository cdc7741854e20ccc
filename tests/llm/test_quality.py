"""The ledger against plain Python."""

import random
import re
from collections import Counter

from wardstream.llm import quality
from wardstream.llm.common import table


def plain(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for k in range(8)}
    m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines), "n_upper": len(re.findall("[A-Z]", t)), "n_marks": t.count("!")}
    failed = sum(1 << i for i, (_, rule) in enumerate(quality.RULES) if all(eval(p, {}, m) for p in rule.split(" AND ")))
    return (*m.values(), failed)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, failed string")


def texts():
    rnd = random.Random(4)
    out = [None, "", " \n\t ", "a", "a\nb\na\n\na\r\n \na", "é " * 30, "A" * 50_000, "x y " * 5_000, "\x1c\x85 z", "end\n", "\nstart"]
    for _ in range(80):
        v = [f"w{i}" for i in range(rnd.choice([2, 5, 40]))] + ["WORD!!", "ño", "#$", "|"]
        out.append("".join(rnd.choice(v) + rnd.choice([" ", " ", "\n", "  ", "\t", "\r\n"]) for _ in range(rnd.choice([3, 9, 20, 60, 200]))))
    return out


def test_ledger(spark):
    rows = list(enumerate(texts())) + [(None, "null id"), (3, "a"), (3, "a")]
    got = sorted((tuple(r) for r in quality.ledger(spark, frame(spark, rows)).collect()), key=str)
    assert got == sorted(((i, *plain(t)) for i, t in rows), key=str)
    assert quality.ledger(spark, frame(spark, [])).collect() == []


def test_chunks(spark, monkeypatch):
    """Words, lines and windows of one row never reach into the next."""
    import numpy as np

    own = texts()
    data = [(t or "").encode() for t in own]
    offsets = np.cumsum([0, *map(len, data)])
    m = quality.measured(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert [tuple(int(m[k][i]) for k in quality.MEASURES) for i in range(len(own))] == [plain(t)[:-1] for t in own]


def test_policies(spark):
    rows = list(enumerate(texts()))
    led = quality.ledger(spark, frame(spark, rows)).cache()
    for policy in quality.POLICIES:
        failed = {i: plain(t)[-1] & quality.mask(policy) for i, t in rows}
        assert {r.doc_id for r in led.where(quality.kept(led.failed, policy)).collect()} == {i for i, f in failed.items() if not f}
        got = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(led, policy).collect()}
        assert got == {r: (sum(bool(f & quality.bit(r)) for f in failed.values()), sum(f == quality.bit(r) for f in failed.values())) for r in quality.POLICIES[policy]}
    df = frame(spark, rows)
    kept = quality.kept_documents(spark, df)
    assert kept.dtypes == df.dtypes
    assert {r.doc_id for r in kept.collect()} == {i for i, t in rows if not plain(t)[-1]}


def test_kept_documents_with_any_columns(spark):
    rows = [(1, "w " * 5, 1, 2), (2, " ".join(f"word{i}" for i in range(40)), 3, 4), (None, None, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, `a``b.c` long").withColumnRenamed("n_words", "c0")
    out = quality.kept_documents(spark, df)
    assert out.dtypes == df.dtypes and [r.doc_id for r in out.collect()] == [2]
    assert quality.kept_documents(spark, df.limit(0)).collect() == []


def test_labels(spark):
    """Hardly a clean document is rejected, and nearly all bad ones are."""
    at = "/root/testdata/sf0.01"
    out = quality.op5_quality_rules(spark, at).join(table(spark, at, "labels"), "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in out}
    assert n[1, True] >= 0.99 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.85 * (n[0, False] + n.get((0, True), 0))
