"""Shards and mixes of small tables, by their laws and against plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

from wardstream.llm import mixing, sharding
from wardstream.llm.common import table

SCHEMA = "doc_id long, text string, source string, size string, shard int, n_chars long, `a.b` int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 0, len(t or ""), 1) for i, t, s in rows], SCHEMA)


def rows_of(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        t = "same text of many" if rnd.random() < 0.35 else " ".join(rnd.choice("aé b cc\ndd ee\tff".split(" ")) for _ in range(rnd.choice([0, 1, 5, 50, 400])))
        out.append((i, t, rnd.choice(["s1", "s2", "s2", "s2", "é", None, "S"])))
    return out


def check_shards(rows, out, n):
    total = sum(r.size for r in out)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    assert len(out) == len(rows) and all(0 <= s < n for s in by)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r.size for r in by.get(s, [])) for s in range(n)]
    most = max((r.size for r in out), default=0)
    assert all(abs(n * s - total) <= n * most for s in sizes)
    want = sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows if i is not None)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out if r.doc_id is not None) == want
    order = [r.key for s in range(n) for r in sorted(by.get(s, []), key=lambda r: r.slot)]
    assert order == sorted(order)


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_BYTES", 64)
    monkeypatch.setattr(sharding, "SAMPLES", 3)
    rows = rows_of(1, 400)
    check_shards(rows, sharding.shards(spark, docs(spark, rows), 7).collect(), 7)


def test_shards_edges(spark):
    rows = [(1, None, None), (2, "", None), (None, "x", "s"), (3, "y" * 50_000, "s"), (4, "x", "s"), (4, "x", "s"), (4, "z", "s")]
    check_shards(rows, sharding.shards(spark, docs(spark, rows), 3).collect(), 3)
    assert sharding.shards(spark, docs(spark, []), 3).collect() == []


def test_shards_rerun(spark):
    a, b = (sorted(map(tuple, sharding.op9_sharding(spark, "/root/testdata/sf0.001").collect())) for _ in range(2))
    assert a == b and len({r[4] for r in a}) == 40


def plain_mix(rows):
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()) for i, t, s in rows]
    sources = sorted({s for _, s, _, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(x[2] for x in sized if x[1] == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    left, free, target = Fraction(sum(size.values())), set(sources), {}
    while free:
        each = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if each[s] > 3 * size[s]}
        for s in over or free:
            target[s] = Fraction(3 * size[s]) if over else each[s]
        left -= sum(target[s] for s in over)
        free -= over or free
    out = []
    for s in sources:
        due, before = int(target[s]), 0
        for i, _, n, _ in sorted((x for x in sized if x[1] == s), key=lambda x: (x[3], x[2])):
            full = due // size[s] if size[s] else 0
            out.append((i, n, size[s], float(target[s]), full * n + max(0, min(n, due - full * size[s] - before))))
            before += n
    return sorted(out, key=str)


def got_mix(spark, rows):
    out = mixing.mix(docs(spark, rows)).select("doc_id", "size", "source_size", "target", "taken").collect()
    return sorted((tuple(r) for r in out), key=str)


def test_mix(spark):
    for seed in (1, 2):
        rows = rows_of(seed, 150) + [(900, "only a few words", "zz"), (901, "x", "tiny")]
        got, want = got_mix(spark, rows), plain_mix(rows)
        assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
        assert all(abs(g[3] - w[3]) < 1e-6 * max(1, w[3]) for g, w in zip(got, want, strict=True))
        assert all(g[4] <= 3 * g[1] for g in got)


def test_mix_edges(spark):
    rows = [(1, None, None), (2, "", "a"), (None, "b c", "b"), (3, "d e f", "b"), (3, "d e f", "b"), (5, "w " * 20_000, "c")]
    got, want = got_mix(spark, rows), plain_mix(rows)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert got_mix(spark, []) == [] and [r[4] for r in got_mix(spark, [(1, None, "a"), (2, " ", None)])] == [0, 0]


def test_mixed_documents(spark):
    rows = rows_of(3, 120)
    df = docs(spark, rows)
    out = mixing.mixed_documents(spark, df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.n_chars == len(r.text or "")
    assert words == {r[0]: r[4] for r in plain_mix(rows) if r[4]}


def test_curriculum():
    """A time's share of the target inverts to that time."""
    from math import isclose, sqrt

    for a in (-0.25, 0.0, 0.25):
        for t in (0.0, 0.1, 0.5, 0.9, 1.0):
            u = (1 - a) * t + a * t * t
            assert isclose(2 * u / ((1 - a) + sqrt((1 - a) ** 2 + 4 * a * u)), t, abs_tol=1e-12)


def test_table(spark):
    rows = [(r.doc_id, r.text, r.source) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    got, want = got_mix(spark, rows), plain_mix(rows)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]


def test_assignment_by_brute_force(spark, monkeypatch):
    """Shard and slot of every row from all rows in order, however the ranges are cut."""
    rows = rows_of(7, 300) + [(None, "same text of many", "x")] * 4 + [(5, "same text of many", "x")] * 3
    for grain, samples in ((1, 1), (64, 3), (8 << 20, 16)):
        monkeypatch.setattr(sharding, "RANGE_BYTES", grain)
        monkeypatch.setattr(sharding, "SAMPLES", samples)
        out = sharding.shards(spark, docs(spark, rows), 6).collect()
        total, before, shard, slot, want = sum(r.size for r in out), 0, -1, 0, []
        for k, i, size in sorted(((r.key, r.doc_id, r.size) for r in out), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
            own = min(5, (2 * before + size) * 6 // (2 * total))
            slot, shard = (slot + 1 if own == shard else 0), own
            want.append((k, i, size, shard, slot))
            before += size
        assert sorted((r.key, r.doc_id, r.size, r.shard, r.slot) for r in out if r.doc_id is not None) == sorted(w for w in want if w[1] is not None)
        assert sorted(r.slot for r in out if r.doc_id is None) == sorted(w[4] for w in want if w[1] is None)
