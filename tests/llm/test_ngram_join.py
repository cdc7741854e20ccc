"""The join against a comparison of all pairs on small tables."""

import random
import re

import numpy as np
import pyarrow as pa
from wardstream.llm import ngram_join
from wardstream.llm.common import table


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and find(i) != find(j):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min([x for x in (least.get(find(i)), d) if x is not None], default=None)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, extra=False):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, node int, component_id string")
    out = ngram_join.jaccard_join(spark, df if extra else df.select("doc_id", "text"))
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)


def corpus(seed, n=120):
    rnd, rows, texts = random.Random(seed), [], []
    vocab = [f"w{i}" for i in range(60)]
    common = [rnd.choice(vocab) for _ in range(30)]
    for i in range(n):
        kind = rnd.random()
        if texts and kind < 0.55:
            w = rnd.choice(texts).split()
            for _ in range(rnd.randint(0, 2)):
                if w:
                    k = rnd.randrange(len(w))
                    w[k : k + rnd.randint(0, 1)] = [rnd.choice(vocab)]
        else:
            w = [rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 3, 5, 6, 8, 10, 12, 15, 20, 30, 40, 80]))]
            if kind > 0.8:
                w = w[:4] + common + w[4:8]
        t = " ".join(x.upper() if rnd.random() < 0.1 else x for x in w)
        texts.append(t)
        rows.append((i, t))
    rnd.shuffle(rows)
    return rows


def test_random(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


def test_hot_lists_by_rows(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 2)
    rows = corpus(3)
    assert run(spark, rows) == brute(rows)


def test_edge_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(5, None), (3, ""), (4, " \t\n"), (7, "One two"), (8, "one  TWO"), (9, "one two three"), (2, long), (1, long + " y"), (1, long + " y"), (None, "one two"), (None, "alone here"), (11, "a b c d e f"), (12, "a b c d e f")]
    assert run(spark, rows, extra=True) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_sizes():
    for s in range(1, 40):
        for t in range(s, 60):
            n = ngram_join.needed(s, t)
            ok = n <= s
            assert ok == any(100 * o >= 75 * (s + t - o) for o in range(s + 1))
            if ok:
                assert 100 * n >= 75 * (s + t - n) and 100 * (n - 1) < 75 * (s + t - n + 1)
                assert ngram_join.least_partner(t) <= s and s - n < ngram_join.prefix(s) and t - n < ngram_join.prefix(t)


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    assert run(spark, rows) == brute(rows)


def near_copies(seed, n):
    """One large group: copies of a text with a few to many words replaced, so that some link with most, some with few."""
    rnd = random.Random(seed)
    base, rows = [f"b{rnd.randrange(500)}" for _ in range(60)], []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            w[rnd.randrange(len(w))] = rnd.choice(["q", "r", f"u{i}"])
        if rnd.random() < 0.2:
            w = w[: rnd.randint(40, 59)]
        rows.append((i, " ".join(w)))
    return rows


def passages(seed, n):
    """Texts that share a passage, of which some are near copies of each other, and some of the passage alone."""
    rnd = random.Random(seed)
    passage, rows = [f"p{k}" for k in range(30)], []
    for i in range(n):
        if rows and rnd.random() < 0.3:
            w = rnd.choice(rows)[1].split()
            w[rnd.randrange(len(w))] = f"n{i}"
        else:
            w = [f"o{i}x{k}" for k in range(rnd.choice([0, 2, 5, 8, 10, 12, 40]))] + passage + [rnd.choice(["s", "t"]) for _ in range(rnd.randint(0, 6))]
        rows.append((i, " ".join(w)))
    return rows


def test_by_differences(spark, monkeypatch):
    """Few rounds or none: what the lists hold is left to the last step, whatever their length."""
    for short, rounds, rows, least in ((2, 0, near_copies(20, 150), 3), (2, 0, passages(2, 120), 10), (2, 1, corpus(6, 150), 3), (16, 0, near_copies(160, 150), 3)):
        with monkeypatch.context() as m:
            m.setattr(ngram_join, "SHORT", short)
            m.setattr(ngram_join, "ROUNDS", rounds)
            want = brute(rows)
            assert least < len({r[2] for r in want})
            assert run(spark, rows) == want


def test_entries_of_use():
    """The bound by reach against the places and sizes of all pairs."""
    rnd = np.random.default_rng(1)
    for n in (1, 2, 3, 16, 17, 60):
        for _ in range(30):
            size = rnd.integers(1, 60, n)
            pos = (rnd.random(n) * np.array([ngram_join.prefix(int(s)) for s in size])).astype(int)
            want = [any(j != i and min(size[i] - pos[i], size[j] - pos[j]) >= ngram_join.needed(size[i], size[j]) for j in range(n)) for i in range(n)]
            assert ngram_join.of_use(size, pos, np.array([0]), np.array([n])).tolist() == want


def test_parities():
    """A bound: no pair that links is ruled out; most others are."""
    rng = np.random.default_rng(3)
    out = {True: 0, False: 0}
    for _ in range(300):
        s = int(rng.integers(1, 400))
        x = rng.integers(0, 2**63, s).astype(np.uint64)
        y = np.unique(np.r_[x[: int(s * rng.uniform(0.5, 1))], rng.integers(0, 2**63, int(s * rng.uniform(0, 0.5))).astype(np.uint64)])
        if not len(y):
            continue
        both = len(np.intersect1d(x, y))
        links = 100 * both >= 75 * (len(x) + len(y) - both)
        t = pa.record_batch([pa.array([1]), pa.array([2]), pa.array([ngram_join.parities(x)]), pa.array([ngram_join.parities(y)])], ["a", "b", "sa", "sb"])
        kept = sum(len(b) for b in ngram_join.possible([t]))
        assert kept or not links
        out[links] += kept == 0
    assert out[False] > 100


def test_lexical_clash(spark):
    """Own columns named as the operator's, of any kind."""
    text = " ".join(f"a{i}" for i in range(30))
    names = ["node", "_node", "key", "KNOWN", "doc", "kept", "kept_id", "is_known", "label", "root", "least_doc", "own__node", "kept__id", "a`b.c"]
    rows = [(i, t, *range(len(names))) for i, t in ((1, text), (2, text + " x"), (3, "other words here"), (3, None))]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    out = ngram_join.one_of_each(spark, df)
    assert out.columns == df.columns and sorted((r[0], r[1]) for r in out.collect() if r[1]) == [(1, text), (3, "other words here")] and out.count() == 3
    assert run(spark, [(r[0], r[1]) for r in rows]) == brute([(r[0], r[1]) for r in rows])
