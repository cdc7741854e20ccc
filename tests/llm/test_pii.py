"""Base spans against the patterns as written, the network's gradient, held-out accuracy and reconciliation."""

import hashlib
import random
import re

import numpy as np

from wardstream.llm import pii
from wardstream.llm.common import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            odd = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and odd % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def messy(rnd):
    parts = ["a@b.c", "x.y@mail-1.example.com", "_d@e.f", "@", ".", "-", " ", "  ", "1.2.3.4", "256.1.1.1", "001.2.3.04", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (017) 555-7713", "+123", "+", "(", ")", "7", "12", "é", "\n", "word", "%", "+44 20 7946 0958"]
    return "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))


def test_base_spans():
    rnd = random.Random(5)
    for _ in range(4000):
        t = messy(rnd)
        assert pii.base_spans(t) == plain(t), t


def test_long_texts_take_linear_time():
    for t in ("1" * 100_000, "a" * 100_000 + "@", "a@" * 30_000, "1." * 40_000, "+1" * 40_000, "1 " * 50_000):
        pii.base_spans(t)
        assert len(pii.window_starts(pii.triggers(t))) <= len(t) / pii.STEP + 2


def test_windows_see_triggers():
    rnd = random.Random(6)
    for _ in range(200):
        t = "".join(rnd.choice("ab cd1" if rnd.random() < 0.02 else "ab cd") for _ in range(rnd.randint(0, 900)))
        starts = pii.window_starts(pii.triggers(t))
        assert starts == sorted(set(starts))
        for m in re.finditer("[0-9]", t):
            assert sum(s <= m.start() < s + pii.WINDOW for s in starts) == min(2, 1 + m.start() // pii.STEP)


def test_triggers_as_one_expression():
    """Words first, expressions where these call for them: the same places as one expression of all finds."""
    number, at, dot = ("(?:" + "|".join(sorted(x, key=len, reverse=True)) + ")" for x in (pii.NUMBERS, pii.AT_WORDS, pii.DOT_WORDS))
    whole = re.compile(rf"\d|[@＠]|[\[({{<]\s?{at}\s?[\])}}>]|(?<=\s){at}(?=\s)|\b{number}\b(?=[\s,.()\-–]{{1,3}}(?:\W?{dot}\W{{1,2}})?(?:{number}\b|\d))", re.I)
    rnd = random.Random(7)
    pool = [*pii.NUMBERS, *pii.AT_WORDS, *pii.DOT_WORDS, "ONE", "Two", "\u017feven", "ſix", "at", "AT", "[at]", "( at )", "x", "word", "7", "٣", "a@b", "＠", "stone", "fünfzig", "_one", "one_"]
    for _ in range(3000):
        t = "".join(rnd.choice(pool) + rnd.choice([" ", " ", ", ", ". ", "-", "\n", " (", ") ", "  ,", "", "'"]) for _ in range(rnd.randint(0, 12)))
        want = {i for i in range(len(t)) if whole.match(t, i)}
        assert set(pii.triggers(t)) == want, t


def test_gradient(monkeypatch):
    p = pii.initial(3)
    xs, ys = pii.labelled(random.Random(2), 3)
    _, slopes = pii.loss_and_slopes(p, xs, ys)
    g = np.random.default_rng(0)
    for name in ("embedding", "wx_f", "wh_f", "b_f", "wx_b", "wh_b", "out", "out_b", "trans"):
        used = np.argwhere(np.abs(slopes[name]) > 1e-5)
        for at in used[g.permutation(len(used))[:3]]:
            at, eps, both = tuple(at), 1e-5, []
            for sign in (1, -1):
                q = {k: v.copy() for k, v in p.items()}
                q[name][at] += sign * eps
                both.append(pii.loss_and_slopes(q, xs, ys)[0])
            assert abs((both[0] - both[1]) / (2 * eps) - slopes[name][at]) < 1e-4 * max(1, abs(slopes[name][at]))


def test_decoding_is_the_best_path():
    """Viterbi against all paths, on short windows."""
    from itertools import product

    p = pii.trained(steps=3)
    xs = np.random.default_rng(1).integers(0, pii.N_SYMBOLS, (4, 4))
    e, _ = pii.emissions(p, xs)
    path, _ = pii.decoded(p, xs)
    for i in range(len(xs)):
        def value(tags, i=i):
            if not pii.FIRST[tags[0]] or not all(pii.ALLOWED[a, b] for a, b in zip(tags, tags[1:], strict=False)):
                return -np.inf
            return sum(e[i, k, t] for k, t in enumerate(tags)) + sum(p["trans"][a, b] for a, b in zip(tags, tags[1:], strict=False))

        assert np.isclose(value(path[i]), max(value(t) for t in product(range(pii.TAGS), repeat=4)), atol=1e-4)


def test_held_out_accuracy():
    xs, ys = pii.labelled(random.Random(999), 300)
    path, _ = pii.decoded(pii.trained(), xs)
    inside = ys > 0
    assert (path[inside] == ys[inside]).mean() > 0.8 and (path[~inside] == 0).mean() > 0.97


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, len(t or "")) for i, t in rows], "doc_id long, text string, spans string, n_ip int, n_chars long")


def test_operator(spark):
    rnd = random.Random(8)
    rows = [(i, messy(rnd) + " ü " + messy(rnd)) for i in range(60)] + [(100, None), (101, ""), (None, "a@b.c"), (102, "w " * 30_000 + "a@b.c"), (103, "dup +1 (017) 555-7713"), (103, "dup +1 (017) 555-7713")]
    out = pii.personal_data(spark, frame(spark, rows)).collect()
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out), key=str)
    assert got == sorted(((i, *(sum(s[1] == k for s in plain(t)) for k in range(4)), hashlib.sha256(pii.written(plain(t)).encode()).hexdigest()) for i, t in rows), key=str)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, r)
    for i, t in rows:
        all_spans = by[i].spans.split(",") if by[i].spans else []
        assert set(pii.written(plain(t)).split(",")) - {""} <= set(all_spans)
        assert all_spans == sorted(all_spans, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])))
    assert pii.personal_data(spark, frame(spark, [])).collect() == []


def test_added_spans():
    """Forms that no pattern knows, and things that only look alike."""
    p = pii.trained()
    yes = ["thand on (555) 123-4567 ered the", "eres nd 555-123-4567 of erre", "and the 4929 3481 4638 5307 thand"]
    no = ['erand "a2b28a999f3c97d1e2e9f1a8f0b12c" and', "thin 1999 ered the 12 of", "of the and erre 3.5 onth", "thand @name erre"]
    found = [bool(spans) for _, spans in pii.spans_of(p, yes)]
    assert sum(found) >= 2, found
    for t in no:
        (_, spans), = pii.spans_of(p, [t])
        assert not spans, (t, spans)


def every_window(text):
    return list(range(0, len(text), pii.STEP))


def test_length_and_offset_do_not_decide():
    """Spaced addresses that the patterns miss, longer than a window too, at every offset."""
    p, prose = pii.trained(), "thin ered the and of erre onth nder hant stoue " * 8
    for n in (40, 50, 63, 80):
        own = ("anther.onthen.ererat.hantin.tiones.erthan.statio.andere"[: n - 23] + "n @ ereder.example . com")[-n:]
        texts = [f"{prose[: 100 + at]} {own} {prose}" for at in range(pii.STEP)]
        found = [any(k == 0 and s <= 102 + at and e >= 100 + at + len(own) for s, k, e in spans) for at, (_, spans) in enumerate(pii.spans_of(p, texts))]
        assert sum(found) >= 30, (n, sum(found))


def test_one_path_of_all_windows():
    """Windows round triggers give the spans that decoding every window gives; ranges of windows tile a text."""
    p, rnd = pii.trained(), random.Random(12)
    texts = [messy(rnd) + " and of the erre " * rnd.randint(0, 12) + messy(rnd) for _ in range(150)] + ["1 " * 400, "a." * 90 + " @ " + "bc." * 60 + " com"]
    assert list(pii.spans_of(p, texts)) == list(pii.spans_of(p, texts, every=every_window))
    for n in range(1, 200):
        ranges = [pii.owned(s, n) for s in range(0, n, pii.STEP)]
        assert [c for lo, hi in ranges for c in range(lo, hi)] == list(range(n))


def test_spelled_out_and_other_scripts():
    """Forms without an ASCII digit or an @, at every offset; with the trigger as many as when every window is decoded."""
    p, prose = pii.trained(), "thin ered the and of erre onth nder hant stoue " * 6
    forms = ["anre.hant [at] postin [dot] org", "anre.hant at postin dot org", "hanted (at) webon (dot) com", "（５５５） １２３-４５６７", "(٥٥٥) ١٢٣-٤٥٦٧", "five five five one two three four five six seven", "one nine two dot one six eight dot one dot two"]
    for form in forms:
        texts = [f"{prose[: 100 + at]} {form} {prose}" for at in range(pii.STEP)]
        gated = [spans for _, spans in pii.spans_of(p, texts)]
        assert gated == [spans for _, spans in pii.spans_of(p, texts, every=every_window)]
        found = [any(s <= 104 + at and e >= 98 + at + len(form) for s, _, e in spans) for at, spans in enumerate(gated)]
        assert sum(found) >= 20, (form, sum(found))
    no = ["they met at home. Then one of them sat", "two or three at the door, at nine. Point taken", "at last. Four or five of us at work"]
    assert not any(spans for _, spans in pii.spans_of(p, no))


def test_reconciliation():
    base = [(10, 0, 20), (15, 1, 30)]
    found = [(-3.0, 29, 3, 40), (-2.0, 31, 2, 45), (-1.0, 44, 3, 50), (-0.5, 45, 3, 50)]
    assert pii.reconciled(base, found) == [(10, 0, 20), (15, 1, 30), (31, 2, 45), (45, 3, 50)]


def test_reconciliation_by_brute_force():
    """Candidates against all spans chosen before, however long and many these are."""
    assert pii.reconciled([(0, 0, 100), *((10 * i, 1, 10 * i + 5) for i in range(1, 6))], [(-9.0, 60, 3, 70)]) == sorted([(0, 0, 100), *((10 * i, 1, 10 * i + 5) for i in range(1, 6))])
    rnd = random.Random(8)
    for _ in range(500):
        def span():
            s = rnd.randrange(60)
            return s, rnd.randrange(4), s + rnd.randint(1, rnd.choice([3, 30]))

        base, found = sorted({span() for _ in range(rnd.randint(0, 8))}), sorted((-rnd.random(), *span()) for _ in range(rnd.randint(0, 12)))
        want = list(base)
        for _, s, k, e in found:
            if not any(a < e and s < b for a, _, b in want):
                want.append((s, k, e))
        assert pii.reconciled(base, found) == sorted(want)


def test_masked(spark):
    assert pii.masked("call a@b.c or 1.2.3.4 now", [(5, 0, 10), (14, 1, 21)]) == "call [EMAIL] or [IP] now"
    assert pii.masked("abcdefgh", [(1, 0, 4), (2, 1, 6)]) == "a[EMAIL]gh"
    df = frame(spark, [(1, "mail a@b.c"), (2, None), (3, "clean é")])
    out = pii.masked_documents(spark, df)
    assert out.dtypes == df.dtypes
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("mail [EMAIL]", 12), 2: (None, 0), 3: ("clean é", 7)}


def test_table(spark):
    rows = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    for r in pii.op2_personal_data(spark, "/root/testdata/sf0.001").collect():
        assert r.base_sha256 == hashlib.sha256(pii.written(plain(rows[r.doc_id])).encode()).hexdigest()


def test_masked_with_any_columns(spark):
    df = spark.createDataFrame([(1, "call +1 (017) 555-7713 now", 1, 5), (2, None, 2, None), (2, None, 2, None)], "doc_id long, text string, c0 int, n_chars long").withColumnRenamed("c0", "a`b.c")
    out = pii.masked_documents(spark, df)
    assert out.dtypes == df.dtypes and sorted((r[0], r[1], r[3]) for r in out.collect() if r[1]) == [(1, "call [PHONE] now", 16)] and out.count() == 3
    assert pii.masked_documents(spark, df.limit(0)).collect() == []
