"""Toxicity on held-out rows, license scans against full alignment, token counts against a plain dynamic program."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardstream.llm import licenses, token_counts, toxicity
from wardstream.llm.common import table

# -- toxicity --------------------------------------------------------------------------------------------------------


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], "doc_id long, text string, score double, toxic string")


def test_fold():
    assert toxicity.fold("Tr4sh, TRАSH$$$ ïd1ot") == " trash  trash    ïdiot "
    assert toxicity.fold("ïd1ot é").translate(toxicity.PLAIN) == " idiot e "
    assert toxicity.fold("l0$er @ss $5 a|b!!") == " ioser ass ss aib   "
    assert toxicity.fold("") == "  "


@given(st.text())
def test_fold_keeps_length(t):
    assert len(toxicity.fold(t)) == len(t) + 2


def test_hits_against_plain_search():
    lex = toxicity.Lexicon({" bad ": 2.0, " bad": 1.0, " worse ": 3.0}, (" bad day ",), ())
    a = toxicity.automaton(lex)
    assert sorted(toxicity.hits(a, toxicity.fold("Bad badly b4d day worse."))) == [1.0, 2.0, 3.0]
    assert sorted(toxicity.hits(a, toxicity.fold("bäd bäd day"))) == [2.0]
    rnd = random.Random(1)
    for _ in range(300):
        f = toxicity.fold(" ".join(rnd.choice(["bad", "badder", "day", "worse", "x"]) for _ in range(8)))
        w = f.split()
        want = [3.0 if x == "worse" else 2.0 if x == "bad" else 1.0 for i, x in enumerate(w) if x in ("worse", "bad", "badder") and not (x == "bad" and i + 1 < len(w) and w[i + 1] == "day")]
        assert sorted(toxicity.hits(a, f)) == sorted(want)


@pytest.fixture(scope="module")
def learned(spark):
    at = "/root/testdata/sf0.1"
    docs = table(spark, at, "documents")
    return toxicity.learn(spark, docs, table(spark, at, "labels"))


def test_held_out(spark, learned):
    at = "/root/testdata/sf0.1"
    out = toxicity.toxicity(spark, table(spark, at, "documents"), learned).join(table(spark, at, "labels"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in out}
    recall = n[1, 1] / (n[1, 1] + n.get((1, 0), 0))
    wrong = n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0))
    print(n)
    assert recall > 0.8 and wrong < 0.02


def test_edges(spark, learned):
    rows = [(1, None), (2, ""), (None, "text"), (3, "word " * 40_000), (4, "idiot"), (4, "idiot")]
    out = toxicity.toxicity(spark, frame(spark, rows), learned).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert {r.score for r in out if r.doc_id == 4} != {r.score for r in out if r.doc_id == 2}
    assert toxicity.toxicity(spark, frame(spark, []), learned).collect() == []


def test_no_labels(spark):
    labels = spark.createDataFrame([(None, None)], "doc_id long, toxic int")
    lex = toxicity.learn(spark, frame(spark, [(1, "x")]), labels)
    assert [r.predicted for r in toxicity.toxicity(spark, frame(spark, [(1, "x")]), lex).collect()] == [0]


# -- licenses --------------------------------------------------------------------------------------------------------


def full_alignment(a, b):
    """Matched elements of the best local alignment of all of a with all of b."""
    best, before = (0, 0), [(0, 0)] * (len(b) + 1)
    for x in a:
        row = [(0, 0)]
        for j, y in enumerate(b):
            d = before[j]
            c = (d[0] + 2, d[1] + 1) if x == y else (d[0] - 1, d[1])
            for o in (before[j + 1], row[j]):
                if o[0] - 1 > c[0]:
                    c = (o[0] - 1, o[1])
            row.append(c if c[0] > 0 else (0, 0))
            if row[-1][0] > best[0]:
                best = row[-1]
        before = row
    return best[1]


def toks(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())


def test_alignment():
    rnd, ix = random.Random(3), licenses.index(licenses.TEMPLATES)
    for _ in range(60):
        name = rnd.choice(list(licenses.TEMPLATES))
        words = toks(licenses.TEMPLATES[name])
        w = list(words)
        for _ in range(rnd.randint(0, len(w) // 10)):
            k = rnd.randrange(len(w))
            w[k : k + rnd.randint(0, 1)] = [rnd.choice(["foo", "bar"])] * rnd.randint(0, 1)
        text = [f"x{rnd.randrange(99)}" for _ in range(rnd.randint(0, 40))] + w + ["tail"] * rnd.randint(0, 9)
        data = np.frombuffer(" ".join(text).encode(), np.uint8)
        h = licenses.tokens(data, np.array([0, len(data)]))[2]
        own = [x for x in licenses.scan(ix, h) if ix.names[x[2]] == name]
        want = full_alignment(words, text) / len(words)
        best = max((x[3] for x in own), default=0.0)
        covering = max((x[3] for x in licenses.scan(ix, h)), default=0.0)
        assert abs(best - want) < 1e-9 or (best == 0 and (want < licenses.COVERAGE + 0.1 or covering >= licenses.COVERAGE)), (name, best, want)


def test_winnowing():
    """Of every WINNOW consecutive hashes one is kept."""
    g = np.random.default_rng(2).integers(0, 50, 300).astype(np.uint64)
    at = licenses.winnowed(g)
    assert np.diff(at).max() <= licenses.WINNOW and at[0] < licenses.WINNOW and at[-1] >= len(g) - licenses.WINNOW


def test_license_rows(spark):
    mit = licenses.TEMPLATES["mit"]
    text = f"é head.\n{mit}\nand Released under the MIT  license!"
    rows = [(1, text), (2, None), (3, ""), (4, "nothing here"), (None, "Released under the MIT License."), (5, "w " * 30_000 + mit), (6, "Licensed$$$ under%%% the Apache License,### Version 2.0.")]
    out = {r.doc_id: r for r in licenses.license_scan(spark, frame(spark, rows)).collect()}
    spans = [x.split(":") for x in out[1].licenses.split(",")]
    assert [s[0] for s in spans] == ["mit", "mit-statement"] and out[1].coverage == 1.0
    assert text[int(spans[0][1]) : int(spans[0][2])].startswith("Permission") and text[int(spans[1][1]) : int(spans[1][2])] == "Released under the MIT  license"
    assert [out[i].n_licenses for i in (2, 3, 4, None, 5, 6)] == [0, 0, 0, 1, 1, 1] and out[6].best == "apache-2.0-statement"
    assert licenses.license_scan(spark, frame(spark, [])).collect() == []


def test_copies_next_to_each_other(spark):
    line = "Released under the MIT License."
    rows = [(1, f"{line}\n{line}"), (2, "\n".join([line] * 5)), (3, f"{line} All rights reserved. All rights reserved. {line}")]
    out = {r.doc_id: r.licenses.split(",") for r in licenses.license_scan(spark, frame(spark, rows)).collect()}
    assert [len(out[i]) for i in (1, 2, 3)] == [2, 5, 4]
    for i, t in rows:
        assert [t[int(a) : int(b)] for _, a, b, _ in (x.split(":") for x in out[i])] == re.findall(r"Released under the MIT License|All rights reserved", t)


def test_all_kinds_of_license_lines(spark):
    at = "/root/testdata/sf0.01"
    lines = re.compile("(?i)licensed? under|released under|all[^a-z0-9\x80-\U0010ffff]+rights[^a-z0-9\x80-\U0010ffff]+reserved")
    texts = {r.doc_id: r.text for r in table(spark, at, "documents").collect()}
    for r in licenses.op4_license_scan(spark, at).collect():
        assert (r.n_licenses > 0) == bool(lines.search(texts[r.doc_id])), r


# -- token counts ----------------------------------------------------------------------------------------------------


def plain_count(model, word):
    best, longest = [(0.0, 0)], max(map(len, model.pieces))
    text = "▁" + word
    for end in range(1, len(text) + 1):
        n = len(text[end - 1].encode())
        options = [(best[-1][0] + n * model.byte, best[-1][1] + n)]
        options += [(best[s][0] + model.pieces[text[s:end]], best[s][1] + 1) for s in range(max(0, end - longest), end) if text[s:end] in model.pieces]
        best.append(max(options, key=lambda x: (x[0], -x[1])))
    return best[-1][1]


MODEL = token_counts.zipf("▁ e t a th the ▁the ▁a he er in ing an and ▁and é b c d f g h i k l m n o p r s u".split())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("theandingé▁x好", max_size=12), max_size=12))
def test_counts(words):
    text = " ".join(words)
    counter = token_counts.Counter(MODEL)
    own = [w.decode() for w in text.encode().split()]
    assert counter([text.encode()]) == ([len(own)], [sum(plain_count(MODEL, w) for w in own)])


def test_prefixes_are_shared():
    """Within a batch and between batches."""
    counter = token_counts.Counter(MODEL)
    counter([b"the then them thenx"])
    assert counter.nodes == counter.kept == len("▁the") + len("n") + len("m") + len("x")
    counter([b"thenxx the"])
    assert counter.nodes == counter.kept == len("▁thenxx") + len("m")


def test_forgetting(monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_NODES", 2)
    counter = token_counts.Counter(MODEL)
    assert counter([b"the and thing"] * 2) == counter([b"the and thing"] * 2) and counter.kept < 20


def test_long_words(monkeypatch):
    """Prefixes beyond the depth are computed, not kept."""
    word = "theandinga" * 30
    want = plain_count(MODEL, word)
    for depth in (0, 1, 7, 64):
        monkeypatch.setattr(token_counts, "DEPTH", depth)
        counter = token_counts.Counter(MODEL)
        assert counter([word.encode()]) == ([1], [want]) and counter.kept == depth


def test_token_rows(spark):
    rows = [(1, None), (2, ""), (3, "the\x1cand\x85 the\tand"), (None, "x"), (4, "a" * 30_000), (4, "a b"), (4, "a b")]
    out = token_counts.token_counts(spark, frame(spark, rows), MODEL).collect()
    want = [(i, len((t or "").encode().split()), sum(plain_count(MODEL, w.decode()) for w in (t or "").encode().split())) for i, t in rows]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(spark, frame(spark, []), MODEL).collect() == []


def test_token_table(spark):
    model = token_counts.public_model()
    texts = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    known = {}
    for r in token_counts.op8_token_counts(spark, "/root/testdata/sf0.001").collect():
        own = [w.decode() for w in texts[r.doc_id].encode().split()]
        for w in own:
            if w not in known:
                known[w] = plain_count(model, w)
        assert (r.n_words, r.n_tokens) == (len(own), sum(known[w] for w in own))


# -- learning and assignment by brute force ------------------------------------------------------------------------------


def plain_lexicon(docs, labels):
    """Weights and learned exceptions, term by term over all labelled texts."""
    toxic = {}
    for i, t in labels:
        if i is not None and t is not None and zlib.crc32(str(i).encode()) % 5:
            toxic[i] = max(t, toxic.get(i, 0))
    around, near = {}, {}
    texts = [(i, toxic[i], toxicity.fold(t or "").split()) for i, t in docs if i in toxic]
    for _, y, w in texts:
        for k, x in enumerate(w):
            at = zlib.crc32(f"{w[k - 1] if k else ''}\0{x}\0{w[k + 1] if k + 1 < len(w) else ''}".encode())
            for t in [f" {x} ", *(f" {x[:n]}" for n in toxicity.STEMS if n < len(x))]:
                around.setdefault(t, (set(), set()))[y].add(at)
    n = [max(1, sum(y == k for y in toxic.values())) for k in (0, 1)]
    weights = {}
    for t, (clean, bad) in around.items():
        odds = round(math.log((len(bad) + 0.5) / (n[1] + 1)) - math.log((len(clean) + 0.5) / (n[0] + 1)), 9)
        if len(bad) >= toxicity.LEAST_SURROUNDINGS and odds > 2 * math.sqrt(1 / (len(bad) + 0.5) + 1 / (len(clean) + 0.5)) and odds > math.log(toxicity.LEAST_ODDS) and len(clean) <= len(bad):
            weights[t] = odds
    best = dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[: toxicity.MOST_TERMS])
    weights = {}
    for t, w in best.items():
        if not any(best.get(t[: k + 1], -9.0) >= w for k in toxicity.STEMS if k + 1 < len(t)):
            weights[t] = w
    for i, y, w in texts:
        for k, x in enumerate(w):
            if any(t in weights for t in [f" {x} ", *(f" {x[:n]}" for n in toxicity.STEMS if n < len(x))]):
                for p in ([f" {w[k - 1]} {x} "] if k else []) + ([f" {x} {w[k + 1]} "] if k + 1 < len(w) else []):
                    near.setdefault(p, (set(), set()))[y].add(i)
    return weights, {p for p, (clean, bad) in near.items() if not bad and len(clean) >= 5}


def test_learning_by_brute_force(spark, monkeypatch):
    at = "/root/testdata/sf0.01"
    docs, labels = table(spark, at, "documents"), table(spark, at, "labels")
    want, exceptions = plain_lexicon([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.toxic) for r in labels.collect()])
    lexicon = toxicity.learn(spark, docs, labels)
    assert lexicon.weights == want and want
    assert set(lexicon.exceptions) == exceptions | {toxicity.fold(e) for e in toxicity.EXCEPTIONS}
    # Forgetting surroundings only repeats rows.
    rows = pa.record_batch([pa.array(["a b c a b c a b c", "a b c"]), pa.array([1, 0], pa.int32())], ["text", "toxic"])
    whole = [sorted(zip(*b.to_pydict().values(), strict=True)) for b in toxicity.occurrences(None)([rows])]
    monkeypatch.setattr(toxicity, "SEEN", 2)
    again = [sorted(zip(*b.to_pydict().values(), strict=True)) for b in toxicity.occurrences(None)([rows])]
    assert [sorted(set(x)) for x in again] == whole and len(again[0]) > len(whole[0])
