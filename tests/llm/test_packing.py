"""Packing: ids against the full tokenizer, every id in one piece, gapless sequences, little padding."""

import json
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wardstream.llm import packing
from wardstream.llm.common import table

FULL = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
FAST = packing.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*FULL.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, out):
    """rows: doc_id and text, ids unique or equal in text.  Returns the share of padding."""
    want = {i: ids_of(t) for i, t in rows}
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(want)
    for i, own in pieces.items():
        copies = sum(j == i for j, _ in rows)
        at = {}
        for r in own:
            part = want[i][r.start : r.start + r.length]
            assert r.length == len(part) > 0 and r.doc_tokens == len(want[i])
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            for k in range(r.start, r.start + r.length):
                at[k] = at.get(k, 0) + 1
        assert at == dict.fromkeys(range(len(want[i])), copies)
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= packing.LENGTH
        padding += 0 if at & (at - 1) == 0 else packing.LENGTH - at
    return padding / max(1, padding + sum(len(want[i]) for i, _ in rows))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, length int, offset string")


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "word " * 9000), (5, "<|endoftext|>"), (8, "a <|endoftext|><|endoftext|> b<|endoftext|>c"), (9, "<|endoftexts|>"), (10, "x<|endoftext|>" * 3000), (6, "é\n\n  x"), (7, "dup of it"), (7, "dup of it"), (None, "no id")]
    check(rows, packing.pack(spark, frame(spark, rows)).collect())
    assert packing.pack(spark, frame(spark, [])).collect() == []


def test_one_length_needs_cuts(spark):
    """Tails of one length, over half a sequence: without cuts nearly half would be padding."""
    rows = [(i, "the " * 1200) for i in range(400)]
    assert check(rows, packing.pack(spark, frame(spark, rows)).collect()) < 0.06


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    assert check(rows, packing.op6_packing(spark, "/root/testdata/sf0.01").collect()) < 0.01


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200) | st.text("ab 1\n'.é​İſ", max_size=200) | st.lists(st.sampled_from(["<|endoftext|>", "<|endoftexts|>", "<|endof", "text|>", " ", "a", "\n", "é", "<|"]), max_size=20).map("".join))
def test_ids(text):
    assert FAST(text).tolist() == ids_of(text)


def test_ids_of_special_strings(tmp_path):
    assert FAST("hello <|endoftext|> world").tolist() == [31373, 220, 50256, 995, 1]
    # What the faster library can't do as a description says goes to the description.
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        other = json.load(f)
    other["added_tokens"] = [other["added_tokens"][0] | {"lstrip": True}]
    (tmp_path / "other.json").write_text(json.dumps(other))
    t, full = packing.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    for text in ("a <|endoftext|> b", "plain"):
        assert t(text).tolist() == [*full.encode(text, add_special_tokens=False).ids, 1]


@given(st.binary(max_size=300), st.binary(min_size=1, max_size=300))
def test_crc_of_rest(a, b):
    assert packing.crc_of_rest(zlib.crc32(a + b), zlib.crc32(a), len(b)) == zlib.crc32(b)


def brute_best(y):
    f = [0.0] * (packing.UNITS + 1)
    for c in range(1, packing.UNITS + 1):
        f[c] = max([f[c - 1], *(f[c - k] + y[k] for k in range(1, c + 1))])
    return f[-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_knapsack(seed):
    y = np.r_[0.0, np.random.default_rng(seed).random(packing.UNITS) ** 3]
    value, pattern = packing.knapsack(y)
    assert abs(value - brute_best(y)) < 1e-9 and abs(pattern @ y - value) < 1e-9
    assert pattern @ np.arange(packing.UNITS + 1) <= packing.UNITS


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plan(seed):
    """Every rank of every class has exactly one slot, and the sequences are close to the least number."""
    rnd = random.Random(seed)
    histogram = {c: rnd.choice([0, 1, 7, 300, 4000]) for c in range(packing.UNITS + 1)} if seed < 3 else {150: 10_000, 256: 3}
    plan = packing.solve(histogram)
    pieces = {c: n for c, n in histogram.items() if c and n}
    for of, low, first, rank_first, rank_rest in plan.cuts.tolist():
        nxt = min([r for o, r, *_ in plan.cuts.tolist() if o == of and r > low], default=int(plan.uncut_from[of]))
        pieces[first] = max(pieces.get(first, 0), rank_first + nxt - low)
        pieces[of - first] = max(pieces.get(of - first, 0), rank_rest + nxt - low)
    load = {}
    for c, n in pieces.items():
        for r in range(int(plan.uncut_from[c]), n):
            s = plan.slots[np.searchsorted(plan.slots[:, 0], c << 40 | r, "right") - 1]
            assert s[0] >> 40 == c
            load.setdefault(int(s[1] + (r - (s[0] & (1 << 40) - 1)) // s[2]), []).append(c)
    assert max(load) + 1 == plan.sequences == len(load)
    assert all(sum(v) <= packing.UNITS for v in load.values())
    units = sum(c * n for c, n in histogram.items())
    assert plan.sequences <= units / packing.UNITS * 1.01 + 60
