"""The pipeline against its stages in plain Python."""

import re
import zlib

import corpus_pipeline
import numpy as np
from test_ngram_join import brute
from test_packing import ids_of
from test_quality import plain as measures
from test_sharding_mixing import plain_mix
from wardstream.llm import pii
from wardstream.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows):
    """(doc_id, text) of what the last stage packs, from documents (doc_id, text, source)."""
    rows = [r for r in rows if not measures(r[1])[-1]]
    first = {}
    for (i, _, least) in brute([(i, t) for i, t, _ in rows]):
        first[i] = least
    rows = [r for r in rows if first[r[0]] == r[0]]
    p, out = pii.trained(), []
    for i, t, s in rows:
        (_, spans), = pii.spans_of(p, [t])
        out.append((i, pii.masked(t, spans), s))
    taken = {r[0]: (r[1], r[4]) for r in plain_mix(out)}
    packed = []
    for i, t, _ in out:
        size, n = taken[i]
        packed += [(i, t)] * (n // size)
        if n % size:
            packed.append((i, " ".join(WORD.findall(t)[: n % size])))
    return packed


def test_stages(spark):
    at = "/root/testdata/sf0.001"
    docs = table(spark, at, "documents")
    columns, kinds = docs.columns, docs.dtypes
    want = expected([(r.doc_id, r.text, r.source) for r in docs.collect()])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == columns and docs.dtypes == kinds
    got = sorted((r.doc_id, r.text) for r in docs.collect())
    assert got == sorted(want)


def test_run(spark):
    at = "/root/testdata/sf0.001"
    want = expected([(r.doc_id, r.text, r.source) for r in table(spark, at, "documents").collect()])
    out = corpus_pipeline.run(spark, at).collect()
    for k in {i for i, _ in want}:  # a document's passes are packed one by one
        own = [r for r in out if r.doc_id == k]
        lengths = sorted(len(ids_of(t)) for i, t in want if i == k)
        assert sorted(r.doc_tokens for r in own if r.start == 0) == lengths and sum(r.length for r in own) == sum(lengths)
    whole = [(i, t) for i, t in want if sum(j == i for j, _ in want) == 1]
    single = {i for i, _ in whole}
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    ids = {i: ids_of(t) for i, t in whole}
    for r in out:
        if r.doc_id in single:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def test_empty_and_odd_rows(spark):
    schema = table(spark, "/root/testdata/sf0.001", "documents").schema
    for rows in ([], [(1, None, None, None, None), (1, "", "en", "a", 0), (None, "w " * 40, "en", None, 80), (3, " ".join(f"v{i}" for i in range(50)), None, "b", 1)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        assert {r.doc_id for r in docs.collect()} == ({3} if rows else set())


def test_columns_of_any_name(spark):
    """Columns named as the stages' own pass through all of them."""
    names = ["node", "failed", "n_words", "size", "position", "carried", "own__node", "kept__id", "c0", "words", "label", "a`b.c"]
    rows = [(i, " ".join(f"v{i}x{k}" for k in range(40)), "en", "s", 7, *range(len(names))) for i in (1, 2)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    columns, kinds = docs.columns, docs.dtypes
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns and docs.dtypes == kinds
    assert all(tuple(r)[5:] == tuple(range(len(names))) for r in docs.collect())


def test_one_of_each_keeps_odd_rows(spark):
    """Repeated rows are one document; rows without words are linked with nothing; equal ids of other texts are others."""
    schema = table(spark, "/root/testdata/sf0.001", "documents").schema
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, b + " x", "en", "s", 1), (None, a + " y", "en", "s", 1), (4, None, "en", "s", 0), (4, None, "en", "s", 0), (None, "q r s t u v", None, None, None)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, schema), "").collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([(1, a), (1, b), (4, None), (4, None), (None, "q r s t u v")], key=str)

