"""Quality rules as a ledger of bitmasks.

``ledger`` evaluates every rule once: a row for each document with its measurements and a mask of the rules that it
fails.  Policies are versioned masks, applied to the ledger without a look at the text; ``ablation`` counts, for each
rule of a policy, what it alone rejects, from one aggregate of the masks.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text (null and empty: none), lines are split at \\n.  A document without
words fails ``short`` and measures 0.  Repeated words are those in windows of 8 words that the text holds twice or more
(windows and lines are compared by 64-bit hashes).  Repeated rows and null or equal ids are rows each; other columns
are not read; an empty table gives an empty ledger.  Very long texts are measured whole, in arrays of some 30 bytes a
byte of text; ties don't occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, batch, buffers, chunks, mix, prefix_hash, prepare, released, span_hash, table, texts, windows, words

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
#: Each rule: a name, and by what a document fails, in integers.  A rule's bit is its place; new rules go to the end.
RULES: tuple[tuple[str, str], ...] = (
    ("short", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("marks", "100 * n_marks > 50 * n_words"),
    ("upper_case", "n_words >= 20 AND 100 * n_upper > 50 * word_chars"),
    ("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    ("long_words", "word_chars > 30 * n_words"),
    ("short_words", "n_words >= 20 AND word_chars < 2 * n_words"),
)
BASE = ("short", "repeated_words")
#: Versions are never changed, only added.
POLICIES: dict[str, tuple[str, ...]] = {"base-1": BASE, "web-1": tuple(n for n, _ in RULES)}
CURRENT = "web-1"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
SCHEMA = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES)])


def bit(rule: str) -> int:
    return 1 << [n for n, _ in RULES].index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which of these are not the first of their kind."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, later


def measured(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    start, end, h, first = words(data, offsets, lower=False)
    row = np.repeat(np.arange(n), np.diff(first))
    out = {"n_words": np.diff(first), "n_symbols": per_row(_SYMBOL[data], offsets), "n_upper": per_row(_UPPER[data], offsets), "n_marks": per_row(data == 33, offsets)}
    # Code points in words: all bytes in words that don't continue a code point.
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    out["word_chars"] = np.bincount(row, points[end] - points[start], n).astype(np.int64)

    # Lines that hold a word, compared within their row.
    starts = np.unique(np.r_[offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 10) + 1]).astype(np.int64)
    starts = starts[starts < len(data)]
    stops = np.r_[starts[1:], len(data)] if len(starts) else starts
    has = np.searchsorted(start, stops) > np.searchsorted(start, starts)
    starts, stops = starts[has], stops[has]
    stops = stops - (data[stops - 1] == 10) if len(stops) else stops
    of = np.searchsorted(offsets, starts, "right") - 1
    salt = mix(np.arange(n, dtype=np.uint64), 9)
    _, later = repeats(mix(span_hash(prefix_hash(data), starts, stops) ^ salt[of]))
    out["n_lines"], out["n_dup_lines"] = np.bincount(of, minlength=n), np.bincount(of[later], minlength=n)

    covered = np.zeros(len(h) + 1, np.int64)
    g = windows(h, WINDOW, 0)
    own = np.flatnonzero(row[: len(g)] == row[WINDOW - 1 :]) if len(g) else np.zeros(0, np.int64)
    again, _ = repeats(g[own] ^ salt[row[own]])
    at = own[again]
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(covered)[: len(h)] > 0], minlength=n)
    return out


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = buffers(b.column("text"))
        for lo, hi in chunks(offsets):
            found = measured(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield batch({"doc_id": b.column("doc_id").slice(lo, hi - lo), **found}, SCHEMA)


def failed_mask() -> Column:
    out = F.lit(0).cast("long")
    for i, (_, test) in enumerate(RULES):
        out = out.bitwiseOR(F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failed``: a bit for each rule that the document fails."""
    prepare(spark)
    rows = texts(documents).mapInArrow(measure, ", ".join(f"{f.name} long" for f in SCHEMA))
    return rows.withColumn("failed", failed_mask())


def kept(failed: Column, policy: str = CURRENT) -> Column:
    return failed.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Of each rule of a policy: how many documents fail it, and how many the policy would keep without it.  One
    aggregate over the masks; there are at most 2 ** len(RULES) of them."""
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("failed")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in POLICIES[policy]))
    each = masks.select("failed", "n", F.explode(rules).alias("r"))
    return each.groupBy("r.rule").agg(F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"))


def kept_documents(spark: SparkSession, documents: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that the policy keeps, with their own columns, whatever these are called.  The ledger's measurements
    are made beside the rows themselves, so repeated and null ids need no join; masks and policy are the ledger's."""
    prepare(spark)
    names, own = documents.columns, [f"c{i}" for i in range(len(documents.columns))]
    text, docs = own[names.index("text")], documents.toDF(*own)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(text))
            for lo, hi in chunks(offsets):
                m = measured(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns), *(pa.array(m[k], pa.int64()) for k in MEASURES)], [*own, *MEASURES])

    rows = docs.mapInArrow(run, docs.withColumns({k: F.lit(None).cast("long") for k in MEASURES}).schema)
    return rows.where(kept(failed_mask(), policy)).select(*own).toDF(*names)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, table(spark, sf_dir, "documents"))
    base = ~kept(F.col("failed"), "base-1")
    return rows.select("doc_id", *MEASURES[:5], base.alias("base_failed"), (~base & kept(F.col("failed"))).alias("kept"), "failed")


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT *, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper, len(regexp_extract_all(text, '!'))::BIGINT AS n_marks,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM w),
u AS (SELECT row, i, array_to_string(words[i:i + 7], ' ') AS win FROM (SELECT row, words, unnest(range(1, len(words) - 6)) AS i FROM m WHERE len(words) >= 8)),
c AS (SELECT row, i FROM (SELECT *, count(*) OVER (PARTITION BY row, win) AS n FROM u) WHERE n > 1),
r AS (SELECT row, count(DISTINCT i + k) AS n FROM c, range(8) t(k) GROUP BY row),
x AS (SELECT m.*, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN r USING (row)),
f AS (SELECT *, (""" + " + ".join(f"CASE WHEN {test} THEN {1 << i} ELSE 0 END" for i, (_, test) in enumerate(RULES)) + r""")::BIGINT AS failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""
