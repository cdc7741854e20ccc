"""Toxicity by a weighted lexicon.

A text is folded character by character (case, homoglyphs, digits and signs that stand for letters; l, 1 and i are one),
everything else becomes a space, and an Aho-Corasick automaton finds lexicon words and stems in the whole of it; terms
without accents are also looked for in the text without accents.  Hits inside an exception phrase don't count.  What is found, as such and by length, goes into a logistic score.

The lexicon is learned from labelled documents: of at most ``TRAIN_ROWS`` of them (those of least hash of doc_id) every
folded word and every stem of ``STEMS`` characters that toxic documents hold in enough different surroundings, weighted
by the log-odds of toxic against other surroundings; of these the ``MOST_TERMS`` of most weight.  Counting surroundings,
not documents, keeps copies of one document from making its words look toxic.  Phrases of a lexicon word and a neighbour
that only other documents hold become exceptions, beside the fixed ones; of these the ``MOST_EXCEPTIONS`` most common.
Terms are counted and chosen by Spark; what comes to the driver and is broadcast has these bounds, and a filter of terms
a fixed size.

Null and empty texts get the score of no hits in no words; very long ones are folded and searched whole; an empty table gives
an empty result.  Ties between terms go to the lesser string.  Labels without doc_id or toxic are left out; of several for
one doc_id the highest holds.  Repeated rows are scored each; a null doc_id is scored and not held out.  Without any
training row the lexicon is empty and scores are the prior 0.  Other columns are never read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch, prepare, table, texts

#: Labelled rows that training looks at, at most; and terms and exceptions of the lexicon.
TRAIN_ROWS, MOST_TERMS, MOST_EXCEPTIONS = 16_000, 5_000, 5_000
#: Bits of the filter of terms that toxic documents hold; it only spares rows, the join with the terms decides.
FILTER = 1 << 22
#: Surroundings that a task remembers so as not to give them twice; beyond, it gives them again, and Spark drops them.
SEEN = 1 << 18
FOLDS = 5
STEMS = range(4, 11)
#: Surroundings in which a term must stand in toxic documents, and how much likelier it must surely be there.
LEAST_SURROUNDINGS, LEAST_ODDS = 4, 4.0

# Characters that look like a letter, and characters that are written for one.
HOMOGLYPHS = {"a": "аαɑ@4", "b": "ьв8", "c": "сϲ", "d": "ԁ", "e": "еєε3", "g": "ɡ9", "h": "һн", "i": "іιıl1!|ӏ", "j": "ј", "k": "кκ", "m": "м", "n": "пη", "o": "оοσ0", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ$5", "t": "тτ7", "u": "υц", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ʐ"}
#: Signs among these; they stand for letters only before another letter or digit.
SIGNS = "@$!|"
_TRAILING = re.compile(r"[@$!|]++(?![^\W_])")
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "out the trash", "class clown", "circus clown", "clown fish", "pond scum", "soap scum")


class Fold(dict):
    """For str.translate: one character for each, filled as characters occur; with accents or without."""

    _looks = {ord(x): a for a, xs in HOMOGLYPHS.items() for x in xs}

    def __init__(self, form: str):
        self.form = form

    def __missing__(self, c: int) -> str:
        out = self._looks.get(c)
        if out is None:
            base = unicodedata.normalize(self.form, chr(c).lower())[:1] or " "
            out = self._looks.get(ord(base), base if base.isalnum() else " ")
        self[c] = out
        return out


FOLD, PLAIN = Fold("NFKC"), Fold("NFKD")


def fold(text: str) -> str:
    """Folded words between single characters of space, as many characters as the text has, and one before and after."""
    if any(s in text for s in SIGNS):
        text = _TRAILING.sub(lambda m: " " * len(m[0]), text)
    return f" {text.translate(FOLD)} "


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


class Lexicon(NamedTuple):
    weights: dict[str, float]  # " word " or " stem", folded
    exceptions: tuple[str, ...]  # folded phrases
    model: tuple[float, ...]  # of features()


def terms(word: str) -> list[str]:
    return [f" {word} ", *(f" {word[:k]}" for k in STEMS if k < len(word))]


def automaton(lexicon: Lexicon) -> tuple:
    """Of all terms, for the folded text; and of those without accents, for the text without."""
    out = []
    for ascii_only in (False, True):
        a = ahocorasick.Automaton()
        for t, w in lexicon.weights.items():
            if not ascii_only or t.isascii():
                a.add_word(t, (len(t), w))
        for t in lexicon.exceptions:
            a.add_word(t, (len(t), None))
        if len(a):
            a.make_automaton()
        out.append(a)
    return tuple(out)


def hits(a: tuple, folded: str) -> list[float]:
    """The weight of each word that holds a term (its highest), without those in an exception phrase."""
    found: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for one, text in ((a[0], folded), (a[1], "" if folded.isascii() else folded.translate(PLAIN))):
        if len(one) and text:
            for end, (n, w) in one.iter(text):
                start = end - n + 1
                if w is None:
                    spared.append((start, end))
                elif found.get(start, -1.0) < w:
                    found[start] = w
    return [w for s, w in found.items() if not any(x <= s < y for x, y in spared)]


def features(weights: list[float], n_words: int) -> list[float]:
    """Found weight as such and by length: none, one or more hits, the strongest, and the density."""
    total = sum(weights)
    return [1.0, min(1.0, float(len(weights))), float(np.log1p(len(weights))), max(weights, default=0.0), total / float(np.sqrt(n_words + 10.0))]


def score(model: tuple[float, ...], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.array(model), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(50):
        p = score(tuple(w), x)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def surroundings(folded: str) -> Iterator[tuple[str, str, str]]:
    w = folded.split()
    for i, x in enumerate(w):
        yield (w[i - 1] if i else ""), x, (w[i + 1] if i + 1 < len(w) else "")


def slot(term: str) -> int:
    return zlib.crc32(term.encode()) & (FILTER - 1)


def occurrences(bits):
    """A function that gives term and a hash of its surroundings; of the terms that the filter lets pass, or all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        inside = np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool) if bits else None
        for b in batches:
            rows: dict = {"term": [], "around": [], "toxic": []}
            for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
                for left, word, right in surroundings(fold(text.as_py())):
                    at = zlib.crc32(f"{left}\0{word}\0{right}".encode())
                    if (at, toxic) in seen:  # the same word in the same place: all its terms were given
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add((at, toxic))
                    for t in terms(word):
                        if inside is None or inside[slot(t)]:
                            for c, v in zip(rows, (t, at, toxic), strict=True):
                                rows[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows["term"], pa.string()), pa.array(rows["around"], pa.int64()), pa.array(rows["toxic"], pa.int32())], ["term", "around", "toxic"])

    return run


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's part of the filter."""
    bits = np.zeros(FILTER, np.uint8)
    for b in batches:
        for t in b.column("term").to_pylist():
            bits[slot(t)] = 1
    at = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array((at >> 10).astype(np.int32)), pa.array((at & 1023).astype(np.int32))], ["part", "bit"])


def filter_of(found: DataFrame) -> bytes:
    """The filter of the terms: FILTER bits, whatever their number."""
    bits = np.zeros(FILTER, np.uint8)
    parts = found.select("term").mapInArrow(marked, "part int, bit int").distinct()
    for b in parts.toArrow().to_batches():  # FILTER rows at most
        bits[b.column("part").to_numpy().astype(np.int64) << 10 | b.column("bit").to_numpy()] = 1
    return np.packbits(bits).tobytes()


def phrases(lexicon):
    """A function that gives the phrases of a lexicon word and a neighbour."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = lexicon.value.weights
        for b in batches:
            out: set[tuple[str, int, int]] = set()
            for doc, text, toxic in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("toxic").to_pylist(), strict=True):
                for left, word, right in surroundings(fold(text.as_py())):
                    if any(t in weights for t in terms(word)):
                        out |= {(f" {p} ", doc, toxic) for p in ((f"{left} {word}" if left else ""), (f"{word} {right}" if right else "")) if p}
            cols = list(zip(*sorted(out), strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], ["term", "doc_id", "toxic"])

    return run


def featured(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(lexicon.value)
        for b in batches:
            x = []
            for text in b.column("text"):
                f = fold(text.as_py())
                x.append(features(hits(a, f), len(f.split())))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def learn(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicon and the model, from the labelled rows that are not held out."""
    prepare(spark)
    sc = spark.sparkContext
    fixed = tuple(fold(e) for e in EXCEPTIONS)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(crc % FOLDS != 0)
    labelled = labelled.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    labelled = spark.createDataFrame(labelled.toArrow()) if labelled.take(1) else None  # TRAIN_ROWS rows at most
    if labelled is None:
        return Lexicon({}, fixed, (-30.0, 0.0, 0.0, 0.0, 0.0))
    # One look at the whole corpus; all that follows reads these rows only.
    scratch = Scratch(spark, "toxicity")
    train = texts(documents).join(F.broadcast(labelled), "doc_id").select("doc_id", "text", "toxic")
    train = scratch.keep(train.repartition(max(8, sc.defaultParallelism), "doc_id"), "train")
    schema = "term string, around long, toxic int"

    def counts(rows: DataFrame) -> DataFrame:
        return rows.distinct().groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))

    found = counts(train.where("toxic = 1").mapInArrow(occurrences(None), schema)).where(F.col("t") >= LEAST_SURROUNDINGS)
    found = scratch.keep(found.select("term"), "terms")
    both = counts(train.mapInArrow(occurrences(sc.broadcast(filter_of(found))), schema).join(found, "term", "left_semi"))
    n_toxic = max(1, labelled.where("toxic = 1").count())
    n_clean = max(1, labelled.where("toxic = 0").count())
    t, c = F.col("t") + F.lit(0.5), F.col("c") + F.lit(0.5)
    odds = F.round(F.log(t / F.lit(float(n_toxic + 1))) - F.log(c / F.lit(float(n_clean + 1))), 9)
    sure = odds - 2 * F.sqrt(1 / t + 1 / c)
    both = both.withColumn("odds", odds).where((F.col("t") >= LEAST_SURROUNDINGS) & (sure > 0) & (odds > float(np.log(LEAST_ODDS))) & (F.col("c") <= F.col("t")))
    weights = {r.term: r.odds for r in both.select("term", "odds").orderBy(F.desc("odds"), "term").limit(MOST_TERMS).collect()}
    # A longer stem or a word says nothing if a stem of it is in the lexicon with as much weight.
    weights = {t: w for t, w in sorted(weights.items()) if not any(weights.get(t[: k + 1], -9.0) >= w for k in STEMS if k + 1 < len(t))}
    lexicon = Lexicon(weights, fixed, ())
    near = train.mapInArrow(phrases(sc.broadcast(lexicon)), "term string, doc_id long, toxic int").groupBy("term").agg(F.countDistinct(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("t"), F.countDistinct(F.when(F.col("toxic") == 0, F.col("doc_id"))).alias("c"))
    lexicon = lexicon._replace(exceptions=tuple(sorted({*fixed, *(r.term for r in near.where("t = 0 and c >= 5").orderBy(F.desc("c"), "term").limit(MOST_EXCEPTIONS).collect())})))
    x = train.mapInArrow(featured(sc.broadcast(lexicon)), "toxic int, x array<double>").toArrow()
    rows = np.array(x.column("x").to_pylist()).reshape(-1, 5)
    order = np.lexsort(rows.T)  # the same sums whatever order the rows come in
    y = x.column("toxic").to_numpy().astype(float)[order]
    scratch.drop(train, found)
    return lexicon._replace(model=fit(rows[order], (y > 0).astype(float)))


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_hits", pa.int64())])


def scored(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(lexicon.value)
        for b in batches:
            x, n = [], []
            for text in b.column("text"):
                f = fold(text.as_py())
                own = hits(a, f)
                n.append(len(own))
                x.append(features(own, len(f.split())))
            s = score(lexicon.value.model, np.array(x).reshape(-1, 5))
            yield batch({"doc_id": b.column("doc_id"), "held_out": [held_out(d) for d in b.column("doc_id").to_pylist()], "score": s, "predicted": (s >= 0.5).astype(np.int32), "n_hits": n}, SCORES)

    return run


def toxicity(spark: SparkSession, documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted and n_hits of every document."""
    prepare(spark)
    return texts(documents).mapInArrow(scored(spark.sparkContext.broadcast(lexicon)), "doc_id long, held_out boolean, score double, predicted int, n_hits long")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity(spark, documents, learn(spark, documents, table(spark, sf_dir, "labels")))
