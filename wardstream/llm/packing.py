"""Packing documents into token sequences as a cutting-stock problem, solved by column generation.

1. One pass makes each document's ids.  What fills whole sequences leaves as such; the rest, its tail, has a length class
   (``UNIT`` tokens wide, so there are 256 classes at any input).
2. The histogram of classes is the demand of a linear program whose columns are patterns (how many tails of each class
   stand in a sequence) and cuts (a tail of one class made two of others, at a small price).  A knapsack dynamic
   program prices new patterns until none helps, or the bound shows that little is left.
3. Patterns and cuts are rounded down; what is left is packed first-fit, the longest first, as patterns of one sequence.
4. Tails are ranked within their class by sums over partitions; a rank decides the pattern, its copy and the slot.

The checksum of a piece that a cut makes follows from checksums at every ``CUT`` tokens, so no ids are kept.

Null and empty texts are a document of the closing id alone.  Repeated rows and rows of equal or null doc_id are documents
each.  A special token's string in a text is that token.  Very long texts are tokenized whole, in memory of about 30 bytes a
character.  Ties between patterns go to the first found; they change which tail stands where, not the padding.
A sequence's length is padded to ``LENGTH`` unless it is a power of two.  Other columns are not read.  An empty
table gives no sequences.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, batch, prepare, public_vocabulary, released, table, texts
from .ordered import running

LENGTH, UNIT, CUT = 2048, 8, 64
UNITS = LENGTH // UNIT
END_ID = 1
#: What a cut costs, in sequences; and the gap to the bound, as a share, at which patterns are good enough.
CUT_PRICE, GAP = 0.01, 2e-4
#: Columns generated at most; a plan that stops there is feasible all the same, only with more padding (a few hundred
#: suffice for 256 classes).
MOST_COLUMNS = 6000

DOCS = pa.schema([("part", pa.int32()), ("idx", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("chunks", pa.int64()), ("class", pa.int32()), ("checks", pa.binary())])
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("slot", pa.int64())])


class Tokenizer:
    """Ids of a byte-level BPE as its full description gives them, special tokens' strings in a text included: by its
    ranks in a faster library, and by the description itself where that library gives up on a text."""

    def __init__(self, ranks: str, full: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(full) as f:
            special = json.load(f)["added_tokens"]
        # What the faster library can't do as the description says goes to the description.
        plain = len(special) < 2 and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in special)
        self.not_here = () if plain else tuple(t["content"] for t in special)
        self.special = {t["content"]: t["id"] for t in special} if plain else {}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=self.special)
        self.full = full

    @lru_cache(1)  # noqa: B019
    def slow(self):
        from tokenizers import Tokenizer as Full

        return Full.from_file(self.full)

    def __call__(self, text: str) -> np.ndarray:
        ids = None
        if not any(t in text for t in self.not_here):
            try:
                ids = self.encoding.encode(text, allowed_special="all") if any(t in text for t in self.special) else self.encoding.encode_ordinary(text)
            except BaseException as e:  # its pattern engine gives up on some very long runs, by an error outside Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if ids is None:
            ids = self.slow().encode(text, add_special_tokens=False).ids
        out = np.empty(len(ids) + 1, "<u4")
        out[:-1] = ids
        out[-1] = END_ID
        return out


def tokenized(ranks: str, full: str):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, idx = Tokenizer(ranks, full), TaskContext.get().partitionId(), 0
        for b in batches:
            rows: dict = {"doc_tokens": [], "chunks": [], "class": [], "checks": []}
            for text in b.column("text"):
                ids = memoryview(encode(text.as_py())).cast("B")
                n, checks = len(ids) // 4, []
                whole = n // LENGTH
                checks = [zlib.crc32(ids[4 * LENGTH * k : 4 * LENGTH * (k + 1)]) for k in range(whole)]
                at, crc = whole * LENGTH, 0
                while at < n:
                    to = min(at + CUT, n)
                    crc = zlib.crc32(ids[4 * at : 4 * to], crc)
                    checks.append(crc)
                    at = to
                rows["doc_tokens"].append(n)
                rows["chunks"].append(whole)
                rows["class"].append(-(-(n - whole * LENGTH) // UNIT))
                rows["checks"].append(np.array(checks, "<u4").tobytes())
            yield batch(rows | {"part": np.full(len(b), part, np.int32), "idx": np.arange(idx, idx + len(b)), "doc_id": b.column("doc_id")}, DOCS)
            idx += len(b)

    return run


# -- the linear program --------------------------------------------------------------------------------------------


def knapsack(y: np.ndarray) -> tuple[float, np.ndarray]:
    """The most valuable pattern: how many of each class (1 to UNITS) within UNITS units."""
    value, last = np.zeros(UNITS + 1), np.zeros(UNITS + 1, int)
    for c in range(1, UNITS + 1):
        with_item = y[1 : c + 1] + value[c - 1 :: -1][:c]
        k = int(with_item.argmax())
        if with_item[k] > value[c - 1] + 1e-12:
            value[c], last[c] = with_item[k], k + 1
        else:
            value[c] = value[c - 1]
    pattern, c = np.zeros(UNITS + 1), UNITS
    while c > 0:
        if last[c]:
            pattern[last[c]] += 1
            c -= last[c]
        else:
            c -= 1
    return float(value[UNITS]), pattern


class Column(NamedTuple):
    cost: float
    amounts: np.ndarray  # by class, from 0 (unused)
    cut: tuple[int, int] | None = None  # class, and units of the first piece
    surplus: bool = False


def relaxed(demand: np.ndarray) -> list[tuple[float, Column]]:
    """Columns in use and how much of each, for demand by class; revised simplex with generated columns."""
    m = UNITS
    columns, inverse = [], np.zeros((m, m))
    for c in range(1, m + 1):
        a = np.zeros(m + 1)
        a[c] = m // c
        columns.append(Column(1.0, a))
        inverse[c - 1, c - 1] = 1 / a[c]
    # A little noise on the demand keeps the simplex from standing still.
    want = demand[1:] + 1e-7 * (1 + np.arange(m) % 97)
    x = inverse @ want
    first, of = np.meshgrid(np.arange(CUT // UNIT, m, CUT // UNIT), np.arange(1, m + 1))
    fits = first < of
    first, of = first[fits], of[fits]
    for _ in range(MOST_COLUMNS):
        y = np.r_[0.0, np.array([c.cost for c in columns]) @ inverse]
        if y.min() < -1e-9:
            c = int(y.argmin())
            a = np.zeros(m + 1)
            a[c] = -1
            new = Column(0.0, a, surplus=True)
        else:
            value, pattern = knapsack(y)
            gains = y[of] - y[first] - y[of - first] - CUT_PRICE
            k = int(gains.argmax())
            if value <= 1 + 1e-9 and gains[k] <= 1e-9:
                break
            if gains[k] <= 1e-9 and y[1:] @ want / value >= (1 - GAP) * sum(c.cost * v for c, v in zip(columns, x, strict=True)):
                break
            if gains[k] > value - 1:
                a = np.zeros(m + 1)
                a[of[k]] += 1  # a cut meets the demand of one tail, and makes that of two
                a[first[k]] -= 1
                a[of[k] - first[k]] -= 1
                new = Column(CUT_PRICE, a, cut=(int(of[k]), int(first[k])))
            else:
                new = Column(1.0, pattern)
        d = inverse @ new.amounts[1:]
        up = d > 1e-10
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, d, 1), np.inf)
        r = int(ratio.argmin())
        step = ratio[r]
        x = x - step * d
        x[r] = step
        inverse[r] /= d[r]
        d[r] = 0
        inverse -= np.outer(d, inverse[r])
        columns[r] = new
    return [(max(0.0, float(v)), c) for v, c in zip(x, columns, strict=True)]


class Plan(NamedTuple):
    """Cuts by class: ranks below ``to`` of class ``of`` (those from the last ``to`` on) give a piece of ``first`` units
    and a rest, whose ranks begin at ``rank_first`` and ``rank_rest``.  Slots: by class and first rank, the sequence of
    that rank and how many of the class a sequence has."""

    cuts: np.ndarray  # of, rank from, first units, rank_first, rank_rest; sorted
    slots: np.ndarray  # class << 40 | rank from, sequence, number in a sequence; sorted
    uncut_from: np.ndarray  # by class: ranks below are cut
    sequences: int


def solve(histogram: dict[int, int]) -> Plan:
    """The plan for so many tails of each class; it has at most a few rows for each pattern, however many tails there are."""
    demand = np.zeros(UNITS + 1, np.int64)
    for c, n in histogram.items():
        if c:
            demand[c] = n
    used = relaxed(demand.astype(float)) if demand.any() else []
    left, cuts, patterns = demand.copy(), [], []
    uncut_from = np.zeros(UNITS + 1, np.int64)
    n_pieces = demand.copy()  # with those that cuts make
    for v, c in used:
        if c.cut and (k := min(int(v), int(demand[c.cut[0]] - uncut_from[c.cut[0]]))) > 0:
            of, first = c.cut
            cuts.append((of, uncut_from[of], first, n_pieces[first], n_pieces[of - first] + k * (first == of - first)))
            uncut_from[of] += k
            n_pieces[first] += k
            n_pieces[of - first] += k
            left[of] -= k
            left[first] += k
            left[of - first] += k
    for v, c in used:
        if not c.cut and not c.surplus and (k := int(v + 1e-9)):
            a = c.amounts.astype(np.int64)
            n = min([k, *(left[i] // a[i] for i in np.flatnonzero(a))])
            if n > 0:
                patterns.append((int(n), a))
                left -= n * a
    # First fit, the longest first; as many times as the demand allows at once.
    while left.any():
        a, room = np.zeros(UNITS + 1, np.int64), UNITS
        for c in np.flatnonzero(left)[::-1]:
            a[c] = min(left[c], room // c)
            room -= a[c] * c
        n = int(min(left[i] // a[i] for i in np.flatnonzero(a)))
        patterns.append((n, a))
        left -= n * a
    slots, rank, sequence = [], uncut_from.copy(), 0
    for n, a in patterns:
        for c in np.flatnonzero(a):
            slots.append((int(c) << 40 | int(rank[c]), sequence, int(a[c])))
            rank[c] += n * a[c]
        sequence += n
    return Plan(np.array(sorted(cuts), np.int64).reshape(-1, 5), np.array(sorted(slots), np.int64).reshape(-1, 3), uncut_from, sequence)


# -- checksums of what a cut makes ----------------------------------------------------------------------------------


@lru_cache(64)
def zeros_matrix(n: int) -> tuple[int, ...]:
    """The linear map of a CRC-32 that n zero bytes make, as its 32 images."""
    if n == 1:
        return tuple(zero_byte(1 << i) for i in range(32))
    half = zeros_matrix(n // 2)
    both = tuple(applied(half, applied(half, 1 << i)) for i in range(32))
    return tuple(applied(zeros_matrix(1), b) for b in both) if n % 2 else both


def zero_byte(x: int) -> int:
    for _ in range(8):
        x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
    return x


def applied(images: tuple[int, ...], x: int) -> int:
    out, i = 0, 0
    while x:
        if x & 1:
            out ^= images[i]
        x >>= 1
        i += 1
    return out


def crc_of_rest(whole: int, first: int, rest_bytes: int) -> int:
    """The checksum of what follows, from those of the whole and of its first part."""
    return whole ^ applied(zeros_matrix(rest_bytes), first)


# -- placing -----------------------------------------------------------------------------------------------------------


def placed(plan):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = plan.value
        for b in batches:
            doc, n, chunks, before, cls, rank = (b.column(c) for c in ("doc_id", "doc_tokens", "chunks", "chunks_before", "class", "rank"))
            doc_ids = doc.to_pylist()
            rows: list[tuple] = []
            for i, (tokens, whole, seq, c, r, checks) in enumerate(zip(n.to_pylist(), chunks.to_pylist(), before.to_pylist(), cls.to_pylist(), rank.to_pylist(), b.column("checks"), strict=True)):
                crc = np.frombuffer(checks.as_buffer(), "<u4")
                for k in range(whole):
                    rows.append((i, k * LENGTH, LENGTH, int(crc[k]), tokens, -1, p.sequences + seq + k))
                start, tail = whole * LENGTH, tokens - whole * LENGTH
                if not c:
                    continue
                if r >= p.uncut_from[c]:
                    rows.append((i, start, tail, int(crc[-1]), tokens, c, r))
                    continue
                own = p.cuts[p.cuts[:, 0] == c]
                _, low, first, rank_first, rank_rest = own[np.searchsorted(own[:, 1], r, "right") - 1].tolist()
                size = first * UNIT
                a = int(crc[whole + size // CUT - 1])
                rows.append((i, start, size, a, tokens, first, rank_first + r - low))
                rows.append((i, start + size, tail - size, crc_of_rest(int(crc[-1]), a, 4 * (tail - size)), tokens, c - first, rank_rest + r - low))
            if not rows:
                continue
            x = np.array(rows, np.int64)
            key = x[:, 5] << 40 | x[:, 6]
            whole = x[:, 5] < 0
            sequence, slot = x[:, 6].copy(), np.zeros(len(x), np.int64)
            if len(p.slots) and not whole.all():
                s = p.slots[np.searchsorted(p.slots[:, 0], key[~whole], "right") - 1]
                inside = key[~whole] - s[:, 0]
                sequence[~whole] = s[:, 1] + inside // s[:, 2]
                slot[~whole] = x[~whole, 5] << 20 | inside % s[:, 2]
            ids = pa.array(doc_ids, pa.int64()).take(pa.array(x[:, 0]))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.ascontiguousarray(c)) for c in (x[:, 1], x[:, 2], x[:, 3], x[:, 4], sequence, slot))], schema=PIECES)

    return run


def pack(spark: SparkSession, documents: DataFrame, ranks: str | None = None, full: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    prepare(spark)
    scratch = Scratch(spark, "packing")
    run = tokenized(ranks or public_vocabulary("byte_bpe_50k.tiktoken"), full or public_vocabulary("byte_bpe_50k.json"))
    docs = scratch.keep(texts(documents).mapInArrow(run, "part int, idx long, doc_id long, doc_tokens long, chunks long, class int, checks binary"), "docs")
    histogram = {r[0]: r[1] for r in docs.groupBy("class").count().collect()}  # UNITS + 1 rows at most
    plan = spark.sparkContext.broadcast(solve(histogram))
    docs = docs.withColumn("whole", F.lit(0)).withColumn("one", F.lit(1).cast("long"))
    docs = running(docs, ["whole"], "part", [F.col("idx")], {"chunks_before": "chunks"})
    docs = running(docs, ["class"], "part", [F.col("idx")], {"rank": "one"})
    pieces = docs.select("doc_id", "doc_tokens", "chunks", "chunks_before", "class", "rank", "checks").mapInArrow(placed(plan), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("slot")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
