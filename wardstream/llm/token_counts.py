"""Token counts by a unigram model, with the dynamic program shared along a trie.

A pre-token is a word (``[^\\x20\\x09-\\x0D]+``) after a word mark.  Its best segmentation has the highest sum of the
pieces' log-probabilities (of equal ones the fewest pieces); characters that no piece holds are spelled in bytes.

Distinct pre-tokens are inserted in a trie that a task keeps for all its batches.  A node stands for a prefix and holds its
forward score (best sum and number of pieces) and the pieces that are open there: what began at an earlier prefix and may
still go on, as a place in the trie of pieces.  A child follows from its parent alone, so a prefix that several
pre-tokens share is computed once; a pre-token's last node holds its count.  A document's count is the sum over its words.

The pieces come from a public vocabulary that lists them by rank; a piece's probability is that of its rank under
Zipf's law.  Null and empty texts count 0.  Repeated rows and null or equal ids are rows each; other columns are not
read; an empty table gives an empty result.  Time is linear in a text; beyond ``DEPTH`` characters a word's prefixes are
computed but not kept, a trie of ``MOST_NODES`` nodes is begun anew, and so are the counts at ``MOST_COUNTS``; memory is
bounded by these and by the text.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from math import log
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch, prepare, public_vocabulary, table, texts

MARK = "▁"
#: Characters of a pre-token whose prefixes are kept as nodes, and nodes and counts that a task keeps.
DEPTH, MOST_NODES, MOST_COUNTS = 64, 1 << 18, 1 << 19
#: Log-probability of a byte below that of the rarest piece.
BYTE_PENALTY = 10.0


class Model(NamedTuple):
    pieces: dict[str, float]
    byte: float


def zipf(ranked: list[str]) -> Model:
    """Pieces from the most to the least common."""
    norm = log(sum(1 / (i + 1) for i in range(len(ranked))))
    pieces = {p: -log(i + 1) - norm for i, p in enumerate(ranked)}
    return Model(pieces, min(pieces.values(), default=0.0) - BYTE_PENALTY)


def public_model(path: str | None = None) -> Model:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_vocabulary("piece_bpe_32k.model"))
    return zipf([sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))])


def piece_trie(pieces: dict[str, float]) -> dict:
    """The pieces as a trie: by character a pair of the children (none: an empty one) and, where a piece ends, its
    log-probability."""
    root: dict = {}
    for piece in sorted(pieces):
        at = root
        for c in piece[:-1]:
            at = at.setdefault(c, ({}, None))[0]
        if piece:
            at[piece[-1]] = at.get(piece[-1], ({},))[0], pieces[piece]
    return root


class Node:
    __slots__ = ("children", "count", "open", "score")

    def __init__(self, score: float, count: int, opened: list):
        self.score, self.count, self.open, self.children = score, count, opened, None


class Counter:
    """Counts of pieces by pre-token, over a trie that is kept between batches."""

    def __init__(self, model: Model):
        self.byte, self.pieces, self.nodes, self.known = model.byte, piece_trie(model.pieces), 0, {}
        self.forget()

    def forget(self) -> None:
        """Begins the trie anew; what is known of pre-tokens stays."""
        self.root, self.kept = Node(0.0, 0, []), 0

    def after(self, node: Node, c: str) -> Node:
        """The node of the prefix with one more character."""
        before, before_n = node.score, node.count
        spelled = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
        best, count, opened = before + spelled * self.byte, before_n + spelled, []
        for score, n, at in node.open:
            found = at.get(c)
            if found is not None:
                below, p = found
                if below:
                    opened.append((score, n, below))
                if p is not None and ((total := score + p) > best or (total == best and n + 1 < count)):
                    best, count = total, n + 1
        found = self.pieces.get(c)
        if found is not None:
            below, p = found
            if below:
                opened.append((before, before_n, below))
            if p is not None and ((total := before + p) > best or (total == best and before_n + 1 < count)):
                best, count = total, before_n + 1
        self.nodes += 1
        return Node(best, count, opened)

    def learn(self, word: bytes) -> int:
        node, text = self.root, MARK + word.decode("utf-8", "replace")
        for c in text[:DEPTH]:
            below = node.children
            if below is None:
                below = node.children = {}
            child = below.get(c)
            if child is None:
                child = below[c] = self.after(node, c)
                self.kept += 1
            node = child
        for c in text[DEPTH:]:
            node = self.after(node, c)
        self.known[word] = node.count
        return node.count

    def __call__(self, texts: list[bytes]) -> tuple[list[int], list[int]]:
        known, n_words, n_tokens = self.known, [], []
        for t in texts:
            if self.kept > MOST_NODES:
                self.forget()
            if len(known) > MOST_COUNTS:
                known.clear()
            own = t.split()  # of bytes: at \x20 and \x09 to \x0D only
            for w in set(own):
                if w not in known:
                    self.learn(w)
            n_words.append(len(own))
            n_tokens.append(sum(map(known.__getitem__, own)))
        return n_words, n_tokens


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


def counted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, on = Counter(model.value), gc.isenabled()
        gc.disable()  # the trie has no cycles, and looking through it for some takes most of the time
        try:
            for b in batches:
                n_words, n_tokens = counter([x.as_buffer().to_pybytes() for x in b.column("text")])
                yield batch({"doc_id": b.column("doc_id"), "n_words": n_words, "n_tokens": n_tokens}, OUT)
        finally:
            if on:
                gc.enable()

    return run


def token_counts(spark: SparkSession, documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens of every document."""
    prepare(spark)
    return texts(documents).mapInArrow(counted(spark.sparkContext.broadcast(model or public_model())), "doc_id long, n_words long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, table(spark, sf_dir, "documents"))
