"""Multi-label rules: a label is set if any of its patterns is found in the lower-cased text."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import LABEL_RULES


#: The rules' \b, \w, \d and \s are those of Unicode; in a text whose other characters stand for their class in ASCII (no
#: rule holds a tilde, a seven or a lone underscore) they are the plain ones, and a dot is any character but a line feed.
CLASSES = (
    (r"[\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", " "),
    (r"[^\x00-\x7F\p{L}\p{N}]", "~"),
    (r"[^\x00-\x7F\p{L}\p{Nl}\p{No}]", "7"),
    (r"[^\x00-\x7F]", "_"),
)


def alternatives(pattern: str) -> list[str]:
    """The pattern cut at its outermost bars."""
    out, depth, bracket, at, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif bracket or c == "[":
            bracket = c != "]"
        elif c == "|" and not depth:
            out.append(pattern[at:i])
            at = i + 1
        else:
            depth += (c == "(") - (c == ")")
        i += 1
    return [*out, pattern[at:]]


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def together(patterns: tuple[str, ...]) -> str:
    """One pattern found where any of these is.  Those that begin at a word's edge are tried by the letter there."""
    by: dict[str, list[str]] = {}
    rest = []
    for p in dict.fromkeys(a for p in patterns for a in alternatives(p)):
        first = re.match(r"\\b(?:([a-z])(?![?*{])|\(([a-z][a-z ]*(?:\|[a-z][a-z ]*)*)\)(?![?*{]))", p)
        for c in sorted({x[0] for x in (first[1] or first[2]).split("|")}) if first else ():
            by.setdefault(c, []).append(p[2:])
        if not first:
            rest.append(p)
    edges = "|".join(f"(?={c})(?:{'|'.join(f'(?:{p})' for p in own)})" for c, own in sorted(by.items()))
    return "(?d)" + "|".join([*([rf"\b(?:{edges})"] if edges else []), *(f"(?:{p})" for p in rest)])


def label(df: DataFrame, rules: dict[str, tuple[str, ...]] | None = None, text: str = "text") -> DataFrame:
    """Adds a 0/1 column for each label; one alternation is matched for each, not every pattern by itself."""
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    plain = lowered
    for found, by in CLASSES:
        plain = F.regexp_replace(plain, found, by)
    df = df.withColumns({"__lowered": lowered, "__plain": plain})
    out = {}
    for name, patterns in (rules or LABEL_RULES).items():
        ascii_only, other = ([p for p in patterns if p.isascii() == x] for x in (True, False))
        hit = F.col("__plain").rlike(together(tuple(ascii_only))) if ascii_only else F.lit(False)
        out[name] = (hit | F.col("__lowered").rlike("(?dU)" + "|".join(f"(?:{p})" for p in other)) if other else hit).cast("int")
    return df.withColumns(out).drop("__lowered", "__plain")


def label_ascii(df: DataFrame, rules: dict[str, tuple[str, ...]] | None = None, text: str = "text") -> DataFrame:
    """The same with word edges and classes of ASCII and letters lower-cased one by one, as SQL on RE2 has them.

    Batches of texts go to RE2, whose automata read a text once, however many patterns a label has.
    """
    found = {name: "|".join(f"(?:{p})" for p in patterns) for name, patterns in (rules or LABEL_RULES).items()}

    @F.arrow_udf(", ".join(f"`{name}` int" for name in found))
    def hits(texts: pa.Array) -> pa.Array:
        lowered = pc.utf8_lower(texts)
        return pa.StructArray.from_arrays([pc.match_substring_regex(lowered, p).cast(pa.int32()) for p in found.values()], list(found))

    df = df.withColumn("__hits", hits(F.make_valid_utf8(F.coalesce(F.col(text), F.lit("")))))
    return df.withColumns({name: F.col("__hits")[name] for name in found}).drop("__hits")


def label_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """label, n and share of each label; and of rows with none and with several.

    Shares are rounded as doubles, a half away from 0, as SQL does it (F.round takes their shortest decimals); those of no
    rows are NaN.
    """
    several = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    total = df.agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names), F.count_if(several == 0).alias("none"), F.count_if(several > 1).alias("several"))
    pairs = F.array(*(F.struct(F.lit(n).alias("label"), F.col(n).cast("long").alias("n")) for n in [*names, "none", "several"]))
    millionths = F.col("p.n") / F.col("rows") * 1e6
    below = F.floor(millionths)
    share = F.when(F.col("rows") > 0, (below + F.when(millionths - below >= 0.5, 1).otherwise(0)) / 1e6).otherwise(float("nan"))
    return total.select("rows", F.explode(pairs).alias("p")).select("p.label", "p.n", share.alias("share"))
