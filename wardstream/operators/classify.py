"""The dictionary-weighted linear classifier and what the sifter makes of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Model:
    """token (bigrams joined by _) or, of a binary model, hash, and idf and coef of each entry, with intercept and threshold."""

    vocabulary: DataFrame
    intercept: float
    threshold: float


def fail_closed(spark: SparkSession) -> Model:
    """The model without a vocabulary: everything is manipulation."""
    return Model(spark.createDataFrame([], "token string, idf double, coef double"), 1.0, 0.5)


#: Entries up to which a vocabulary is part of the expression: rows are scored where they are, nothing is shuffled.
LITERALS = 1_000
#: Bytes up to which a larger vocabulary is broadcast; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Weights are summed in these units, so that no order of additions matters.
UNIT = 10**9


def classify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score, probability, is_manipulation, oov_ratio, tokens_matched and tokens_total, of each row by its own text;
    repeated rows, and null or equal keys, make no difference."""
    by = "hash" if "hash" in model.vocabulary.columns else "token"
    vocabulary = model.vocabulary.select(F.col(by).alias("token"), F.round(F.col("idf") * F.col("coef") * UNIT).cast("long").alias("weight")).where("token IS NOT NULL")
    few = vocabulary.limit(LITERALS + 1).collect() if by == "token" else None
    if few is not None and len(few) <= LITERALS and len({r.token for r in few}) == len(few):
        out = _in_rows(df, {r.token: r.weight for r in few}, text)
    else:
        out = _joined(df, vocabulary, text, T.items if by == "token" else T.item_hashes)
    out = out.withColumn("score", F.round(F.lit(model.intercept) + F.col("__sum").cast("double") / UNIT, 6)).drop("__sum")
    oov = F.when(F.col("tokens_total") == 0, 1.0).otherwise(1 - F.col("tokens_matched") / F.col("tokens_total"))
    out = out.withColumns({"probability": T.sigmoid(F.col("score")), "is_manipulation": F.col("score") > model.threshold, "oov_ratio": oov})
    return out.select(*df.columns, "score", "probability", "is_manipulation", "oov_ratio", "tokens_matched", "tokens_total")


def _in_rows(df: DataFrame, weights: dict[str, int], text: str) -> DataFrame:
    """__sum, tokens_matched and tokens_total by lookups in the row: tokens in a hash set, bigrams only after a token
    that begins one."""
    single, double = [t for t in weights if "_" not in t], [t for t in weights if "_" in t]
    df = df.withColumn("__t", T.tokens(F.col(text)))
    none = F.array().cast("array<string>")
    found = F.filter("__t", lambda t: t.isin(single)) if single else none
    if double:
        first = sorted({t.split("_")[0] for t in double})
        pairs = F.transform("__t", lambda t, i: F.when(t.isin(first), F.concat(t, F.lit("_"), F.get("__t", i + 1))))
        found = F.concat(found, F.filter(pairs, lambda t: F.coalesce(t.isin(double), F.lit(False))))
    df = df.withColumn("__hits", found)
    table = F.create_map(*(F.lit(x) for t, w in weights.items() for x in (t, w))) if weights else F.create_map().cast("map<string, bigint>")
    total = F.aggregate("__hits", F.lit(0).cast("long"), lambda s, t: s + F.coalesce(F.try_element_at(table, t), F.lit(0)).cast("long"))
    n = F.size("__t").cast("long")
    return df.withColumns({"__sum": total, "tokens_matched": F.size("__hits").cast("long"), "tokens_total": F.greatest(F.lit(0), 2 * n - 1)}).drop("__t", "__hits")


def _joined(df: DataFrame, vocabulary: DataFrame, text: str, items) -> DataFrame:
    """The same by a join.  A text's sums depend on nothing but the text, so they are grouped by 128 bits of its hash
    and divided by the number of its copies."""
    size = vocabulary.agg(F.coalesce(F.sum(F.octet_length(F.col("token").cast("string")) + 32), F.lit(0))).first()[0]
    vocabulary = F.broadcast(vocabulary) if size <= BROADCAST_BYTES else vocabulary
    of = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"__a": F.xxhash64(of), "__b": F.xxhash64(F.lit(1), of)})
    key = ["__a", "__b"]
    copies = df.groupBy(*key).agg(F.count("*").alias("__n"))
    hits = df.select(*key, F.explode(items(F.col(text))).alias("token")).join(vocabulary, "token").groupBy(*key).agg(F.sum("weight").alias("__all"), F.count("*").alias("__matched"))
    own = hits.join(copies, key).select(*key, F.expr("__all div __n").alias("__sum"), F.expr("__matched div __n").alias("tokens_matched"))
    out = df.withColumn("tokens_total", F.greatest(F.lit(0), 2 * F.size(T.tokens(F.col(text))).cast("long") - 1)).join(own, key, "left").drop(*key)
    return out.withColumns({"__sum": F.coalesce("__sum", F.lit(0).cast("long")), "tokens_matched": F.coalesce("tokens_matched", F.lit(0).cast("long"))})


def sift(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds entropy, surprise, has_bias, oov_byte, anchor and the classifier's and lists' columns."""
    out = classify(T.bias_breakdown(df, text), model, text)
    entropy = F.greatest(F.floor(F.col("probability") * T.U16).cast("int"), T.keyword_boost(F.col("total")))
    return out.withColumns({"entropy": entropy, "surprise": F.floor(F.col("oov_ratio") * T.U16).cast("int"), "oov_byte": F.floor(F.col("oov_ratio") * 255).cast("int"), "has_bias": F.col("is_manipulation") | (F.col("total") > 0), "anchor": T.anchor_hash(F.col(text))})


def from_classification(out: DataFrame) -> DataFrame:
    """What the sifter makes of the classifier alone: adds error, entropy, has_bias and oov_byte."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("probability")))
    return out.withColumns({"error": F.col("probability"), "entropy": F.floor(p * T.U16).cast("int"), "has_bias": F.col("is_manipulation"), "oov_byte": F.floor(F.col("oov_ratio") * 255).cast("int")})


def sift_best(df: DataFrame, group: list[str], position: str) -> DataFrame:
    """Of each group the row of highest entropy, the first of equal ones; without any above 0 a synthetic one of 65535."""
    best = F.max_by(F.struct("entropy", "surprise", "has_bias", F.col(position).alias("position")), F.struct(F.col("entropy"), -F.col(position)))
    out = df.groupBy(*group).agg(best.alias("b"))
    some = F.col("b.entropy") > 0
    return out.select(*group, F.when(some, F.col("b.entropy")).otherwise(65535).alias("entropy"), F.when(some, F.col("b.surprise")).otherwise(0).alias("surprise"), F.coalesce(some & F.col("b.has_bias"), F.lit(False)).alias("has_bias"), F.when(some, F.col("b.position")).alias("position"))
