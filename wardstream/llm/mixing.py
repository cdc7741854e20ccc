"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Sources by code point (null last) weigh 1, 2, 3, repeating.  They share all words by weight, but none gets more than
``MOST`` times its own; the excess is shared anew by weight among the others until none is above.  That is one water
level: sorted by cap over weight, the sources before some place are capped and the rest stand at the same level, so
windows over the table of sources find it without a loop.

A source's weight changes linearly over the training time t in [0, 1]: its density is 1 + tilt * (2t - 1), and its
integral (1 - tilt) * t + tilt * t * t is the share of its target that is due by t.  A source's documents, in the order
of a hash of their doc_id, lie one after another on its demand line, as often as the target asks (each pass takes all
of them before the next one begins); inverting the integral at a document's middle gives its time, and the words that
all sources together have due by then are its position.  Documents are range-sorted by that.

Size is the number of words of the text (null: 0).  The document at which the demand ends is cut there, so a source's
taken words are its target, rounded down.  A null doc_id has a place by the hash of the empty string; equal ids are
ordered by size and repeated rows take their turns one after another.  Sources of no words get nothing.  Other columns
don't matter to the mix.  A very long text is a document of its size, cut at most once.  The table of sources, a row for
each, is put in order by one task.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, WORD, n_words, table
from .ordered import running

WEIGHTS = 3
MOST = 3
#: Quarters by which a source's weight is tilted, by its weight: early, level, late.
TILT_QUARTERS = {1: 1, 2: 0, 3: -1}
#: A source's rows are cut into 16 ** this many ranges of their order, besides those without an id.
HEX_DIGITS = 3


def targets(sizes: DataFrame) -> DataFrame:
    """Of each source: source, source_size, weight, target and demand (the target in whole words)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    per = per.withColumn("rank", F.row_number().over(order)).withColumn("weight", ((F.col("rank") - 1) % WEIGHTS + 1).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * MOST).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    level = Window.orderBy(F.expr("cap * 6 div weight"), "rank")
    per = per.withColumn("capped_before", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("weight_from", F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
    fits = (F.col("total") - F.col("capped_before")) * F.col("weight") <= F.col("cap") * F.col("weight_from")
    # The first source that stays under its cap: what is left for it and those after it, and their weights.
    found = F.min(F.when(fits, F.struct(F.expr("cap * 6 div weight").alias("k"), F.col("rank"), (F.col("total") - F.col("capped_before")).alias("left"), F.col("weight_from").alias("among")))).over(Window.partitionBy())
    per = per.withColumn("found", found).withColumn("k", F.expr("cap * 6 div weight"))
    under = (F.col("k") > F.col("found.k")) | ((F.col("k") == F.col("found.k")) & (F.col("rank") >= F.col("found.rank")))
    per = per.withColumn("target", F.when(under, (F.col("weight") * F.col("found.left")).cast("double") / F.col("found.among").cast("double")).otherwise(F.col("cap").cast("double")))
    return per.select("source", "source_size", "weight", "target", F.floor("target").cast("long").alias("demand"))


def mix(documents: DataFrame, scratch: Scratch | None = None, carry: list[str] | None = None) -> DataFrame:
    """The documents with size, source_size, target, taken, full (whole passes), part (words of the last, partial one)
    and position (of the first pass; null if nothing is taken)."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), *((F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in carry)).alias("carried"),) if carry else ()))
    own = own.withColumn("place", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    if scratch:
        own = scratch.keep(own, "sizes")
    per = targets(own)
    # Rows without an id have one place, and may be many: theirs is cut by size, which is their order.
    nowhere = F.md5(F.lit("").cast("binary"))
    side = F.when(F.col("place") < nowhere, 0).when(F.col("place") == nowhere, 1).otherwise(2)
    own = own.withColumn("range", F.struct(F.substring("place", 1, HEX_DIGITS).alias("a"), side.alias("b"), F.when(side == 1, F.col("size")).otherwise(0).alias("c")))
    own = running(own, ["source"], "range", [F.col("place"), F.col("size")], {"before": "size"})
    quarter = F.create_map(*(F.lit(x) for k, v in TILT_QUARTERS.items() for x in (k, v)))
    per = per.withColumn("tilt", F.element_at(quarter, F.col("weight").cast("int")).cast("long"))
    # All sources' words due by t: (linear * t + square * t * t) / 4.
    due = per.agg(F.sum(F.col("demand") * (4 - F.col("tilt"))).alias("linear"), F.sum(F.col("demand") * F.col("tilt")).alias("square"))
    per = per.withColumnRenamed("source", "source__s").join(F.broadcast(due))  # one row
    out = own.join(per, F.col("source").eqNullSafe(F.col("source__s")))
    passes = F.when(F.col("source_size") > 0, F.expr("demand div source_size")).otherwise(0)
    out = out.withColumn("full", passes).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("demand") - F.col("full") * F.col("source_size") - F.col("before"))).cast("long"))
    out = out.withColumn("taken", F.col("full") * F.col("size") + F.col("part"))
    first = F.when(F.col("full") > 0, F.col("size")).otherwise(F.col("part"))
    share = (2 * F.col("before") + first).cast("double") / (2 * F.col("demand")).cast("double")
    out = out.withColumn("at", F.when(F.col("taken") > 0, time_of(share, F.col("tilt").cast("double") / 4)))
    out = out.withColumn("position", F.floor((F.col("linear") * F.col("at") + F.col("square") * F.col("at") * F.col("at")) / 4).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "full", "part", "before", "position", *(("carried",) if carry else ()))


def time_of(share, tilt):
    """The t at which (1 - tilt) * t + tilt * t * t is the share."""
    return F.lit(2.0) * share / ((1 - tilt) + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share))


def mixed_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The documents as the mix takes them, with their own columns: a row for each whole pass, and one with the words
    of a partial pass, sorted by the position at which training reaches the document first."""
    names = documents.columns
    out = mix(documents, carry=names).where("taken > 0")
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("full").cast("int")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")))
    out = out.select("carried", "size", "position", "doc_id", F.explode(copies).alias("words"))
    cut = (F.col("words") >= 0) & (F.col("words") < F.col("size"))
    text = F.when(cut, F.array_join(F.slice(F.regexp_extract_all("carried.text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")).otherwise(F.col("carried.text"))
    kind = dict(documents.dtypes)

    def column(c: str):
        if c == "text":
            return text.alias(c)
        if c == "n_chars":
            return F.when(cut, F.length(text)).otherwise(F.col("carried.n_chars")).cast(kind[c]).alias(c)
        return F.col("carried.`" + c.replace("`", "``") + "`").alias(c)

    return out.orderBy("position", "doc_id", "words").select(*(column(c) for c in names))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), Scratch(spark, "mixing"))
    return out.orderBy("position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "position")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS place,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight,
             row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank,
             3 * source_size AS cap, (SELECT sum(source_size) FROM s)::BIGINT AS total FROM s),
-- The level is the least at which all targets, each stopped at its cap, add up to the total.
c AS (SELECT a.*, (SELECT coalesce(sum(b.cap), 0) FROM w b WHERE (b.cap * 6 // b.weight, b.rank) < (a.cap * 6 // a.weight, a.rank))::BIGINT AS capped,
             (SELECT sum(b.weight) FROM w b WHERE (b.cap * 6 // b.weight, b.rank) >= (a.cap * 6 // a.weight, a.rank))::BIGINT AS among FROM w a),
f AS (SELECT cap * 6 // weight AS k, rank, total - capped AS rest, among FROM c
      WHERE (total - capped) * weight <= cap * among ORDER BY 1, 2 LIMIT 1),
t AS (SELECT c.source, c.source_size, c.weight,
             CASE WHEN (c.cap * 6 // c.weight, c.rank) >= (f.k, f.rank) THEN (c.weight * f.rest)::DOUBLE / f.among::DOUBLE ELSE c.cap::DOUBLE END AS target,
             CASE c.weight WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END AS tilt
      FROM c, f),
g AS (SELECT *, floor(target)::BIGINT AS demand FROM t),
due AS (SELECT sum(demand * (4 - tilt))::BIGINT AS linear, sum(demand * tilt)::BIGINT AS square FROM g),
r AS (SELECT *, (coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before FROM d),
p AS (SELECT r.doc_id, r.size, r.before, g.source_size, g.target, g.demand, g.tilt, due.linear, due.square,
             CASE WHEN g.source_size > 0 THEN g.demand // g.source_size ELSE 0 END AS passes
      FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source, due),
q AS (SELECT *, greatest(0, least(size, demand - passes * source_size - before)) AS part FROM p),
x AS (SELECT *, passes * size + part AS taken, CASE WHEN passes > 0 THEN size ELSE part END AS first, tilt::DOUBLE / 4 AS a FROM q),
y AS (SELECT *, CASE WHEN taken > 0 THEN (2 * before + first)::DOUBLE / (2 * demand)::DOUBLE END AS share FROM x),
z AS (SELECT *, 2.0::DOUBLE * share / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * share)) AS moment FROM y)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       floor((linear * moment + square * moment * moment) / 4)::BIGINT AS position
FROM z
"""
