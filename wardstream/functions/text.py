"""Text functions as Spark columns; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as L

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
U16 = 65535


def ascii_fold(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """Pieces between Unicode white space; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), L.SPACE_JAVA), lambda w: w != "")


PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def trimmed(word: Column) -> Column:
    """Without ASCII punctuation at either end."""
    return F.btrim(word, F.lit(PUNCTUATION))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to all cores by ``keys``, if the table is too small to lie in as many row groups; a table of more
    than ``SMALL`` bytes a core stays as it is read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(n, *keys) if size < n * SMALL else df


SMALL = 4 << 20


def bias_breakdown(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds one score for each category, emphasis, their total (halo) and has_bias.

    A token counts unless one of the six before it is a negation; lists score 100 an occurrence, phrases 100 each once,
    words of capitals 50.  Everything stops at 65535.

    One pass over the words keeps the listed ones (a hash lookup each) and words of capitals; a fold over these few,
    which carries the place of the last negation, counts them.  Only after a phrase's first word are the next ones read.
    """
    phrases = [p.split(" ") for own in L.PHRASES.values() for p in own]
    listed = sorted({*L.NEGATIONS, *(w for own in L.CATEGORIES.values() for w in own), *(p[0] for p in phrases)})
    df = df.withColumn("__w", words(F.col(text)))
    capitals = lambda t: t.rlike("^[A-Z][A-Z]+$")
    # lower() finds whatever ASCII folding finds, and is the faster one.
    found = F.filter(F.transform("__w", lambda x, i: F.struct(i.alias("i"), trimmed(x).alias("t"))), lambda h: F.lower(h["t"]).isin(listed) | capitals(h["t"]))

    def seen(h: Column) -> Column:
        fold = ascii_fold(h["t"])
        mask = F.lit(0)
        for k, p in enumerate(phrases):
            same = fold == p[0]
            for j, w in enumerate(p[1:], 1):
                same &= F.coalesce(ascii_fold(trimmed(F.get("__w", h["i"] + j))) == w, F.lit(False))
            mask = mask.bitwiseOR(F.when(same, F.lit(1 << k)).otherwise(F.lit(0)))
        return F.struct(h["i"].alias("i"), fold.alias("f"), capitals(h["t"]).alias("capitals"), mask.alias("mask"))

    def count(a: Column, h: Column) -> Column:
        live = h["i"] - a["last"] > L.NEGATION_REACH
        one = lambda name, test: (a[name] + F.when(live & test, 1).otherwise(0)).alias(name)
        return F.struct(
            F.when(h["f"].isin(list(L.NEGATIONS)), h["i"]).otherwise(a["last"]).alias("last"), *(one(n, h["f"].isin(list(own))) for n, own in L.CATEGORIES.items()),
            one("emphasis", h["capitals"]), a["mask"].bitwiseOR(F.when(live, h["mask"]).otherwise(0)).alias("mask"),
        )

    start = F.struct(F.lit(-100).alias("last"), *(F.lit(0).alias(n) for n in (*L.CATEGORIES, "emphasis", "mask")))
    df = df.withColumn("__a", F.aggregate(F.transform(found, seen), start, count))
    most = lambda c: F.least(F.lit(U16).cast("long"), c.cast("long")).cast("int")
    out, at = {n: most(F.col(f"__a.{n}").cast("long") * 100) for n in L.CATEGORIES}, 0
    for name, own in L.PHRASES.items():
        out[name] = most(F.bit_count(F.col("__a.mask").bitwiseAND(((1 << len(own)) - 1) << at)) * 100)
        at += len(own)
    out["emphasis"] = most(F.col("__a.emphasis").cast("long") * 50)
    df = df.withColumns(out)
    total = F.least(F.lit(U16), sum((F.col(n) for n in out), F.lit(0)))
    return df.withColumn("total", total).withColumn("has_bias", F.col("total") > 0).drop("__w", "__a")


def keyword_boost(total: Column) -> Column:
    return F.least(F.lit(U16), F.floor(total * U16 / 9000)).cast("int")


def bound(value: Column, of) -> Column:
    """of(value) with the value computed once; inside a lambda it would be computed for every element."""
    return F.element_at(F.transform(F.array(value), of), 1)


def utility(observation: Column, objective: Column) -> Column:
    """100 for each word of the observation that is among the first 256 of the objective."""
    def clean(t):
        return F.filter(F.transform(words(t), lambda w: ascii_fold(trimmed(w))), lambda w: w != "")

    hits = bound(F.slice(clean(objective), 1, 256), lambda goal: F.size(F.filter(clean(observation), lambda w: F.array_contains(goal, w))))
    return F.least(F.lit(U16), 100 * hits)


def drift_score(observation: Column, objective: Column) -> Column:
    """1 less the matches of the first 8 words by the number of goal words; below 0 where words repeat; null without a
    goal."""
    seen = F.slice(words(observation), 1, 8)
    return bound(F.slice(words(objective), 1, 8), lambda goal: F.when(F.size(goal) > 0, 1 - F.size(F.filter(seen, lambda w: F.array_contains(goal, w))).cast("double") / F.size(goal)))


def octets(text: Column) -> Column:
    """The bytes of a text (null: none) as integers: read as Latin-1, each byte is a character."""
    own = F.transform(F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), ""), lambda x: F.ascii(x).cast("long"))
    return F.when(F.octet_length(text) > 0, own).otherwise(F.array().cast("array<bigint>"))


def adler32(text: Column) -> Column:
    """One fold: the sum of the bytes, and the sum of these sums; they stay below 2 ** 63 for texts of up to 2 GB."""
    zero = F.lit(0).cast("long")
    n = F.octet_length(F.coalesce(text, F.lit(""))).cast("long")
    sums = F.aggregate(octets(text), F.struct(zero.alias("a"), zero.alias("b")), lambda s, x: F.struct((s["a"] + x).alias("a"), (s["b"] + s["a"] + x).alias("b")))
    return bound(F.struct(sums.alias("s"), n.alias("n")), lambda v: F.shiftleft((v["n"] + v["s"]["b"]) % 65521, 16).bitwiseOR((1 + v["s"]["a"]) % 65521))


def anchor_hash(text: Column) -> Column:
    return adler32(text).bitwiseAND(0x7FFFFFFF)


def fnv32(text: Column) -> Column:
    """32-bit FNV-1a; products stay below 2 ** 57."""
    return F.aggregate(octets(text), F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * 16777619).bitwiseAND(0xFFFFFFFF))


def fnv32_folded(text: Column) -> Column:
    """The same with ASCII capitals read as small letters."""
    return fnv32(ascii_fold(text))


def _prime_step(s: Column, x: Column) -> Column:
    """(s xor x) times 2 ** 40 + 435, in halves of 32 bits that no product overflows; x is below 2 ** 32."""
    lo = s["lo"].bitwiseXOR(x)
    return F.struct((s["hi"] * 435 + F.shiftright(lo * 435, 32) + F.shiftleft(lo, 8)).bitwiseAND(0xFFFFFFFF).alias("hi"), (lo * 435).bitwiseAND(0xFFFFFFFF).alias("lo"))


def _whole(s: Column) -> Column:
    return F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"])


def fnv64(text: Column) -> Column:
    """64-bit FNV-1a, as the long of the same bits."""
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    return _whole(F.aggregate(octets(F.coalesce(text, F.lit(""))), start, _prime_step))


def bigram_hash(first: Column, second: Column) -> Column:
    """Of two tokens' hashes: the first, an underscore and the second, each multiplied in."""
    def halves(h: Column) -> Column:
        return F.struct(F.shiftrightunsigned(h, 32).alias("hi"), h.bitwiseAND(0xFFFFFFFF).alias("lo"))

    def both(s: Column, h: Column) -> Column:
        return F.struct(s["hi"].bitwiseXOR(F.shiftrightunsigned(h, 32)).alias("hi"), s["lo"].bitwiseXOR(h.bitwiseAND(0xFFFFFFFF)).alias("lo"))

    return bound(_prime_step(halves(first), F.lit(0x5F).cast("long")), lambda s: _whole(_prime_step(both(s, second), F.lit(0).cast("long"))))


def item_hashes(text: Column) -> Column:
    """The hashes of items(), in the same order."""
    def after(t):
        before = F.concat(F.array(F.lit(None).cast("bigint")), t)
        pairs = F.zip_with(before, t, lambda b, x: F.when(x.isNull(), F.array().cast("array<bigint>")).when(b.isNull(), F.array(x)).otherwise(F.array(bigram_hash(b, x), x)))
        return F.flatten(pairs)

    return bound(F.transform(tokens(text), fnv64), after)


def substring_mask(text: Column) -> Column:
    """A bit for each adversarial substring in the first 64 KiB, whatever the case of ASCII letters."""
    t = F.coalesce(text, F.lit(""))
    bounded = F.when(F.octet_length(t) <= 65536, t).otherwise(F.regexp_replace(F.decode(F.substring(F.encode(t, "UTF-8"), 1, 65536), "UTF-8"), r"\uFFFD+$", ""))
    folded = ascii_fold(bounded)
    return sum((F.when(F.contains(folded, F.lit(p)), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(L.SUBSTRINGS)), F.lit(0))


def adversarial_score(mask: Column) -> Column:
    return F.bit_count(mask).cast("double") / 10


def is_adversarial(text: Column, patterns: list[str]) -> Column:
    """Whole-text equality with one of the last 8 patterns, whatever the case of ASCII letters."""
    kept = [p.translate(str.maketrans(_UPPER, _LOWER)) for p in patterns[-8:]]
    return F.coalesce(ascii_fold(text).isin(kept), F.lit(False)) if kept else F.lit(False)


def tokens(text: Column) -> Column:
    """ASCII alphanumeric runs, lower-cased, at most 256 bytes of each."""
    runs = F.split(ascii_fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.transform(F.filter(runs, lambda t: t != ""), lambda t: F.substring(t, 1, 256))


def items(text: Column) -> Column:
    """Tokens and the bigrams between them (joined by _), in the order t1, t1_t2, t2, t2_t3, t3, ..."""
    def after(t):
        before = F.concat(F.array(F.lit(None).cast("string")), t)
        pairs = F.zip_with(before, t, lambda b, x: F.when(x.isNull(), F.array().cast("array<string>")).when(b.isNull(), F.array(x)).otherwise(F.array(F.concat_ws("_", b, x), x)))
        return F.flatten(pairs)

    return bound(tokens(text), after)


def guard_code(text: Column) -> Column:
    """-9 for texts that are null, empty or longer than 10 MiB; else 0."""
    return F.when(text.isNull() | (F.octet_length(text) == 0) | (F.octet_length(text) > 10485760), -9).otherwise(0)


def sigmoid(x: Column) -> Column:
    """The tabulated logistic function: 0 up to -8, by symmetry above 0; NaN gives a half."""
    table = F.array(*(F.lit(v) for v in L.SIGMOID))

    def below(v):
        return F.when(v <= -8.0, 0.0).otherwise(F.element_at(table, F.least(F.lit(255), F.floor((v + 8.0) * 31.875)).cast("int") + 1))

    return F.when(F.isnan(x) | (x == 0), 0.5).when(x > 0, 1.0 - below(-x)).otherwise(below(x))
