"""Operator 2: mixing sources to target weights by Poisson replication, in DataFrame functions only.

Method: each source's mean repetition rate is what brings its share of the corpus to its target weight. A document's
number of copies inverts the Poisson distribution of that mean at a uniform number hashed from the seed and its id, so
a rerun or a retried task gives the same copies. A mean above PART is split into equal parts, each drawn with a uniform
number of its own: sums of Poisson counts are Poisson, so no mean is too large. Documents are exploded by their count
and shuffled globally: rows are dealt to partitions by a hash of (seed, id, copy) and sorted by it.

A null source is a source of its own. A null or empty text counts 0 characters but is kept as any other. A source whose
texts hold no characters can have no share of the characters: its rows are repeated `epochs` times on average, unless
weights are given and leave it out. Rows that repeat an id get the same number of copies each. With no rows nothing is
returned. Other columns are carried along unchanged. More than 2^31 - 1 copies of one row are an overflow error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many sources their table is broadcast: each has a cumulative distribution of at most some 1,400 numbers.
BROADCAST_SOURCES = 2_000
#: Beyond it the table is joined by source and salt, so that a hot source is dealt to so many tasks.
SALTS = 64
#: The largest mean of one draw: it bounds the cumulative distribution, not the rate.
PART = 1_000.0
#: Copies are listed in blocks of so many, so that no array grows with the rate.
BLOCK = 1 << 14


def uniform(seed: int, *parts: Column) -> Column:
    """A number strictly between 0 and 1 from 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until what is left is far below 2^-53."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("logp"), F.exp(-rate).alias("cdf"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        logp = acc["logp"] + F.ln(rate) - F.ln(k.cast("double"))
        cdf = acc["cdf"] + F.exp(logp)
        return F.struct(logp.alias("logp"), cdf.alias("cdf"), F.concat(acc["all"], F.array(cdf)).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])).otherwise(F.array(F.lit(1.0)))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    tau: float = 0.5,
    epochs: float = 1.0,
    seed: int = 17,
) -> DataFrame:
    """The rows of df as often as drawn, in global random order, as (row STRUCT<all columns>, copy, n_copies, rate, shuffle_key).

    weights: target share of each source, in characters; sources without one get none. None: shares follow the
    source's characters to the power tau (1: as they are; 0: equal). epochs: expected characters out over characters in.
    """
    size = F.length(F.coalesce(df[text_col], F.lit("")))
    sources = df.groupBy(df[source_col].alias("__source")).agg(F.sum(size).cast("double").alias("__size"))
    if weights is None:
        wanted = F.when(F.col("__size") > 0, F.pow("__size", F.lit(float(tau)))).otherwise(F.lit(1.0))
    else:
        pairs = [x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]
        wanted = F.coalesce(F.create_map(*pairs)[F.col("__source")], F.lit(0.0)) if pairs else F.lit(0.0)
    sources = sources.withColumn("__wanted", wanted)
    held = F.col("__size") > 0
    n, total, share, weight = sources.agg(F.count("*"), F.sum("__size"), F.sum(F.when(held, F.col("__wanted"))), F.sum("__wanted")).first()
    if n and not weight:
        raise ValueError("no source has a weight")
    scale = (total or 0.0) * epochs / (share or 1.0)
    without = F.when(F.col("__wanted") > 0, F.lit(float(epochs))).otherwise(F.lit(0.0))
    rate = F.when(held, F.col("__wanted") / F.col("__size") * scale).otherwise(without)
    table = sources.withColumn("__rate", rate).withColumn("__parts", F.greatest(F.ceil(F.col("__rate") / PART), F.lit(1)))
    table = table.select("__source", "__rate", "__parts", poisson_cdf(F.col("__rate") / F.col("__parts")).alias("__cdf"))
    docs = df.select(
        F.struct(*[df[c] for c in df.columns]).alias("row"),
        df[source_col].alias("__key"),
        uniform(seed, df[id_col]).alias("__u"),
        df[id_col].alias("__id"),
    )
    if n <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(table), F.col("__key").eqNullSafe(F.col("__source")))
    else:
        salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = docs.withColumn("__own", F.pmod(F.xxhash64("__id", "__u"), F.lit(SALTS)).cast("int"))
        joined = docs.join(salted, F.col("__key").eqNullSafe(F.col("__source")) & (F.col("__own") == F.col("__salt")))

    def drawn_at(u: Column) -> Column:
        return F.size(F.filter("__cdf", lambda c: c < u))

    others = F.transform(F.sequence(F.lit(1).cast("long"), F.col("__parts") - 1), lambda k: uniform(seed, F.col("__id"), F.lit("part"), k))
    more = F.aggregate(others, F.lit(0).cast("long"), lambda acc, u: acc + drawn_at(u))
    copies = drawn_at(F.col("__u")) + F.when(F.col("__parts") > 1, more).otherwise(F.lit(0).cast("long")).cast("int")
    drawn = joined.withColumn("n_copies", copies).where("n_copies > 0")
    drawn = drawn.withColumn("__block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_copies") - 1) / BLOCK).cast("int"))))
    low = F.col("__block") * BLOCK
    drawn = drawn.withColumn("copy", F.explode(F.sequence(low, low + F.least(F.lit(BLOCK) - 1, F.col("n_copies") - 1 - low))))
    drawn = drawn.withColumn("shuffle_key", (uniform(seed + 1, F.col("__id"), F.col("copy")) * float(1 << 52)).cast("long"))
    out = drawn.select("row", "copy", "n_copies", F.col("__rate").alias("rate"), "shuffle_key")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")
