"""Operator 7: near-duplicate documents by MinHash.

Method: the minima of many universal hash functions over each document's set of word shingles; banding for candidates;
signatures tested first, then the links confirmed on full sets; connected components by alternating large-star and
small-star.

No pairs of a bucket are emitted. Documents of equal sets collapse to their least id before banding. Each bucket first
links its members to its least member only. Components of the confirmed links follow; a bucket whose members are then
all in one component can add nothing. Any other bucket is worked off in tiles of bounded size: the members outside its
largest component meet that component tile by tile, and each other, by their signatures alone. Texts go only to the
tiles in which a member's signature agrees with one of another component; there, one confirmed link for each member and
component is returned, which is all that connectivity needs. So no link between candidates of different components is
lost, whatever the size of the bucket. Bands are as many as make a pair at the threshold miss all of them with a
probability below MISSED.

Documents without words, or null, have an empty set and are linked with nothing: each is its own component. A document
is known by its id: rows that repeat an id are one node, unless near_duplicates is told to keep them `apart`. A row whose
id is null is linked with nothing (its component_id is null and it is kept). Ties: the least id stands for its
component. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlake.llm.components import components
from provlake.llm.shingles import mix, shared, shingle_set
from provlake.runtime import BROADCAST_IDS, bounded_batches, ship, written

ROWS = 5
#: The chance, at most, that no band holds a pair whose similarity is at the threshold.
MISSED = 3e-6
TILE = 256
#: A pair is confirmed on full sets if its signatures agree to within so many standard deviations of the threshold.
DEVIATIONS = 5.0
SEED = 20240607


def bands(percent: int) -> int:
    return math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** ROWS)) if percent < 100 else 1


@cache
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(SEED)
    odd = rnd.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rnd.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """The minima of n universal hash functions."""
    a, b = _hashes(n)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[k : k + 2048, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def sketch_udf(words: int, n: int):
    @F.pandas_udf("n long, fp binary, sig binary")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                h = shingle_set(text, words)
                fp = np.array([len(h), mix(h).sum(), mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64)
                rows.append((len(h), fp.tobytes(), signature(h, n).tobytes()))
            yield pd.DataFrame(rows, columns=["n", "fp", "sig"])

    return sketch


@F.pandas_udf(T.ArrayType(T.LongType()))
def band_keys(sigs: pd.Series) -> pd.Series:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    if not len(sigs):
        return pd.Series([], dtype=object)
    rows = np.frombuffer(b"".join(sigs), np.uint32).reshape(len(sigs), -1, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, rows.shape[1] + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return pd.Series(list(key.astype(np.int64)))


def least_agreement(percent: int) -> int:
    """Hash functions of the signature that must agree for a pair to be confirmed on full sets."""
    s, n = percent / 100, bands(percent) * ROWS
    return max(1, int(np.floor(n * (s - DEVIATIONS * (s * (1 - s) / n) ** 0.5))))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = shared(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(words: int, percent: int):
    @F.pandas_udf("boolean")
    def confirm(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        recent: OrderedDict[str, np.ndarray] = OrderedDict()

        def of(text: str) -> np.ndarray:
            if text not in recent:
                recent[text] = shingle_set(text, words)
                if len(recent) > 32:
                    recent.popitem(last=False)
            return recent[text]

        for left, right in batches:
            yield pd.Series([linked(of(x), shingle_set(y, words), percent) for x, y in zip(left, right)], dtype=bool)

    return confirm


def _agree(least: int):
    @F.pandas_udf("boolean")
    def agree(left: pd.Series, right: pd.Series) -> pd.Series:
        if not len(left):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(x), np.uint32).reshape(len(x), -1) for x in (left, right))
        return pd.Series((a == b).sum(axis=1) >= least)

    return agree


def _near(rows: pd.DataFrame, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each row on side o of a tile, the rows of other components whose signatures agree, the likeliest first."""
    sigs = np.frombuffer(b"".join(rows["sig"]), np.uint32).reshape(len(rows), -1)
    comps, sides = rows["comp"].to_numpy(), rows["side"].to_numpy()
    for i in np.flatnonzero(sides == "o"):
        same = (sigs == sigs[i]).sum(axis=1)
        near = np.flatnonzero((same >= least) & (comps != comps[i]))
        if len(near):
            yield i, near[np.argsort(-same[near], kind="stable")]


def _tile_members(least: int):
    def members(rows: pd.DataFrame) -> pd.DataFrame:
        """The members of a tile whose signatures agree with one of another component there."""
        some = np.zeros(len(rows), bool)
        for i, near in _near(rows, least):
            some[i] = some[near] = True
        return rows.loc[some, ["key", "a", "b", "doc"]]

    return members


def _tile_links(words: int, percent: int, least: int):
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        """One confirmed link for each member on side o and component met, among the rows of one tile."""
        ids, comps, texts = rows["doc"].to_numpy(), rows["comp"].to_numpy(), rows["text"].to_list()
        sets: dict[int, np.ndarray] = {}
        found = []
        for i, near in _near(rows, least):
            met: set = set()
            for j in near:
                if comps[j] not in met:
                    for k in (i, j):
                        if k not in sets:
                            sets[k] = shingle_set(texts[k], words)
                    if linked(sets[i], sets[j], percent):
                        met.add(comps[j])
                        found.append((ids[i], ids[j]))
        return pd.DataFrame(found, columns=["u", "v"])

    return links


def _mixed_buckets(members: DataFrame, labels: DataFrame, sigs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links between members of one bucket that are in different components."""
    kind, least = members.schema["doc"].dataType.simpleString(), least_agreement(percent)
    known = members.join(labels, members["doc"] == labels["node"], "left").select(
        "key",
        "doc",
        F.coalesce("component", "doc").alias("comp"),
    )
    sizes = known.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("g"), F.count("*").alias("parts"))
    mixed = mixed.where("parts > 1 AND g > 2")  # of two members, the one pair has been tested with the star
    t, o = F.ceil(F.col("top.n") / TILE).cast("int"), F.ceil((F.col("g") - F.col("top.n")) / TILE).cast("int")
    mixed = written(mixed.select("key", F.col("top.comp").alias("main"), t.alias("t"), o.alias("o")), "mixed")
    rows = known.join(mixed, "key").join(sigs.withColumnRenamed("node", "doc"), "doc")
    is_main = F.col("comp") == F.col("main")
    own = F.pmod(F.xxhash64("doc"), F.when(is_main, F.col("t")).otherwise(F.col("o"))).cast("int")
    rows = rows.select("key", "doc", "comp", "sig", "t", "o", is_main.alias("is_main"), own.alias("own"))
    side = F.when(F.col("is_main"), F.lit("d")).otherwise(F.lit("o"))
    # Tile (a, b): part a of the largest component with part b of the others; a < 0: parts -1 - a and b of the others.
    each = {c: F.sequence(F.lit(0), F.col(c) - 1) for c in "ot"}
    with_main = F.when(F.col("is_main"), F.transform(each["o"], lambda b: F.struct(F.col("own").alias("a"), b.alias("b"))))
    with_main = with_main.otherwise(F.transform(each["t"], lambda a: F.struct(a.alias("a"), F.col("own").alias("b"))))
    pair = F.transform(
        each["o"],
        lambda b: F.struct((F.lit(-1) - F.least(b, F.col("own"))).alias("a"), F.greatest(b, F.col("own")).alias("b")),
    )
    with_others = F.when(~F.col("is_main"), pair).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    tiles = rows.select("key", "doc", "comp", "sig", side.alias("side"), F.explode(F.concat(with_main, with_others)).alias("tile"))
    tiles = tiles.select("key", "tile.a", "tile.b", "doc", "comp", "sig", "side")
    found = tiles.groupBy("key", "a", "b").applyInPandas(_tile_members(least), f"key long, a int, b int, doc {kind}")
    some = written(found, "agreeing")
    # Only now the texts, and only to the tiles where they are compared.
    full = tiles.join(some, ["key", "a", "b", "doc"], "left_semi").join(texts.select(F.col("node").alias("doc"), "text"), "doc")
    return full.groupBy("key", "a", "b").applyInPandas(_tile_links(words, percent, least), f"u {kind}, v {kind}")


def _checked(keys: DataFrame) -> DataFrame:
    """A written table of short rows, marked for broadcast if it is counted to be small enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys


def _repeated(rows: DataFrame, *cols: str) -> bool:
    return not rows.groupBy(*cols).agg(F.count("*").alias("c")).where("c > 1").isEmpty()


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 85,
    apart: bool = False,
) -> DataFrame:
    """id, n_shingles, component_id and kept for every row. percent: documents link if 100 |A and B| >= percent |A or B|.

    apart: rows that repeat an id and have different sets are documents of their own. Then text_hash (xxhash64 of the
    text), set_id (of the set) and least come too; least: this row's set is the one of the least id of its component
    (and of the least set_id, where such rows share that id).
    """
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)
    docs = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    least = least_agreement(percent)
    sketched = docs.select("id", F.xxhash64("text").alias("text_hash"), sketch_udf(words, bands(percent) * ROWS)("text").alias("s"))
    sketched = written(sketched.select("id", "text_hash", "s.*"), "sketch")
    full = sketched.where("id IS NOT NULL AND n > 0")
    repeats = _repeated(full, "id")
    by_set = repeats and _repeated(full.select("id", "fp").distinct(), "id")
    # Where one id has several sets each of these is a node, a text in the order of the ids; else the id is the node.
    node = F.col("id")
    if by_set:
        node = F.concat(
            F.lpad((F.col("id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0"),
            F.lit("|"),
            F.hex("fp"),
        )
    sketched = sketched.withColumn("node", F.when(F.col("id").isNotNull() & (F.col("n") > 0), node))
    full = sketched.where("node IS NOT NULL")
    reps = written(full.groupBy("fp").agg(F.min("node").alias("rep"), F.first("sig").alias("sig")), "reps")
    copies = full.select("node", "fp").join(reps.select("fp", "rep"), "fp").select(
        F.col("node").alias("u"),
        F.col("rep").alias("v"),
    ).where("u != v")

    if by_set and not apart:
        one = full.groupBy("id").agg(F.min("node").alias("v"))
        copies = copies.unionByName(full.join(one, "id").select(F.col("node").alias("u"), "v").where("u != v"))

    banded = reps.select(F.col("rep").alias("doc"), F.explode(band_keys("sig")).alias("key"))
    buckets = banded.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("last")).where("hub != last")
    members = written(banded.join(written(buckets.select("key", "hub"), "buckets"), "key"), "members")
    pairs = members.where("doc != hub").select("hub", "doc").distinct()
    sigs = reps.select(F.col("rep").alias("node"), "sig")
    signed = pairs.join(
        sigs.withColumnsRenamed({"node": "hub", "sig": "s1"}),
        "hub",
    ).join(sigs.withColumnsRenamed({"node": "doc", "sig": "s2"}), "doc")
    likely = written(signed.where(_agree(least)("s1", "s2")).select("hub", "doc"), "likely")

    # Texts of documents that share a bucket with another, for the exact tests.
    wanted = members.select(F.col("doc").alias("node")).distinct()
    if by_set:
        keys = written(full.select("id", "text_hash", "node").join(wanted, "node").distinct(), "wanted")
        texts = docs.withColumn("text_hash", F.xxhash64("text")).join(_checked(keys), ["id", "text_hash"]).select("node", "text")
    else:
        texts = docs.withColumnRenamed("id", "node").join(_checked(written(wanted, "wanted")), "node")
    texts = written(texts.dropDuplicates(["node"]) if repeats else texts, "texts")
    hubs = texts.select(F.col("node").alias("hub"), F.col("text").alias("t1"))
    others = texts.select(F.col("node").alias("doc"), F.col("text").alias("t2"))
    sure = likely.join(others, "doc").join(hubs, "hub").where(_confirm(words, percent)("t1", "t2"))
    first = written(copies.unionByName(sure.select(F.col("hub").alias("u"), F.col("doc").alias("v"))), "links")

    labels = written(components(first), "labels")
    more = written(_mixed_buckets(members.select("key", "doc"), labels, sigs, texts, words, percent), "more")
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    labels = labels.withColumnRenamed("node", "__node")
    out = sketched.join(labels, F.col("node") == F.col("__node"), "left")
    top = F.coalesce("component", "node")
    of_top = (F.substring(top, 1, 20).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long") if by_set else top
    component = F.coalesce(of_top, F.col("id"))
    kept = F.col("id").isNull() | (component == F.col("id"))
    more_columns = ["text_hash", F.hex("fp").alias("set_id"), F.coalesce(top == F.col("node"), F.lit(True)).alias("least")] if apart else []
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        kept.alias("kept"),
        *more_columns,
    )
