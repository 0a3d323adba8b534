"""Operator 9: best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

Method: best-fit decreasing with a segment tree over remaining capacities. Lengths are whole numbers up to the
capacity, so the order of best-fit decreasing depends only on how many pieces have each length: the driver collects
that histogram (at most `capacity` rows, whatever the corpus) and packs it. Open bins are kept as ranges of bin numbers
that have the same room; the tree finds the tightest room that still fits in logarithmic time. Placing n equal pieces
uses up whole ranges and splits at most one, so at most a few rows for each length describe the whole packing. They
are broadcast, and each piece finds its bin by its rank among the pieces of its length, counted in buckets so that no
length gathers in one task.

A null or empty text is one piece that holds the end id alone. Repeated rows are packed each. Rows whose id is null
are packed too. Columns beside the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlake.llm import bpe
from provlake.runtime import ship, bounded_batches, written

RUNS = T.StructType([T.StructField(c, T.LongType(), False) for c in ("length", "run_from", "run_to", "first_bin", "in_bin", "filled")])


class Rooms:
    """A segment tree over the capacities 0..capacity that tells the smallest one, from s up, that has open bins."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.base)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int) -> None:
        k = room + self.base
        self.any[k] = bool(self.bins[room])
        while k > 1:
            k //= 2
            self.any[k] = self.any[2 * k] | self.any[2 * k + 1]

    def push(self, room: int, first: int, n: int) -> None:
        if n and room:
            self.bins[room].append((first, n))
            self._mark(room)

    def pop(self, room: int) -> tuple[int, int]:
        got = self.bins[room].pop()
        self._mark(room)
        return got

    def tightest(self, least: int) -> int | None:
        k = least + self.base
        if self.any[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                while k < self.base:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.base
            k //= 2
        return None


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], int]:
    """The rows of RUNS and the number of bins. Piece j of a length, run_from <= j < run_to, goes to bin
    first_bin + (j - run_from) // in_bin, as number (j - run_from) % in_bin after what fills the bin so far."""
    rooms, runs, bins = Rooms(capacity), [], 0
    for size in sorted(histogram, reverse=True):
        done, n = 0, histogram[size]
        while done < n:
            room = rooms.tightest(size)
            if room is None:
                room, each = capacity, capacity // size
                first, count = bins, -(-(n - done) // each)
                bins += count
            else:
                first, count = rooms.pop(room)
            each = room // size
            take = min(n - done, count * each)
            whole, rest = divmod(take, each)
            runs.append((size, done, done + take, first, each, capacity - room))
            rooms.push(room - each * size, first, whole)
            if rest:
                rooms.push(room - rest * size, first + whole, 1)
            rooms.push(room, first + whole + bool(rest), count - whole - bool(rest))
            done += take
    return runs, bins


def pieces_of(df: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of at most `capacity`; only the first may be shorter."""
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)
    end = end_id.to_bytes(4, "little")

    def every(batches: Iterator[pd.Series]) -> Iterator[list[bytes]]:
        encoder = bpe.ranked(tokenizer)
        for texts in batches:
            yield [encoder.ids(t or "") + end for t in texts]

    @F.pandas_udf("binary")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in every(batches):
            yield pd.Series(ids, dtype=object)

    @F.pandas_udf("array<bigint>")
    def marks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """The number of ids, then the CRC of each piece."""
        for batch in every(batches):
            out = []
            for ids in batch:
                first = (len(ids) // 4 % capacity or capacity) * 4
                cuts = [0, *range(first, len(ids) + 1, 4 * capacity)]
                out.append([len(ids) // 4, *[zlib.crc32(ids[x:y]) for x, y in zip(cuts, cuts[1:])]])
            yield pd.Series(out, dtype=object)

    got = df.select(df[id_col].alias(id_col), (whole if with_ids else marks)(df[text_col]).alias("__got"))
    n = (F.octet_length("__got") / 4).cast("long") if with_ids else F.col("__got")[0]
    first = F.when(n % capacity == 0, F.lit(capacity)).otherwise(n % capacity).cast("long")
    last = ((n + capacity - 1) / capacity).cast("int") - 1
    out = got.withColumn("__first", first).select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("__first") + (F.col("piece") - 1) * capacity).cast("long")
    length = F.when(F.col("piece") == 0, F.col("__first")).otherwise(F.lit(capacity)).cast("long")
    part = F.substring(F.col("__got"), (start * 4 + 1).cast("int"), (length * 4).cast("int")) if with_ids else None
    crc = F.crc32(part) if with_ids else F.get(F.col("__got"), F.col("piece") + 1)
    return out.select(
        id_col,
        "piece",
        start.alias("start"),
        length.alias("length"),
        crc.alias("ids_crc32"),
        *([part.alias("ids")] if with_ids else []),
    )


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    capacity: int = 2048,
    end_id: int = 0,
    with_ids: bool = False,
    buckets: int = 64,
) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id and offset of every piece (with_ids: its ids too, as bytes).

    buckets: into so many parts, at least, the pieces of one length are dealt for counting; more on large corpora.
    """
    spark = df.sparkSession
    cut = written(pieces_of(df, id_col, text_col, tokenizer, capacity, end_id, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = best_fit(histogram, capacity)
    buckets = max(buckets, sum(histogram.values()) // 1_000_000)
    dealt = cut.withColumn("__bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "__bucket").agg(F.count("*").alias("__n")).select(
        "length",
        "__bucket",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    own = Window.partitionBy("length", "__bucket").orderBy(id_col, "piece", "ids_crc32")
    ranked = dealt.withColumn("__rank", F.row_number().over(own)).join(sizes, ["length", "__bucket"])
    ranked = ranked.withColumn("__j", F.col("__before") + F.col("__rank") - 1)
    # At most a few rows for each length up to the capacity: a proven bound.
    table = spark.createDataFrame(runs, RUNS).withColumnRenamed("length", "__length")
    at = F.col("__j") - F.col("run_from")
    placed = ranked.join(
        F.broadcast(table),
        (F.col("length") == F.col("__length")) & (F.col("__j") >= F.col("run_from")) & (F.col("__j") < F.col("run_to")),
    )
    return placed.select(
        id_col,
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_bin") + F.floor(at / F.col("in_bin"))).cast("long").alias("sequence_id"),
        (F.col("filled") + at % F.col("in_bin") * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
