"""What the two vector searches share: clean vectors, an index written once by shard, blocks of queries, the best of all.

The index is built once: the rows are dealt evenly to shards of bounded size, and each shard becomes one row of a written
table that holds what the search needs of it (sorted arrays, pivot distances). The queries, a set stated by the caller,
become blocks of bounded size. One job then brings every block to every shard: a shard's row comes first, the blocks
after it, one by one, so that a task holds one shard and one block at a time and loads a shard once for all blocks. Each
shard returns its best k for each query; the best k of those are the result. Nothing is broadcast or collected.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provlake.runtime import bounded_batches, ship, written

#: The most queries of a block, about, and the most vectors of a shard.
QUERIES = 4096
SHARD = 8192
#: Shards are made smaller than that, down to so many vectors, while there are fewer of them than cores.
LEAST_SHARD = 1024


def clean(df: DataFrame, id_col: str, vec_col: str, zeros: bool) -> DataFrame:
    """(id, v) of the rows that take part: no null or non-finite component, the commonest length, a zero vector if wanted."""
    v = df[vec_col].cast("array<double>")
    whole = df[id_col].isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zeros:
        whole = whole & F.exists(v, lambda x: x != 0)
    rows = df.where(F.coalesce(whole, F.lit(False))).select(df[id_col].cast("long").alias("id"), v.alias("v"))
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(payload: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(payload)) as held:
        return {name: held[name] for name in held.files}


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def index(rows: DataFrame, make: Callable[[np.ndarray, np.ndarray], bytes]) -> tuple[DataFrame, int]:
    """(shard, payload) of every shard, written, and the number of shards. make(ids, vectors) gives the payload."""
    spark = rows.sparkSession
    n = rows.count()
    shards = max(1, -(-n // SHARD), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_SHARD)))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        parts = [(b["id"].to_numpy(np.int64), _matrix(b["v"])) for b in batches if len(b)]
        if parts:
            ids, vectors = (np.concatenate(x) for x in zip(*parts))
            yield pd.DataFrame({"shard": [TaskContext.get().partitionId()], "payload": [make(ids, vectors)]})

    # Dealt in turn: every shard has its share, whatever the ids.
    return written(rows.repartition(shards).mapInPandas(build, "shard int, payload binary"), "index"), shards


def query_blocks(rows: DataFrame, is_query: Column) -> DataFrame:
    """(block, payload) of the queries, written. Rows that repeat a query's id are one query."""
    asked = written(rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n = asked.count()
    blocks = -(-2 * n // QUERIES) if n > QUERIES else 1

    def build(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("id")
        payload = packed(ids=batch["id"].to_numpy(np.int64), rows=_matrix(batch["v"]))
        return pd.DataFrame({"block": [int(batch["block"].iloc[0])], "payload": [payload]})

    numbered = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return written(numbered.groupBy("block").applyInPandas(build, "block int, payload binary"), "blocks")


def search(rows: DataFrame, is_query: Column, k: int, make: Callable, best_in: Callable, schema: str, order: list[Column]) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best. make(ids, vectors) is a shard's payload; best_in(shard,
    query ids, query vectors) gives rows of the schema, which starts with query_id, vec_id and score."""
    ship(rows.sparkSession)
    bounded_batches(rows.sparkSession)
    shards, n = index(rows, make)
    blocks = query_blocks(rows, is_query)
    each = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("shard", "block", "payload")
    stream = shards.select("shard", F.lit(-1).alias("block"), "payload").unionByName(each)
    stream = stream.repartition(n, "shard").sortWithinPartitions("shard", "block")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None
        for batch in batches:
            for shard, block, payload in zip(batch["shard"], batch["block"], batch["payload"]):
                if block < 0:
                    at, held = shard, unpacked(payload)
                elif at == shard:
                    asked = unpacked(payload)
                    yield best_in(held, asked["ids"], asked["rows"])

    found = stream.mapInPandas(find, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k least scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, k - 1)[k - 1]
        near = np.flatnonzero(scores <= edge)
        return near[np.lexsort((ids[near], scores[near]))[:k]]
    return np.lexsort((ids, scores))[:k]
