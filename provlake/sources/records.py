"""Record logs: JSON lines in and out, fan-out to several sinks, and the roll-ups of an inspection."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.operators import describe
from provlake.schema import RECORD

TYPES = ("event", "finding", "endorsement")
log = logging.getLogger("provlake")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines). Blank lines are skipped; a line that is no JSON object, of an unknown type or without what
    its type needs is bad. Older logs without trace ids are read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", RECORD + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select("value", parsed.alias("r"))
    r = F.col("r")
    sound = r.isNotNull() & r["_corrupt"].isNull() & r["record_type"].isin(*TYPES)
    needs = F.when(
        r["record_type"] == "event",
        r["decision"]["action"].isNotNull() & r["decision"]["tool"].isNotNull() & r["decision"][
            "run_ingress"
        ].isNotNull() & r["outcome"].isNotNull(),
    ).when(r[
        "record_type"
    ] == "finding", r["source"].isNotNull() & r["tool"].isNotNull() & r["argument"].isNotNull()).otherwise(r["kind"].isNotNull() & r["value_id"].isNotNull())
    good = F.coalesce(sound & needs, F.lit(False))
    return rows.where(good).select("r.*").drop("_corrupt"), rows.where(~good).select("value")


def as_lines(records: DataFrame) -> DataFrame:
    """One compact JSON object a row, record_type first, nulls left out."""
    first = ["record_type", *[c for c in records.columns if c != "record_type"]]
    return records.select(F.to_json(F.struct(*first)).alias("value"))


def write(records: DataFrame, path: str) -> None:
    """Append as JSON lines; the commit protocol publishes whole files only."""
    as_lines(records).write.mode("append").text(path)


def to_null(records: DataFrame) -> None:
    records.write.format("noop").mode("overwrite").save()


class InMemory:
    """A sink for tests: what it was given, split by type."""

    def __init__(self) -> None:
        self.rows: dict[str, list] = {t: [] for t in TYPES}

    def __call__(self, records: DataFrame) -> None:
        for row in records.collect():
            if row["record_type"] not in self.rows:
                raise TypeError(f"no record of type {row['record_type']!r}")
            self.rows[row["record_type"]].append(row)

    def clear(self) -> None:
        for rows in self.rows.values():
            rows.clear()


def to_log(records: DataFrame) -> None:
    """Summaries at DEBUG; only as many as are logged are brought to the driver."""
    if log.isEnabledFor(logging.DEBUG):
        r = F.struct(*[F.col(c) for c in records.columns])
        for row in records.select(describe.record(r).alias("s")).toLocalIterator():
            log.debug(row["s"])


class FanOut:
    """Several sinks over one batch, also as a foreachBatch callback. A sink that fails is logged and stops no other."""

    def __init__(self, *sinks: Callable[[DataFrame], None]):
        self.sinks = list(sinks)

    def add(self, sink: Callable[[DataFrame], None]) -> None:
        self.sinks.append(sink)

    def __call__(self, records: DataFrame, batch: int = 0) -> None:
        records = records.persist()
        try:
            for sink in tuple(self.sinks):
                try:
                    sink(records)
                except Exception:
                    log.exception("a record sink failed in batch %s", batch)
        finally:
            records.unpersist()


def run_of(r: Column) -> Column:
    return F.coalesce(r["decision"]["run_id"], r["run_id"])


def agent_of(r: Column) -> Column:
    return F.coalesce(r["decision"]["agent_id"], r["agent_id"])


def counts(records: DataFrame, run_id: str | None = None) -> DataFrame:
    """Records of each type for each run and agent, and for each run (agent_id NULL, level 'run')."""
    r = F.struct(*[F.col(c) for c in records.columns])
    rows = records.select(run_of(r).alias("run_id"), agent_of(r).alias("agent_id"), "record_type")
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    n = [F.count_if(F.col("record_type") == t).alias(f"n_{t}s") for t in TYPES]
    return rows.rollup("run_id", "agent_id").agg(F.grouping_id().alias("__g"), *n).where("__g < 3").select(
        "run_id",
        "agent_id",
        F.when(F.col("__g") == 1, "run").otherwise("agent").alias("level"),
        *[f"n_{t}s" for t in TYPES],
    )


def tree(records: DataFrame, run_id: str | None = None) -> DataFrame:
    """run_id, agent_id, timestamp and summary, in the order of an inspection."""
    r = F.struct(*[F.col(c) for c in records.columns])
    rows = records.select(run_of(r).alias("run_id"), agent_of(r).alias("agent_id"), "timestamp", describe.record(r).alias("summary"))
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    return rows.orderBy("run_id", "agent_id", "timestamp", "summary")
