"""How the test tables are read as logs of agent activity. The mapping is a convention of this repository.

conversations: a run is a conversation, its place the turn; user turns are ingress, assistant turns calls whose argument
carries the label of the user turn before. events: a run is a user's day, its place the time in microseconds; errors are
ingress, the other types calls. lineitem: a run is an order, its place the line; returned lines are ingress, all lines
calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.functions import labels
from provlake.operators.trust import no_labels
from provlake.runtime import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(prefix: str, key: Column | str, n: int) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(prefix), (key % n).cast("string"))


def conversation_ingress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, seq, agent_id, source, text of user turns."""
    t = table(spark, sf_dir, "conversations").where("role = 'user'")
    return t.select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("run_id"),
        F.col("turn").alias("seq"),
        _name("agent-", F.col("conv_id") + F.col("turn"), 4).alias("agent_id"),
        _name("user_", F.col("conv_id") + F.col("turn"), 3).alias("source"),
        "text",
    )


def conversation_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as calls: tool by the conversation, the text as argument, the last user turn's label."""
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    calls = t.select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("run_id"),
        F.col("turn").alias("seq"),
        _name("agent-", "conv_id", 4).alias("agent_id"),
        _name("default.tool_", F.col("conv_id") + F.col("turn"), 4).alias("tool"),
        F.to_json(F.struct("text", F.col("turn").alias("turn"))).alias("args"),
        "conv_id",
    )
    before = conversation_ingress(spark, sf_dir).select(
        "run_id",
        (F.col("seq") + 1).alias("seq"),
        labels.fresh(F.col("source"), F.concat_ws("/", "run_id", F.col("seq").cast("string")), F.col("agent_id")).alias("__label"),
    )
    out = calls.join(before, ["run_id", "seq"], "left")
    return out.withColumn("labels", labels.present(F.col("__label"))).drop("__label")


def event_run(kind: str = "events") -> list[Column]:
    day = F.date_format("ts", "yyyy-MM-dd")
    return [
        F.concat_ws("/", F.col("user_id").cast("string"), day).alias("run_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"),
        _name("agent-", "user_id", 5).alias("agent_id"),
    ]


def event_ingress(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").where("event_type = 'error'")
    return t.select(*event_run(), _name("feed_", "event_id", 4).alias("source"))


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return t.select(
        "event_id",
        *event_run(),
        F.concat(F.lit("default."), F.col("event_type")).alias("tool"),
        F.col("props").alias("args"),
        no_labels().alias("labels"),
    )


def line_ingress(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return t.select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.col("l_linenumber").cast("long").alias("seq"),
        _name("agent-", "l_orderkey", 3).alias("agent_id"),
        _name("supplier_", "l_suppkey", 5).alias("source"),
    )


def line_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus")
    )
    args = F.to_json(
        F.struct(F.col("l_quantity").alias("quantity"), F.col("l_linestatus").alias("status"), F.col("l_partkey").alias("part"))
    )
    made = labels.fresh(
        _name("supplier_", "l_suppkey", 5),
        F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")),
        _name("agent-", "l_orderkey", 3),
    )
    return t.select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.col("l_linenumber").cast("long").alias("seq"),
        _name("agent-", "l_orderkey", 3).alias("agent_id"),
        _name("default.step_", "l_partkey", 4).alias("tool"),
        args.alias("args"),
        F.array(made).alias("labels"),
    )
