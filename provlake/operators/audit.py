"""The laundering audit: untrusted content that reaches a call without its label.

Content is registered from fresh ingress of an untrusted source, and from labeled arguments whose lineage is untrusted;
the latter count for their own call too. An unlabeled leaf of a call that contains registered content of its run is a
finding, once for each (run, source, tool, argument).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlake.functions import labels, nested
from provlake.operators import trust
from provlake.plans.policy import Policy
from provlake.runtime import checked_ids, written
from provlake.schema import AUDIT_LEAST, DEFAULT_DEPTH, SCHEMA_VERSION


def registered(ingress: DataFrame | None, leaves: DataFrame | None, policy: Policy) -> DataFrame:
    """(run_id, content, source, from_seq): content and the first place from which a call can launder it. Repeated
    content of a run is kept once, so that the join below meets each text once."""
    parts = []
    if ingress is not None:
        parts.append(
            ingress.where(
                F.col("run_id").isNotNull() & (F.length("text") >= AUDIT_LEAST) & trust.is_untrusted(policy, F.col("source"))
            ).select("run_id", F.col("text").alias("content"), "source", (F.col("seq") + 1).alias("from_seq"))
        )
    if leaves is not None:
        own = leaves.where(
            F.col("run_id").isNotNull() & F.col("label").isNotNull() & (
                F.length("text") >= AUDIT_LEAST
            ) & trust.label_is_untrusted(policy, F.col("label"))
        )
        parts.append(
            own.select("run_id", F.col("text").alias("content"), F.col("label.source").alias("source"), F.col("seq").alias("from_seq"))
        )
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.groupBy("run_id", "content", "source").agg(F.min("from_seq").alias("from_seq"))


def _windows(text: Column) -> Column:
    """Hashes of all runs of AUDIT_LEAST characters of a text, in one pass over it."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{AUDIT_LEAST}}}))"), F.lit(1)), lambda w: F.xxhash64(w))


def findings(leaves: DataFrame, policy: Policy, ingress: DataFrame | None = None, replayed: DataFrame | None = None) -> DataFrame:
    """run_id, source, tool, argument, seq (of the first) and agent_id of every finding.

    leaves: run_id, seq, agent_id, tool, argument, text and label (NULL: unlabeled) of every text argument leaf (see
    argument_leaves). replayed: labeled texts that envelopes brought (run_id, seq, text, label).

    A leaf that contains a content contains all its windows, the one of the least hash too. So the leaf's windows meet the
    contents' least ones by an equi-join; only pairs that do are compared as texts. No text travels with a window.
    """
    own = leaves if replayed is None else leaves.select("run_id", "seq", "text", "label").unionByName(
        replayed.select("run_id", "seq", "text", "label")
    )
    known = registered(ingress, own, policy).withColumnRenamed("run_id", "__run")
    known = known.withColumn("__key", F.array_min(_windows(F.col("content")))).withColumn(
        "__content",
        F.xxhash64("__run", "content", "source"),
    )
    known = written(known, "contents")
    keys = checked_ids(known.select("__run", "__key", "from_seq", "__content"))
    bare = leaves.where(
        F.col("label").isNull() & (F.length("text") >= AUDIT_LEAST)
    ).select("run_id", "seq", "agent_id", "tool", "argument", "text")
    bare = bare.withColumn("__leaf", F.xxhash64("run_id", "seq", "tool", "argument", "text"))
    seen = bare.select("__leaf", "run_id", "seq", F.explode(F.array_distinct(_windows(F.col("text")))).alias("__window"))
    met = seen.join(keys, (seen["run_id"] == keys["__run"]) & (seen["__window"] == keys["__key"]) & (keys["from_seq"] <= seen["seq"]))
    met = met.select("__leaf", "__content").distinct()
    # Two leaves or contents of one hash only add pairs that the texts then refute.
    hits = bare.join(met, "__leaf").join(known.drop("__key"), "__content")
    hits = hits.where((F.col("run_id") == F.col("__run")) & (F.col("from_seq") <= F.col("seq")) & F.contains("text", "content"))
    return hits.groupBy("run_id", "source", "tool", "argument").agg(
        F.min("seq").alias("seq"),
        F.min_by("agent_id", "seq").alias("agent_id"),
    )


def argument_leaves(calls: DataFrame, depth: int = DEFAULT_DEPTH) -> DataFrame:
    """The text leaves of every call's arguments, for findings: run_id, seq, agent_id, tool, argument (the name of the
    argument), path, text and label.

    calls: run_id, seq, agent_id, tool, args (VARIANT or JSON text) and, where there are any, leaf_labels
    ARRAY<STRUCT<path, label>>, by the same paths."""
    args = F.try_parse_json("args") if isinstance(calls.schema["args"].dataType, T.StringType) else F.col("args")
    rows = calls.select(
        "run_id",
        "seq",
        "agent_id",
        "tool",
        args.alias("__args"),
        *(["leaf_labels"] if "leaf_labels" in calls.columns else []),
    )
    rows = rows.select("*", F.explode(F.try_variant_get("__args", "$", "map<string,variant>")).alias("argument", "__v")).drop("__args")
    rows = nested.with_leaves(rows, "__v", "__leaves", depth).withColumn("__leaf", F.explode("__leaves"))
    rows = rows.withColumn("path", F.concat(F.lit("$"), nested.path_step(F.col("argument")), F.substring("__leaf.path", 2, 1 << 30)))
    label = labels.none()
    if "leaf_labels" in calls.columns:
        label = F.get(F.filter("leaf_labels", lambda x: x["path"] == F.col("path")), F.lit(0))["label"]
    return rows.select("run_id", "seq", "agent_id", "tool", "argument", "path", F.col("__leaf.text").alias("text"), label.alias("label"))


def newest(found: DataFrame, n: int = 10_000) -> DataFrame:
    """The findings kept by a bounded registry: the newest n."""
    return found.orderBy(F.desc("seq"), "run_id", "source", "tool", "argument").limit(n)


def records(found: DataFrame, fingerprint: str | None = None) -> DataFrame:
    return found.select(
        F.lit("finding").alias("record_type"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(fingerprint).cast("string").alias("policy_fingerprint"),
        "source",
        "tool",
        "argument",
        "agent_id",
        "run_id",
        F.lit(None).cast("string").alias("session_id"),
    )
