"""Run state: what a call can see of its run so far.

Ingress counts if it came strictly before the call; capabilities count up to and including the call's own, whatever
the call's outcome. No window over a run is needed, so a run that holds a large part of all rows does not gather in one
task: the first time of each (run, source, agent) and of each (run, capability) are minima, combined on the map side;
what they leave is one row for each run, as long as the run has distinct sources and agents. It joins to the calls by
run, a join that adaptive execution can split, and each call keeps what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.operators import trust
from provlake.plans.policy import CAPABILITIES, Policy


def first_ingress(ingress: DataFrame) -> DataFrame:
    """(run_id, __seen): each run's distinct (source, agent) with the place of the first, in order. Ingress outside a run
    is dropped; an unnamed agent is the default one."""
    agent = F.coalesce("agent_id", F.lit("default"))
    firsts = ingress.where("run_id IS NOT NULL").groupBy("run_id", "source", agent.alias("agent_id")).agg(F.min("seq").alias("at"))
    return firsts.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("at", "source", "agent_id"))).alias("__seen"))


def first_capabilities(calls: DataFrame, policy: Policy, replayed: DataFrame | None = None) -> DataFrame:
    """(run_id, __first_<capability>): the place of the run's first call of a tool with the capability, or of the first
    envelope that brought it (replayed: run_id, seq, capability)."""
    rows = calls.where(calls["run_id"].isNotNull()).select("run_id", "seq", trust.tool_capabilities(policy, calls["tool"]).alias("__can"))
    if replayed is not None:
        # What an envelope brings counts for calls after it.
        more = replayed.where("run_id IS NOT NULL").select("run_id", F.col("seq") + 1, F.array("capability"))
        rows = rows.union(more)
    firsts = [F.min(F.when(F.array_contains("__can", c), F.col("seq"))).alias(f"__first_{c}") for c in CAPABILITIES]
    return rows.groupBy("run_id").agg(*firsts)


def entries(policy: Policy, seen: Column, seq: Column) -> Column:
    """The run's ingress before seq: an entry for each source in the order first seen, with its agents likewise."""
    before = F.filter(seen, lambda e: e["at"] < seq)
    sources = F.array_distinct(F.transform(before, lambda e: e["source"]))

    def one(s: Column) -> Column:
        agents = F.transform(F.filter(before, lambda e: e["source"].eqNullSafe(s)), lambda e: e["agent_id"])
        return F.struct(s.alias("source"), trust.source_trust(policy, s).alias("trust"), agents.alias("ingested_by"))

    return F.when(F.get(seen, F.lit(0))["at"] < seq, F.transform(sources, one)).otherwise(trust.no_entries())


def with_run_state(calls: DataFrame, ingress: DataFrame | None, policy: Policy, replayed: DataFrame | None = None) -> DataFrame:
    """calls with run_ingress, run_tainted, run_sources, run_untrusted_sources, run_ingested_by, run_capabilities and
    run_trifecta. A call outside any run sees no ingress and its own capabilities. replayed: capabilities that envelopes
    brought (see envelope.replay_capabilities)."""
    own = trust.tool_capabilities(policy, F.col("tool"))
    out = calls
    if ingress is not None:
        seen = first_ingress(ingress).withColumnRenamed("run_id", "__run")
        out = out.join(seen, out["run_id"] == seen["__run"], "left").drop("__run")
        out = out.withColumn("run_ingress", entries(policy, F.col("__seen"), F.col("seq"))).drop("__seen")
    else:
        out = out.withColumn("run_ingress", trust.no_entries())
    if replayed is not None or any(trust.tools_with(policy, c) for c in CAPABILITIES):
        firsts = first_capabilities(calls, policy, replayed).withColumnRenamed("run_id", "__run")
        out = out.join(firsts, out["run_id"] == firsts["__run"], "left").drop("__run")
        so_far = F.concat(
            *[
                F.when(
                    F.col(f"__first_{c}") <= F.col("seq"),
                    F.array(F.lit(c)),
                ).otherwise(F.array().cast("array<string>")) for c in CAPABILITIES
            ]
        )
        out = out.withColumn("run_capabilities", F.array_sort(F.array_union(so_far, own))).drop(*[f"__first_{c}" for c in CAPABILITIES])
    else:
        out = out.withColumn("run_capabilities", F.array().cast("array<string>"))
    return derived(out)


def derived(df: DataFrame) -> DataFrame:
    """The columns that follow from run_ingress and run_capabilities; batch and stream share them."""
    e = F.col("run_ingress")
    df = df.withColumn("run_tainted", F.exists(e, lambda x: x["trust"] == "untrusted"))
    df = df.withColumn("run_sources", F.transform(e, lambda x: x["source"]))
    df = df.withColumn("run_untrusted_sources", F.transform(F.filter(e, lambda x: x["trust"] == "untrusted"), lambda x: x["source"]))
    df = df.withColumn("run_ingested_by", F.array_distinct(F.flatten(F.transform(e, lambda x: x["ingested_by"]))))
    return df.withColumn("run_trifecta", trust.trifecta(F.col("run_capabilities"), F.col("run_tainted")))
