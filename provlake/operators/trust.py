"""Lookups: trust of sources, groups of agents, capabilities of tools. A miss has a fixed default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.errors import ConfigError
from provlake.plans.policy import CAPABILITIES, FROM_UNTRUSTED, Policy
from provlake.schema import LABEL, RUN_ENTRY

def _map(pairs: dict[str, Column], key: Column, kind: str) -> Column:
    flat = [c for k, v in pairs.items() for c in (F.lit(k), v)]
    return F.element_at(F.create_map(*flat), key) if flat else F.lit(None).cast(kind)


#: A policy's table of more names than this would make a plan of unbearable size: rows are given their trust by a join.
LITERAL_ROWS = 5_000


def check_size(policy: Policy) -> Policy:
    """The policy, if its tables are small enough to be literals of the plan."""
    for what, table in (("sources", policy.sources), ("agents", policy.agents), ("sinks", policy.sinks)):
        if len(table) > LITERAL_ROWS:
            raise ConfigError(f"a policy of {len(table)} {what}: more than {LITERAL_ROWS} are no literals; join them (sources_by_join)")
    return policy


def source_trust(policy: Policy, name: Column) -> Column:
    """Trust of a source: untrusted unless declared."""
    return F.coalesce(_map({k: F.lit(v) for k, v in policy.sources.items()}, name, "string"), F.lit("untrusted"))


def is_untrusted(policy: Policy, name: Column) -> Column:
    """As source_trust(...) == 'untrusted', as a test against the trusted names only."""
    trusted = [k for k, v in policy.sources.items() if v == "trusted"]
    return ~F.coalesce(name.isin(trusted), F.lit(False)) if trusted else F.lit(True)


def sources_by_join(df: DataFrame, sources: DataFrame, column: str) -> DataFrame:
    """df with `trust`, for a source table of any size; Spark broadcasts it if it is small."""
    table = sources.groupBy("name").agg(F.max("trust").alias("__trust"))  # repeated names: untrusted wins
    joined = df.join(table, df[column] == table["name"], "left").drop(table["name"])
    return joined.withColumn("trust", F.coalesce("__trust", F.lit("untrusted"))).drop("__trust")


def agent_groups(policy: Policy, agent: Column) -> Column:
    """Sorted groups of an agent; none if it is not declared."""
    empty = F.array().cast("array<string>")
    known = {k: F.array(*[F.lit(g) for g in sorted(set(v))]) if v else empty for k, v in policy.agents.items()}
    return F.coalesce(_map(known, agent, "array<string>"), empty)


def tool_capabilities(policy: Policy, tool: Column) -> Column:
    empty = F.array().cast("array<string>")
    known = {k: F.array(*[F.lit(c) for c in s.capabilities]) for k, s in policy.sinks.items() if s.capabilities}
    return F.coalesce(_map(known, tool, "array<string>"), empty)


def tools_with(policy: Policy, capability: str) -> list[str]:
    return [k for k, s in policy.sinks.items() if capability in (s.capabilities or ())]


def label_is_untrusted(policy: Policy, label: Column) -> Column:
    """Any untrusted source in the lineage; the last hop's name does not count, and an empty lineage is trusted."""
    return F.coalesce(F.exists(label["lineage"], lambda s: is_untrusted(policy, s)), F.lit(False))


def resolve_labels(policy: Policy, labels: Column) -> Column:
    """What rules see of the labels: trust in place of the id."""

    def one(x: Column) -> Column:
        trust = F.when(label_is_untrusted(policy, x), F.lit("untrusted")).otherwise(F.lit("trusted"))
        return F.struct(
            x["source"].alias("source"),
            trust.alias("trust"),
            x["lineage"].alias("lineage"),
            x["ingested_by"].alias("ingested_by"),
            x["endorsements"].alias("endorsements"),
        )

    return F.transform(labels, one)


def all_sources(labels: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(labels, lambda x: x["lineage"])))


def untrusted_sources(policy: Policy, labels: Column) -> Column:
    return F.filter(all_sources(labels), lambda s: is_untrusted(policy, s))


def trifecta(capabilities: Column, any_untrusted: Column) -> Column:
    """The legs present, sorted."""
    extra = F.when(any_untrusted, F.array(F.lit(FROM_UNTRUSTED))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(capabilities, extra))


def no_labels() -> Column:
    return F.array().cast(f"array<{LABEL}>")


def no_entries() -> Column:
    return F.array().cast(f"array<{RUN_ENTRY}>")


__all__ = [
    "CAPABILITIES",
    "agent_groups",
    "all_sources",
    "is_untrusted",
    "label_is_untrusted",
    "resolve_labels",
    "source_trust",
    "sources_by_join",
    "tool_capabilities",
    "tools_with",
    "trifecta",
    "untrusted_sources",
]
