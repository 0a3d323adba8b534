"""The label algebra: a label is a struct column beside a value; NULL means unlabeled.

Ids are hashes of what makes the label, so that a retried task gives the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provlake.functions.names import DEFAULT_AGENT, check_kind
from provlake.schema import LABEL


def _texts(*cols: Column) -> Column:
    return F.array(*cols) if cols else F.array().cast("array<string>")


def _make(source: Column, value_id: Column, lineage: Column, ingested_by: Column, endorsements: Column) -> Column:
    return F.struct(
        source.alias("source"),
        value_id.alias("value_id"),
        lineage.alias("lineage"),
        ingested_by.alias("ingested_by"),
        endorsements.alias("endorsements"),
    ).cast(LABEL)


def _id(*parts: Column | str) -> Column:
    return F.sha2(
        F.concat_ws("\x1f", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]),
        256,
    )


def none() -> Column:
    """No label: what operations that lose the label give."""
    return F.lit(None).cast(LABEL)


def fresh(source: Column | str, key: Column, agent: Column | None = None) -> Column:
    """The label of a value that enters from a source; key tells values apart."""
    source = F.lit(source) if isinstance(source, str) else source
    agent = F.coalesce(agent if agent is not None else F.lit(None).cast("string"), F.lit(DEFAULT_AGENT))
    return _make(source, _id("fresh", source, key), _texts(source), _texts(agent), _texts())


def _union(labels: Column, field: str) -> Column:
    """Distinct values of the labels' lists, in the order of first contribution."""
    return F.array_distinct(F.flatten(F.transform(labels, lambda x: x[field])))


def present(*labels: Column) -> Column:
    return F.filter(F.array(*labels), lambda x: x.isNotNull())


def merge_all(labels: Column) -> Column:
    """One label for a value made of several: the first's source, united lineage and agents, common endorsements. A
    single label stays as it is, with its id; none gives none."""
    labels = F.filter(labels, lambda x: x.isNotNull())
    common = F.aggregate(
        F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))),
        F.get(labels, F.lit(0))["endorsements"],
        lambda acc, x: F.array_intersect(acc, x["endorsements"]),
    )
    ids = F.array_join(F.transform(labels, lambda x: x["value_id"]), ",")
    merged = _make(F.get(labels, F.lit(0))["source"], _id("merge", ids), _union(labels, "lineage"), _union(labels, "ingested_by"), common)
    return F.when(F.size(labels) == 1, F.get(labels, F.lit(0))).when(F.size(labels) > 1, merged)


def merge(*labels: Column) -> Column:
    return merge_all(F.array(*labels)) if len(labels) > 1 else labels[0]


def derive(hop: str, labels: Column, key: Column, agent: Column | None = None) -> Column:
    """The label of a value derived from labeled inputs: united lineage, the current agent added, endorsements gone.
    Without labeled inputs the value is unlabeled. Deriving is no ingress."""
    labels = F.filter(labels, lambda x: x.isNotNull())
    agent = F.coalesce(agent if agent is not None else F.lit(None).cast("string"), F.lit(DEFAULT_AGENT))
    ids = F.array_join(F.transform(labels, lambda x: x["value_id"]), ",")
    made = _make(
        F.lit(hop),
        _id("derive", hop, ids, key),
        _union(labels, "lineage"),
        F.array_union(_union(labels, "ingested_by"), _texts(agent)),
        _texts(),
    )
    return F.when(F.size(labels) > 0, made)


def track_model_call(inputs: list[Column], key: Column, agent: Column | None = None, source: str = "model") -> Column:
    """The label of a model's output, derived from the labels of its inputs."""
    return derive(source, F.array(*inputs) if inputs else F.array().cast(f"array<{LABEL}>"), key, agent)


def endorse(label: Column, kind: str) -> Column:
    """The label with an endorsement kind added, if it lacks it, and always a new id; no label stays none."""
    check_kind(kind)
    made = _make(
        label["source"],
        _id("endorse", kind, label["value_id"]),
        label["lineage"],
        label["ingested_by"],
        F.array_union(label["endorsements"], _texts(F.lit(kind))),
    )
    return F.when(label.isNotNull(), made)


def endorsement_record(
    label: Column,
    kind: str,
    note: str | None = None,
    agent: Column | None = None,
    run_id: Column | None = None,
) -> Column:
    """The record of an endorsement; NULL for an unlabeled value, which leaves no record."""
    agent = F.coalesce(agent if agent is not None else F.lit(None).cast("string"), F.lit(DEFAULT_AGENT))
    run = F.coalesce(run_id if run_id is not None else F.lit(None).cast("string"), _id("run", label["value_id"]))
    made = F.struct(
        F.lit(kind).alias("kind"),
        F.lit(note).cast("string").alias("note"),
        label["lineage"].alias("lineage"),
        endorse(label, kind)["value_id"].alias("value_id"),
        agent.alias("agent_id"),
        run.alias("run_id"),
        F.lit(None).cast("string").alias("session_id"),
    )
    return F.when(label.isNotNull(), made)


def collect(*labels: Column) -> Column:
    """The labels there are, each id once, in the order found."""
    return collect_all(F.array(*labels))


def collect_all(labels: Column) -> Column:
    start = F.array().cast(f"array<{LABEL}>")

    def step(acc: Column, x: Column) -> Column:
        return F.when(x.isNull() | F.exists(acc, lambda y: y["value_id"] == x["value_id"]), acc).otherwise(F.concat(acc, F.array(x)))

    several = F.aggregate(labels, start, step)
    return F.when(F.size(labels) <= 1, F.filter(labels, lambda x: x.isNotNull())).otherwise(several)

