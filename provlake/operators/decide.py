"""Decisions: every call of a log against a policy, in one plan.

Input (`calls`): run_id, seq, agent_id, tool, args (VARIANT, JSON text or struct), labels ARRAY<LABEL>; session_id,
trace_id and span_id if there are. A row whose agent or tool name is invalid gets a reject_reason and no decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlake.errors import ApprovalDenied, EvaluationFailed, PolicyViolation
from provlake.functions import names
from provlake.functions.labels import collect_all
from provlake.operators import runs, trust
from provlake.plans.compile import context, to_column
from provlake.plans.policy import Policy, Sink, resolve_mode

EVALUATION_ERROR = "evaluation_error"
_CASE = "struct<action:string,rule:string,condition:string>"


def prepared(calls: DataFrame) -> DataFrame:
    """calls with missing columns added, names completed, args as VARIANT and a reject_reason."""
    have = set(calls.columns)
    for c, kind in (("session_id", "string"), ("trace_id", "string"), ("span_id", "string"), ("labels", None), ("args", None)):
        if c not in have:
            calls = calls.withColumn(
                c,
                trust.no_labels() if c == "labels" else F.parse_json(F.lit("{}")) if c == "args" else F.lit(None).cast(kind),
            )
    kind = calls.schema["args"].dataType
    if isinstance(kind, T.StringType):
        calls = calls.withColumn("args", F.try_parse_json("args"))
    elif isinstance(kind, (T.StructType, T.MapType)):
        calls = calls.withColumn("args", F.to_variant_object("args"))
    agent = F.coalesce("agent_id", F.lit(names.DEFAULT_AGENT))
    why = F.when(
        ~names.tool_is_valid(F.col("tool")),
        F.lit("invalid tool name"),
    ).when(~names.name_is_valid(agent), F.lit("invalid agent id")).when(F.col("args").isNull(), F.lit("arguments are no object"))
    calls = calls.withColumn("reject_reason", why).withColumn("agent_id", agent).withColumn("tool", names.qualify(F.col("tool")))
    return calls.withColumn("labels", collect_all(F.coalesce("labels", trust.no_labels())))


def _case(action: str, rule: str | None, condition: str | None) -> Column:
    return F.struct(
        F.lit(action).alias("action"),
        F.lit(rule).cast("string").alias("rule"),
        F.lit(condition).cast("string").alias("condition"),
    ).cast(_CASE)


def sink_column(sink: Sink, default: str) -> Column:
    """The first rule that matches; NULL where a rule before any match cannot be evaluated."""
    chain, out = [], None
    for rule in sink.rules:
        if rule.text is None:
            out = _case(rule.action, rule.name, None)
            break
        chain.append((to_column(rule.tree, context()), _case(rule.action, rule.name, rule.text)))
    out = out if out is not None else _case(default, None, None)
    for test, then in reversed(chain):
        out = F.when(test.isNull(), F.lit(None).cast(_CASE)).when(test, then).otherwise(out)
    return out


def rules_column(policy: Policy) -> Column:
    """The sinks' chains by tool; a tool without rules gets the default action."""
    out = None
    for key, sink in policy.sinks.items():
        if sink.rules:
            test, then = F.col("tool") == key, sink_column(sink, policy.sink_action)
            out = F.when(test, then) if out is None else out.when(test, then)
    default = _case(policy.sink_action, None, None)
    return default if out is None else out.otherwise(default)


def with_context(calls: DataFrame, policy: Policy) -> DataFrame:
    """What rules can name, as columns, computed once."""
    out = calls.withColumn("taint", trust.resolve_labels(policy, F.col("labels")))
    untrusted = F.exists("taint", lambda t: t["trust"] == "untrusted")
    out = out.withColumn("sources", trust.all_sources(F.col("labels")))
    out = out.withColumn("untrusted_sources", trust.untrusted_sources(policy, F.col("labels")))
    out = out.withColumn("max_trust", F.when(untrusted, F.lit("untrusted")).otherwise(F.lit("trusted")))
    out = out.withColumn("trifecta", trust.trifecta(trust.tool_capabilities(policy, F.col("tool")), F.col("max_trust") == "untrusted"))
    return out.withColumn("agent_groups", trust.agent_groups(policy, F.col("agent_id")))


def apply_mode(case: Column, failed: Column, mode: str) -> tuple[Column, Column]:
    """(action, outcome). The outcome stays what the rules said; the action is what the mode makes of it."""
    outcome = F.when(failed, F.lit(EVALUATION_ERROR)).otherwise(case["action"])
    if mode == "dry_run":
        return F.lit("allow"), outcome
    return F.when(failed, F.lit("block" if mode == "enforce" else "allow")).otherwise(case["action"]), outcome


def decide(prepared_calls: DataFrame, policy: Policy, mode: str) -> DataFrame:
    """Decisions for calls that carry their run state already (see runs.derived); batch and stream share this."""
    out = with_context(prepared_calls, trust.check_size(policy)).withColumn("__case", rules_column(policy))
    failed = F.col("__case").isNull()
    action, outcome = apply_mode(F.col("__case"), failed, mode)
    valid = F.col("reject_reason").isNull()
    run = F.coalesce("run_id", F.concat(F.lit("minted-"), F.sha2(F.concat_ws("|", "agent_id", "tool", F.col("seq").cast("string")), 256)))
    out = out.withColumns(
        {
            "action": F.when(valid, action),
            "outcome": F.when(valid, outcome),
            "matched_rule": F.when(valid, F.col("__case.rule")),
            "matched_condition": F.when(valid, F.col("__case.condition")),
            "mode": F.lit(mode),
            "policy_fingerprint": F.lit(policy.fingerprint),
            "run_id": run,
        }
    )
    out = out.withColumn("decision_id", F.sha2(F.concat_ws("|", "run_id", F.col("seq").cast("string"), "tool"), 256))
    return out.withColumnRenamed("labels", "contributing_labels").drop("__case", "taint")


def check(
    calls: DataFrame,
    policy: Policy,
    ingress: DataFrame | None = None,
    mode: str | None = None,
    env_mode: str | None = None,
    replayed: DataFrame | None = None,
) -> DataFrame:
    """A decision for every call: action, outcome, matched rule and condition, labels, trifecta, run state, fingerprint.
    replayed: capabilities that envelopes brought into the runs (see envelope.replay_capabilities)."""
    return decide(runs.with_run_state(prepared(calls), ingress, policy, replayed), policy, resolve_mode(env_mode, policy, mode))


def in_modes(decisions: DataFrame, modes: tuple[str, ...] = ("enforce", "monitor", "dry_run")) -> DataFrame:
    """Decisions made under enforce, once for each mode: what the mode makes of them is a projection."""
    mode, allowed = F.col("mode"), F.lit("allow")
    failed = F.col("outcome") == EVALUATION_ERROR
    action = F.when(mode == "dry_run", allowed).when(failed & (mode == "monitor"), allowed).otherwise(F.col("action"))
    each = decisions.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    return each.withColumn("action", F.when(F.col("reject_reason").isNull(), action))


def events(decisions: DataFrame) -> DataFrame:
    """Decision rows as event records (see sources.records)."""
    inner = [
        "action",
        "matched_rule",
        "matched_condition",
        "tool",
        "contributing_labels",
        "trifecta",
        "untrusted_sources",
        "run_tainted",
        "run_ingress",
        "run_trifecta",
        "mode",
        "decision_id",
        "agent_id",
        "run_id",
        "session_id",
    ]
    when = F.col("ts").cast("timestamp") if "ts" in decisions.columns else F.lit(None).cast("timestamp")
    from provlake.schema import SCHEMA_VERSION

    return decisions.where("reject_reason IS NULL").select(
        F.lit("event").alias("record_type"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "trace_id",
        "span_id",
        "policy_fingerprint",
        when.alias("timestamp"),
        F.struct(*inner).alias("decision"),
        "sources",
        "outcome",
    )


def auto_deny(decisions: DataFrame) -> Column:
    """The resolver that releases nothing."""
    return F.lit(False)


def release(decisions: DataFrame, resolver=auto_deny) -> DataFrame:
    """decisions with `released`: allowed, or in need of approval and released by the resolver (a Column of the frame)."""
    asked = F.coalesce(resolver(decisions), F.lit(False))
    return decisions.withColumn(
        "released",
        F.coalesce((F.col("action") == "allow") | ((F.col("action") == "require_approval") & asked), F.lit(False)),
    )


def message() -> Column:
    """Why a call did not go through."""
    rule = F.coalesce("matched_rule", F.lit("default"))
    blocked = F.concat(F.lit("call to "), F.col("tool"), F.lit(" blocked by rule "), rule)
    denied = F.concat(F.lit("call to "), F.col("tool"), F.lit(" needs approval by rule "), rule, F.lit(" and got none"))
    return F.when(F.col("action") == "block", blocked).when(F.col("action") == "require_approval", denied)


def assert_released(released: DataFrame) -> None:
    """Raises for the first call that was not released: an evaluation that failed under enforce, a block, a denial."""
    worst = released.where(~F.col("released") & F.col("reject_reason").isNull())
    worst = worst.select(
        F.when(
            (F.col("outcome") == EVALUATION_ERROR) & (F.col("mode") == "enforce"),
            0,
        ).when(F.col("action") == "block", 1).otherwise(2).alias("rank"),
        message().alias("why"),
        "run_id",
        "seq",
    ).orderBy("rank", "run_id", "seq").first()
    if worst is not None:
        raise (EvaluationFailed, PolicyViolation, ApprovalDenied)[worst["rank"]](worst["why"])
