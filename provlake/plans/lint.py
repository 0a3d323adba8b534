"""Static checks of a policy document: everything that can be said about it before any call."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession

from provlake.errors import CelError, ConfigError
from provlake.plans.cel import Node, bare, is_field
from provlake.plans.compile import to_column
from provlake.plans.identity import shadowed
from provlake.plans.policy import CAPABILITIES, FROM_UNTRUSTED, LEGS, Policy, Rule, Sink, check_shape, from_document, read_document

# What a rule can read of the run and of the agent.
RUN_FIELDS = ("tainted", "sources", "untrusted_sources", "ingested_by", "trifecta")
AGENT_FIELDS = ("id", "groups")
#: A rule that mentions one of these looks at provenance, not at identity alone; who ingested is identity, too.
PROVENANCE = ("taint", "max_trust", "sources", "run")


@dataclass(frozen=True)
class Problem:
    severity: str  # error or warning
    sink: str | None
    rule: str | None
    code: str
    message: str


def _calls(tree: Node, name: str, owner: str, field: str | None) -> list[Node]:
    """Calls of name on the bare identifier owner, or on owner.field."""
    out = []
    for n in tree.walk():
        if n.kind == "call" and n.name == name and n.target is not None:
            t = bare(n.target)
            if (field is None and t.kind == "ident" and t.name == owner) or (field is not None and is_field(t, owner, field)):
                out.append(n)
    return out


def _literals(nodes: tuple[Node, ...]) -> list[str]:
    return [n.value for a in nodes for n in a.walk() if n.kind == "lit" and isinstance(n.value, str)]


def _compared(call: Node) -> list[str]:
    """Literals that the bound variable of a quantifier is compared with."""
    if not call.args or bare(call.args[0]).kind != "ident":
        return []
    var, out = bare(call.args[0]).name, []
    for n in (x for a in call.args[1:] for x in a.walk()):
        if n.kind == "binary" and n.name in ("==", "!="):
            for a, b in (n.args, n.args[::-1]):
                if bare(a).kind == "ident" and bare(a).name == var and bare(b).kind == "lit" and isinstance(bare(b).value, str):
                    out.append(bare(b).value)
    return out


def _legs(policy: Policy, tree: Node) -> list[tuple[str, str, str]]:
    declared = {c for s in policy.sinks.values() for c in s.capabilities or ()}
    any_declares = any(s.capabilities is not None for s in policy.sinks.values())
    named = [
        leg for field in (None, "trifecta") for c in _calls(
            tree,
            "contains",
            "trifecta" if field is None else "run",
            field,
        ) for leg in _literals(c.args)
    ]
    named += [leg for c in _calls(tree, "exists", "run", "trifecta") for leg in _compared(c)]
    out = []
    for leg in named:
        if leg not in LEGS:
            out.append(("error", "unknown_leg", f"there is no trifecta leg {leg!r}; there are {', '.join(LEGS)}"))
        elif leg in CAPABILITIES and not any_declares:
            out.append(("error", "leg_never_set", f"no sink declares capabilities, so the leg {leg!r} is never set"))
        elif leg != FROM_UNTRUSTED and leg not in declared:
            out.append(("warning", "leg_undeclared", f"no sink declares the capability {leg!r}"))
    return out


def _of_rule(policy: Policy, rule: Rule) -> list[tuple[str, str, str]]:
    try:
        tree = rule.tree
        if any(n.kind == "call" and n.name == "any" and n.target is not None for n in tree.walk()):
            return [("error", "any_macro", "uses .any(, which is no CEL macro: use .exists(")]
    except CelError as e:
        return [("error", "parse", f"does not parse: {e}")]
    out = _legs(policy, tree)
    wrong = False
    for owner, fields in (("run", RUN_FIELDS), ("agent", AGENT_FIELDS)):
        for n in tree.walk():
            if is_field(n, owner) and n.name not in fields:
                wrong = True
                out.append(("error", f"unknown_{owner}_field", f"there is no {owner}.{n.name}; there are {', '.join(fields)}"))
    if not wrong:
        try:
            to_column(tree)
        except CelError as e:
            out.append(("error", "compile", f"does not compile: {e}"))
    for call in _calls(tree, "exists", "agent", "groups"):
        out += [("warning", "undeclared_group", f"no agent is declared in group {g!r}") for g in _compared(call) if g not in policy.groups]
    if any(n.kind == "binary" and n.name in ("==", "!=") and any(is_field(bare(a), "t", "source") for a in n.args) for n in tree.walk()):
        out.append(
            ("warning", "label_source", "t.source names one of several sources once values are combined; test the whole t.lineage instead")
        )
    if rule.action == "allow":
        for field in ("sources", "untrusted_sources", "ingested_by", "trifecta"):
            if _calls(tree, "all", "run", field):
                out.append(
                    ("warning", "run_all_allows", f"an empty run.{field} satisfies all(...), so this allows runs that nothing is known of")
                )
        names = _names_read(tree)
        if "agent" in names and not names & set(PROVENANCE):
            out.append(("warning", "identity_allows", "asks who calls but not where the arguments came from"))
        if _calls(tree, "all", "taint", None):
            out.append(("warning", "taint_all_allows", "an empty taint satisfies all(...), so this allows calls without any label"))
    return out


def _names_read(tree: Node) -> set[str]:
    """The names a rule reads; run counts only where more of it is read than who ingested."""
    agents = {id(bare(n.target)) for n in tree.walk() if is_field(n, "run", "ingested_by")}
    return {n.name for n in tree.walk() if n.kind == "ident" and id(n) not in agents}


def check(policy: Policy) -> list[Problem]:
    out = []
    declares = any(s.capabilities is not None for s in policy.sinks.values())
    for key, sink in policy.sinks.items():
        if declares and sink.capabilities is None:
            out.append(
                Problem(
                    "warning",
                    key,
                    None,
                    "capabilities",
                    "other sinks say what they can do, this one does not: write an empty list if it can do nothing",
                )
            )
        out += _of_sink(policy, key, sink)
    return out


def _of_sink(policy: Policy, key: str, sink: Sink) -> list[Problem]:
    out, closed, parsed = [], False, []
    for rule in sink.rules:
        if closed:
            out.append(Problem("error", key, rule.name, "after_catch_all", "cannot be reached: it follows a rule without condition"))
        if rule.text is None:
            if closed:
                out.append(Problem("error", key, rule.name, "second_catch_all", "is a second rule without condition"))
            closed = True
            continue
        found = _of_rule(policy, rule)
        out += [Problem(severity, key, rule.name, code, message) for severity, code, message in found]
        if not any(code in ("parse", "any_macro") for _, code, _ in found):
            parsed.append(rule)
    for s in shadowed(tuple(parsed), policy.agents):
        out.append(
            Problem("error", key, s.later, "shadowed", f"cannot be reached: rule {s.earlier!r} takes all its agents, such as {s.witness}")
        )
    return out


def validate(path: str) -> list[Problem]:
    """All problems of a policy file; none if it is sound. Nothing is raised."""
    try:
        data = read_document(path)
    except ConfigError as e:
        return [Problem("error", None, None, "unreadable", str(e))]
    try:
        check_shape(data)
    except ConfigError as e:
        return [Problem("error", None, None, "before_2_0", str(e))]
    try:
        policy = from_document(data)
    except ConfigError as e:
        return [Problem("error", None, None, "schema", str(e))]
    return check(policy)


def frame(spark: SparkSession, problems: list[Problem]) -> DataFrame:
    return spark.createDataFrame([astuple(p) for p in problems], "severity string, sink string, rule string, code string, message string")
