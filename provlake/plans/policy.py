"""Policies: reading, checking, normal form, fingerprint and the tables that operators look things up in."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from provlake.errors import CelError, ConfigError
from provlake.functions.names import check_group, check_kind, check_name, split_tool
from provlake.plans.cel import Node, parse, uses_any

TRUST = ("trusted", "untrusted")
CAPABILITIES = ("reads_private", "reaches_external")
FROM_UNTRUSTED = "from_untrusted"
LEGS = (FROM_UNTRUSTED, *CAPABILITIES)
ACTIONS = ("allow", "block", "require_approval")
MODES = ("enforce", "monitor", "dry_run")
SINKS_SCHEMA = "sink string, capabilities array<string>"
RULES_SCHEMA = "sink string, ord int, name string, when_text string, action string"


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    when: str | None = None
    require_endorsement: str | None = None

    @property
    def text(self) -> str | None:
        """The condition in force; None for a catch-all."""
        if self.require_endorsement is None:
            return self.when
        return f'taint.exists(t, t.trust == "untrusted" && !t.endorsements.exists(k, k == "{self.require_endorsement}"))'

    @cached_property
    def tree(self) -> Node | None:
        return None if self.text is None else parse(self.text)


@dataclass(frozen=True)
class Sink:
    capabilities: tuple[str, ...] | None = None  # None: undeclared, which is not the same as declared to be none
    rules: tuple[Rule, ...] = ()


@dataclass(frozen=True)
class Policy:
    sources: dict[str, str] = field(default_factory=dict)
    agents: dict[str, tuple[str, ...]] = field(default_factory=dict)
    sinks: dict[str, Sink] = field(default_factory=dict)
    sink_action: str = "require_approval"
    fail_mode: str | None = None
    version: str = "2.0"

    def compile_check(self) -> "Policy":
        """CelError, naming sink and rule, if a condition does not parse or compile."""
        from provlake.plans.compile import to_column  # it needs this module

        for key, sink in self.sinks.items():
            for rule in sink.rules:
                if rule.text is not None:
                    try:
                        to_column(rule.tree)
                    except CelError as e:
                        raise CelError(f"sink {key!r}: rule {rule.name!r}: {e}") from e
        return self

    def normal(self) -> dict:
        return {
            "version": self.version,
            "defaults": {"sink_action": self.sink_action, "fail_mode": self.fail_mode},
            "sources": [{"name": k, "trust": v} for k, v in self.sources.items()],
            "agents": {k: {"groups": list(v)} for k, v in self.agents.items()},
            "sinks": {k: {"capabilities": None if s.capabilities is None else list(s.capabilities), "rules": [{"name": r.name, "when": r.when, "require_endorsement": r.require_endorsement, "action": r.action} for r in s.rules]} for k, s in self.sinks.items()},
        }

    @property
    def fingerprint(self) -> str:
        """SHA-256 of the normal form: the order of rules counts, that of keys does not."""
        text = json.dumps(self.normal(), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return "sha256:" + hashlib.sha256(text.encode()).hexdigest()

    @property
    def groups(self) -> frozenset[str]:
        return frozenset(g for groups in self.agents.values() for g in groups)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """sources, agents, sinks and rules as DataFrames."""
        rules = [(k, n, r.name, r.text, r.action) for k, s in self.sinks.items() for n, r in enumerate(s.rules)]
        return {
            "sources": spark.createDataFrame(list(self.sources.items()), "name string, trust string"),
            "agents": spark.createDataFrame([(k, list(v)) for k, v in self.agents.items()], "agent_id string, groups array<string>"),
            "sinks": spark.createDataFrame([(k, None if s.capabilities is None else list(s.capabilities)) for k, s in self.sinks.items()], SINKS_SCHEMA),
            "rules": spark.createDataFrame(rules, RULES_SCHEMA),
        }


def default_policy() -> Policy:
    """Nothing declared: every source is untrusted and every call needs approval."""
    return Policy()


def _one_of(value: object, allowed: tuple[str, ...], where: str) -> str:
    if value not in allowed:
        raise ConfigError(f"{where}: {value!r} is none of {', '.join(allowed)}")
    return value


def _text(value: object, where: str) -> str:
    if not isinstance(value, str):
        raise ConfigError(f"{where}: a text is needed, not {value!r}")
    return value


def _keys(value: object, where: str, allowed: set[str] | None, needed: tuple[str, ...] = ()) -> dict:
    if not isinstance(value, dict):
        raise ConfigError(f"{where}: a mapping is needed")
    if allowed is not None and (extra := set(value) - allowed):
        raise ConfigError(f"{where}: unknown key {sorted(map(str, extra))[0]!r}")
    for key in needed:
        if key not in value:
            raise ConfigError(f"{where}: {key!r} is missing")
    return value


def _list(value: object, where: str) -> list:
    if not isinstance(value, (list, tuple)):
        raise ConfigError(f"{where}: a list is needed")
    return list(value)


def check_shape(data: object) -> None:
    """Documents of before 2.0 are refused with a message of their own."""
    if isinstance(data, dict):
        sinks = data.get("sinks")
        if data.get("version") in ("1.0", 1.0, 1) or isinstance(sinks, dict) and any(isinstance(s, list) for s in sinks.values()):
            raise ConfigError("this is a policy of before version 2.0: give each sink a mapping with 'capabilities' and 'rules'")


def _rule(value: object, where: str) -> Rule:
    got = _keys(value, where, None, ("name", "action"))
    name, when, kind = _text(got["name"], f"{where}.name"), got.get("when"), got.get("require_endorsement")
    if when is not None and kind is not None:
        raise ConfigError(f"{where}: rule {name!r} has both 'when' and 'require_endorsement'")
    if when is not None:
        _text(when, f"{where}.when")
    if kind is not None:
        check_kind(kind)
    return Rule(name, _one_of(got["action"], ACTIONS, f"{where}.action"), when, kind)


def from_document(data: object) -> Policy:
    """The policy of a parsed document; ConfigError if it breaks the schema."""
    check_shape(data)
    got = _keys(data, "policy", None, ("version",))
    version = got["version"]
    if not isinstance(version, str) or not re.fullmatch(r"2\.\d+", version):
        raise ConfigError(f"version: {version!r} is not of the form 2.N")
    defaults = _keys(got.get("defaults") or {}, "defaults", {"sink_action", "fail_mode"})
    mode = defaults.get("fail_mode")
    sources: dict[str, str] = {}
    for n, s in enumerate(_list(got.get("sources") or [], "sources")):
        _keys(s, f"sources.{n}", None, ("name", "trust"))
        sources[_text(s["name"], f"sources.{n}.name")] = _one_of(s["trust"], TRUST, f"sources.{n}.trust")
    agents: dict[str, tuple[str, ...]] = {}
    for key, a in _keys(got.get("agents") or {}, "agents", None).items():
        _keys(a or {}, f"agents.{key}", {"groups"})
        agents[check_name(key)] = tuple(check_group(g) for g in _list((a or {}).get("groups") or [], f"agents.{key}.groups"))
    sinks: dict[str, Sink] = {}
    for key, s in _keys(got.get("sinks") or {}, "sinks", None).items():
        if not isinstance(key, str) or split_tool(key) is None:
            raise ConfigError(f"sinks: {key!r} is not of the form namespace.tool")
        s = _keys(s or {}, f"sinks.{key}", {"capabilities", "rules"})
        can = s.get("capabilities")
        can = None if can is None else tuple(
            _one_of(c, CAPABILITIES, f"sinks.{key}.capabilities") for c in _list(can, f"sinks.{key}.capabilities")
        )
        sinks[key] = Sink(
            can,
            tuple(_rule(r, f"sinks.{key}.rules.{n}") for n, r in enumerate(_list(s.get("rules") or [], f"sinks.{key}.rules"))),
        )
    return Policy(
        sources,
        agents,
        sinks,
        _one_of(defaults.get("sink_action", "require_approval"), ACTIONS, "defaults.sink_action"),
        None if mode is None else _one_of(mode, MODES, "defaults.fail_mode"),
        version,
    )


def read_document(path: str) -> object:
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f)
    except (OSError, yaml.YAMLError) as e:
        raise ConfigError(f"cannot read policy {path!r}: {e}") from e


def from_text(text: str) -> Policy:
    import yaml

    return from_document(yaml.safe_load(text)).compile_check()


def load(path: str) -> Policy:
    """A policy file, read, checked and compiled once."""
    return from_document(read_document(path)).compile_check()


def resolve_mode(env: str | None, policy: Policy, asked: str | None) -> str:
    """The environment outranks the policy, which outranks the caller; enforce is the default."""
    for value, where in ((env, "environment"), (policy.fail_mode, "policy"), (asked, "mode")):
        if value:
            return _one_of(value.strip().lower() if where == "environment" else value, MODES, where)
    return "enforce"


STARTER = """# Who may do what with what came from where. The first rule of a sink that matches decides.
version: "2.0"
defaults: {sink_action: require_approval, fail_mode: enforce}

# Sources that are not named here are untrusted.
sources:
  - {name: order_database, trust: trusted}
  - {name: customer_mail, trust: untrusted}

agents:
  refund-clerk: {groups: [desk]}
  mail-clerk: {groups: [desk]}

sinks:
  desk.lookup:
    capabilities: [reads_private]
  desk.refund:
    capabilities: []
    rules:
      - {name: own_desk, when: 'agent.id == "refund-clerk" && max_trust == "trusted"', action: allow}
      - {name: unread_sources, when: 'taint.exists(l, l.lineage.exists(s, s == "customer_mail"))', action: block}
  mail.send:
    capabilities: [reaches_external]
    rules:
      - {name: three_legs, when: 'run.tainted && run.trifecta.exists(x, x == "reads_private")', action: block}
      - {name: inside, when: 'args.to.endsWith("@shop.example") && !run.tainted', action: allow}
      - {name: ask, action: require_approval}
"""


def init(path: str) -> None:
    """Write the starter policy; an existing file is left alone."""
    try:
        with open(path, "x", encoding="utf-8") as f:
            f.write(STARTER)
    except FileExistsError as e:
        raise ConfigError(f"{path!r} exists already") from e


def uses_any_macro(rule: Rule) -> bool:
    return rule.text is not None and uses_any(rule.tree)
