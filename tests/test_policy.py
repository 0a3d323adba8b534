import pytest
import yaml

from provlake import cli
from provlake.errors import CelError, ConfigError
from provlake.functions.names import check_name, split_tool
from provlake.plans import explain, lint
from provlake.plans.cel import parse
from provlake.plans.identity import Identity, partial
from provlake.plans.policy import STARTER, Policy, default_policy, from_document, from_text, init, load, resolve_mode


def doc(**sinks):
    return {"version": "2.0", "sinks": {k.replace("__", "."): v for k, v in sinks.items()}}


@pytest.mark.parametrize(
    "change",
    [
        {"version": "1.0"},
        {"version": "3.0"},
        {"version": 2.0},
        {"sinks": {"default.x": [{"name": "r", "action": "allow"}]}},
        {"sinks": {"bare": {}}},
        {"sinks": {"a.b.c": {}}},
        {"sinks": {"a.b": {"other": 1}}},
        {"sinks": {"a.b": {"capabilities": ["flies"]}}},
        {"sinks": {"a.b": {"rules": [{"name": "r"}]}}},
        {"sinks": {"a.b": {"rules": [{"name": "r", "action": "maybe"}]}}},
        {"sinks": {"a.b": {"rules": [{"name": "r", "action": "allow", "when": "true", "require_endorsement": "k"}]}}},
        {"sinks": {"a.b": {"rules": [{"name": "r", "action": "allow", "require_endorsement": "no blanks"}]}}},
        {"agents": {"bad agent": {}}},
        {"agents": {"a": {"groups": ["b c"]}}},
        {"agents": {"a": {"role": "x"}}},
        {"defaults": {"sink_action": "perhaps"}},
        {"defaults": {"fail_mode": "perhaps"}},
        {"defaults": {"other": 1}},
        {"sources": [{"name": "s", "trust": "some"}]},
        {"sources": {"s": "trusted"}},
    ],
)
def test_refused(change):
    with pytest.raises(ConfigError):
        from_document({"version": "2.0"} | change)


def test_defaults_and_extra_keys():
    p = from_document({"version": "2.7", "note": "kept out", "sources": [{"name": "s", "trust": "trusted", "why": "ours"}]})
    assert p.sink_action == "require_approval" and p.fail_mode is None and p.sources == {"s": "trusted"}
    assert default_policy() == Policy()


def test_undeclared_is_not_empty():
    p = from_document(doc(default__a={}, default__b={"capabilities": []}))
    assert p.sinks["default.a"].capabilities is None and p.sinks["default.b"].capabilities == ()


def test_compile_errors_name_the_rule():
    with pytest.raises(CelError, match="'default.x'.*'r'"):
        from_text('version: "2.0"\nsinks: {default.x: {rules: [{name: r, when: "a ==", action: allow}]}}')


def test_fingerprint_counts_rule_order_not_key_order():
    rules = [{"name": "a", "action": "allow", "when": "run.tainted"}, {"name": "b", "action": "block"}]
    one = from_document(doc(default__x={"rules": rules, "capabilities": []}))
    same = from_document({"sinks": {"default.x": {"capabilities": [], "rules": [dict(reversed(r.items())) for r in rules]}}, "version": "2.0"})
    other = from_document(doc(default__x={"rules": rules[::-1], "capabilities": []}))
    assert one.fingerprint == same.fingerprint != other.fingerprint and one.fingerprint.startswith("sha256:")


def test_mode_precedence():
    p = Policy(fail_mode="monitor")
    assert resolve_mode("DRY_RUN", p, "enforce") == "dry_run" and resolve_mode(None, p, "enforce") == "monitor"
    assert resolve_mode(None, Policy(), "dry_run") == "dry_run" and resolve_mode(None, Policy(), None) == "enforce"
    with pytest.raises(ConfigError):
        resolve_mode("loud", p, None)


@pytest.mark.parametrize("name, ok", [("a", True), ("a.b-c_1", True), ("", False), ("a b", False), ("a\n", False), ("é", False)])
def test_names(name, ok):
    if ok:
        assert check_name(name) == name
    else:
        with pytest.raises(ConfigError):
            check_name(name)


def test_split_tool():
    assert split_tool("a.b") == ("a", "b") and split_tool("a") is None and split_tool("a.b.c") is None and split_tool("a.") is None


def test_residual_keeps_meaning():
    text = '(agent.id == "a" || args.x > 3) && agent.groups.exists(g, g == "p") && !(run.tainted || max_trust == "untrusted")'
    tree = parse(text)
    assert partial(tree, text, Identity("b")).value is False
    assert partial(tree, text, Identity("b", frozenset({"p"}))).text == 'args.x > 3 && !(run.tainted || max_trust == "untrusted")'
    got = partial(tree, text, Identity(member_of="p"))
    assert got.on_member and got.text == '(agent.id == "a" || args.x > 3) && !(run.tainted || max_trust == "untrusted")'
    other = partial(tree, text, Identity(member_of="q"))
    assert other.value is None and 'agent.groups.exists(g, g == "p")' in other.text


def test_explain_tool():
    p = from_document(doc(default__x={"rules": [{"name": "r", "when": 'agent.id == "a" || "g" in agent.groups', "action": "allow"}, {"name": "s", "action": "block"}]}))
    assert [(r["agents"], r["groups"]) for r in explain.for_tool(p, "default.x")] == [(["a"], ["g"]), ([], [])]
    assert explain.for_tool(p, "default.y") is None


def test_shadow_reason():
    p = from_document({"version": "2.0", "agents": {"a": {"groups": ["g"]}}, "sinks": {"default.x": {"rules": [{"name": "r", "when": 'agent.groups.exists(g, g == "g")', "action": "allow"}, {"name": "s", "action": "block"}]}}})
    got = explain.for_agent(p, "a")
    assert (got[0].outcome, got[1].outcome, got[1].shadowed_by) == ("unconditional", "eliminated", "r") and "'g'" in got[1].shadowed_by_reason
    assert [r.outcome for r in explain.for_agent(p, "b")] == ["eliminated", "unconditional"]


def test_validate_never_raises(tmp_path):
    bad = tmp_path / "p.yaml"
    assert lint.validate(str(bad))[0].code == "unreadable"
    bad.write_text(yaml.safe_dump({"version": "1.0"}))
    assert lint.validate(str(bad))[0].code == "before_2_0"
    bad.write_text(yaml.safe_dump({"version": "2.0", "defaults": {"x": 1}}))
    assert lint.validate(str(bad))[0].code == "schema"


def test_lint_sound_policy():
    assert [p for p in lint.check(from_text(STARTER)) if p.severity == "error"] == []


def test_lint_legs():
    def codes(when, **kw):
        return {p.code for p in lint.check(from_document(doc(default__x={"rules": [{"name": "r", "when": when, "action": "block"}], **kw})))}

    assert "leg_never_set" in codes('run.trifecta.exists(l, l == "reads_private")')
    assert "leg_undeclared" in codes('trifecta.contains("reads_private")', capabilities=["reaches_external"])
    assert not codes('trifecta.contains("from_untrusted")', capabilities=[])
    assert "undeclared_group" in codes('agent.groups.exists(g, g == "q")')


def test_cli(tmp_path, capsys):
    path = str(tmp_path / "p.yaml")
    assert cli.main(["init", path]) == 0 and cli.main(["init", path]) == 1
    assert load(path).sinks
    assert cli.main(["validate", path]) == 0
    assert cli.main(["explain", path, "--agent", "research-agent", "--show-eliminated"]) == 0
    assert "three_legs" in capsys.readouterr().out
    assert cli.main(["explain", path, "--tool", "default.none"]) == 1
    assert cli.main(["explain", path, "--group", "readers"]) == 0
    assert cli.main(["validate", str(tmp_path / "none.yaml")]) == 1


def test_who_ingested_is_no_provenance():
    """An allow rule that reads only identities of agents, the caller's and those that ingested, is warned of."""
    rule = lambda when: from_document({"version": "2.0", "agents": {"a": {"groups": []}}, "sinks": {"default.x": {"capabilities": [], "rules": [{"name": "r", "when": when, "action": "allow"}]}}})
    codes = lambda when: [p.code for p in lint.check(rule(when))]
    assert "identity_allows" in codes('agent.id == "a" && run.ingested_by.exists(x, x == "a")')
    assert "identity_allows" not in codes('agent.id == "a" && run.sources.exists(x, x == "a")')


def test_a_policy_too_large_for_a_plan(spark):
    from provlake.operators import trust

    p = from_document({"version": "2.0", "sources": [{"name": f"s{k}", "trust": "trusted"} for k in range(trust.LITERAL_ROWS + 1)]})
    with pytest.raises(ConfigError):
        trust.check_size(p)
