"""Command line: validate, init, inspect and explain."""

from __future__ import annotations

import argparse
import sys

from provlake.errors import EngineError
from provlake.plans import explain, lint, policy


def _validate(path: str) -> int:
    problems = lint.validate(path)
    for p in problems:
        print(": ".join(x for x in (p.severity, p.sink, p.rule, p.message) if x))
    if not problems:
        print("no problems")
    return int(any(p.severity == "error" for p in problems))


def _inspect(path: str, run_id: str | None) -> int:
    from pyspark.sql import SparkSession

    from provlake.sources import records

    spark = SparkSession.builder.getOrCreate()
    good, bad = records.read(spark, path)
    for row in bad.toLocalIterator():
        print(f"skipped: {row['value'][:120]}", file=sys.stderr)
    run = agent = None
    n = {(r["run_id"], r["agent_id"]): r for r in records.counts(good, run_id).toLocalIterator()}
    for row in records.tree(good, run_id).toLocalIterator():
        if row["run_id"] != run:
            run, agent, c = row["run_id"], None, n[(row["run_id"], None)]
            print(f"run {run}  ({c['n_events']} events, {c['n_findings']} findings, {c['n_endorsements']} endorsements)")
        if row["agent_id"] != agent:
            agent = row["agent_id"]
            print(f"  agent {agent}")
        print(f"    {row['timestamp']}  {row['summary']}")
    return 0


def _explain(args: argparse.Namespace) -> int:
    rules = policy.load(args.policy)
    if args.tool:
        found = explain.for_tool(rules, args.tool)
        if found is None:
            print(f"the policy has no sink {args.tool!r}", file=sys.stderr)
            return 1
        for r in found:
            print(
                f"{r['ord']} {r['rule']}: {r['action']}  when {
                    r['condition'] or 'always'
                }  agents {r['agents'] or '-'}  groups {r['groups'] or '-'}"
            )
        return 0
    sink = None
    for r in explain.for_agent(rules, args.agent) if args.agent else explain.for_group(rules, args.group):
        if r.sink != sink:
            sink = r.sink
            print(f"{sink}  (otherwise {r.default_action})")
        if r.outcome != "eliminated" or args.show_eliminated:
            print(
                f"  {r.rule}: {r.action}  {r.outcome}" + (f"  when {r.residual}" if r.residual else "") + (
                    f"  shadowed by {r.shadowed_by}" if r.shadowed_by else ""
                )
            )
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="provlake")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "init"):
        sub.add_parser(name).add_argument("path")
    p = sub.add_parser("inspect")
    p.add_argument("path")
    p.add_argument("--run-id")
    p = sub.add_parser("explain")
    p.add_argument("policy")
    who = p.add_mutually_exclusive_group(required=True)
    for name in ("--agent", "--group", "--tool"):
        who.add_argument(name)
    p.add_argument("--show-eliminated", action="store_true")
    args = parser.parse_args(argv)
    try:
        if args.command == "validate":
            return _validate(args.path)
        if args.command == "init":
            policy.init(args.path)
            return 0
        return _inspect(args.path, args.run_id) if args.command == "inspect" else _explain(args)
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
