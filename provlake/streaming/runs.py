"""Run state over a stream: the same columns that operators.runs gives for a whole log, batch by batch.

Rows of a run are taken in the order of seq within a micro-batch; those of one seq are decided together, as in a whole
log. A row whose seq is not above the last one of an earlier batch is late and is emitted with late = true and no state
change. A run_end row clears the run's state; with a time to live the place of its end stays that long, so that late rows
are still known as such, and abandoned runs expire after it. Without one nothing of an ended run stays: a row that comes
after begins the run anew. Then the stateless decision of operators.decide runs on top, so batch and stream share one
expression.

The log is keyed by a hash of the run, of BUCKETS values, and a map holds an entry for each run: a call of the processor
costs milliseconds whatever it is given, so it takes a bucket's runs at once. Entries are read and written one run at a
time, only those that a batch brings rows for; a bucket that holds none yet is not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from provlake.operators import decide, runs
from provlake.plans.policy import Policy
from provlake.runtime import ship
from provlake.schema import RUN_ENTRY

OUTPUT = "run_id string, seq long, agent_id string, session_id string, tool string, args_json string, labels_json string, run_json string, capabilities string, late boolean"


#: Values of the key. A checkpoint goes on only with the number it began with.
BUCKETS = 4096
_RANK = {"call": 0, "ingress": 1, "run_end": 2}
_NONE: frozenset[str] = frozenset()


class RunState(StatefulProcessor):
    """Ingress sources with their agents, capabilities and the last seq of each run of a bucket."""

    def __init__(self, trusts: dict[str, str], can: dict[str, list[str]], ttl_ms: int | None):
        self.trusts, self.can, self.ttl_ms = trusts, {tool: frozenset(own) for tool, own in can.items()}, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("run", "run_id string", "kept string", self.ttl_ms)
        self.ended = handle.getMapState("ended", "run_id string", "last long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["run_id", "seq", "kind", "agent_id", "session_id", "source", "tool", "args_json", "labels_json"]
        chunks = [list(zip(*(chunk[n].tolist() for n in names))) for chunk in rows]
        batch = sorted((row for chunk in chunks for row in chunk), key=lambda row: (row[0], row[1], _RANK.get(row[2], 3)))
        known, gone = self.state.exists(), self.ttl_ms is not None and self.ended.exists()
        out: list[tuple] = []
        for run, mine in groupby(batch, key=itemgetter(0)):
            self._run(run, list(mine), known, gone, out)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def _run(self, run: str, rows: list[tuple], known: bool, gone: bool, out: list[tuple]) -> None:
        """One run's rows in order. known, gone: whether the bucket holds any open, any ended run. An open one is kept as
        [[[source, agents], ...], capabilities, last]."""
        seen, can, last = {}, _NONE, None
        kept = self.state.getValue((run,)) if known else None
        if kept is not None:
            pairs, legs, last = json.loads(kept[0])
            seen, can = dict(pairs), frozenset(legs)
        elif gone and (ended := self.ended.getValue((run,))) is not None:
            last = ended[0]
        before, open_, entries, at, n = last, kept is not None, self._entries(seen), 0, len(rows)
        while at < n:
            seq, end = rows[at][1], at + 1
            while end < n and rows[end][1] == seq:
                end += 1
            place, late = rows[at:end], before is not None and seq <= before
            calls = [row for row in place if row[2] == "call"]
            own = [self.can.get(row[6] if "." in row[6] else f"default.{row[6]}", _NONE) for row in calls]
            if not late:
                last, open_, can = seq, True, can.union(*own)
            for row, more in zip(calls, own):
                out.append((run, seq, row[3], row[4], row[6], row[7], row[8], entries, _listed(can | more), late))
            at = end
            if late or len(calls) == len(place):
                continue
            enter = sorted({(row[5], row[3] or "default") for row in place if row[2] == "ingress"}, key=lambda e: (e[0] or "", e[1]))
            for source, agent in enter:
                if agent not in (agents := seen.setdefault(source, [])):
                    agents.append(agent)
            if any(row[2] == "run_end" for row in place):
                seen, can, open_ = {}, _NONE, False
            entries = self._entries(seen)
        if open_:
            pairs = json.dumps(list(seen.items())) if seen else "[]"
            self.state.updateValue((run,), (f"[{pairs}, {_listed(can)}, {int(last)}]",))
        else:
            if kept is not None:
                self.state.removeKey((run,))
            if self.ttl_ms is not None:
                self.ended.updateValue((run,), (int(last),))

    def _entries(self, seen: dict[str, list[str]]) -> str:
        return json.dumps([{"source": s, "trust": self.trusts.get(s, "untrusted"), "ingested_by": a} for s, a in seen.items()]) if seen else "[]"

    def close(self) -> None:
        pass


@cache
def _listed(values: frozenset[str]) -> str:
    return json.dumps(sorted(values))


def run_state(log: DataFrame, policy: Policy, ttl_ms: int | None = 24 * 3600 * 1000) -> DataFrame:
    """Calls of a streaming log (run_id, seq, kind, agent_id, session_id, source, tool, args_json, labels_json) with their
    run state. kind: ingress, call or run_end. Rows without a run are left to the caller: they have no state.

    ttl_ms: how long an abandoned run is kept. None keeps it until its run_end; a stream that is to stop by itself when
    its input is used up needs that, since expiry by the clock has no last batch."""
    ship(log.sparkSession)
    can = {k: list(s.capabilities) for k, s in policy.sinks.items() if s.capabilities}
    bucket = F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).cast("int")
    keyed = log.where("run_id IS NOT NULL").withColumn("__bucket", bucket).groupBy("__bucket")
    return keyed.transformWithStateInPandas(
        RunState(dict(policy.sources), can, ttl_ms),
        OUTPUT,
        "Append",
        "None" if ttl_ms is None else "ProcessingTime",
    )


def decide_stream(log: DataFrame, policy: Policy, mode: str = "enforce", ttl_ms: int | None = 24 * 3600 * 1000) -> DataFrame:
    """Decisions of a streaming log; late calls carry late = true and are not to be acted on again."""
    calls = run_state(log, policy, ttl_ms)
    calls = calls.withColumn("args", F.coalesce("args_json", F.lit("{}"))).withColumn(
        "labels",
        F.from_json("labels_json", f"array<{decide.trust.LABEL}>"),
    )
    calls = decide.prepared(calls.drop("args_json", "labels_json"))
    calls = calls.withColumn("run_ingress", F.from_json("run_json", f"array<{RUN_ENTRY}>")).withColumn(
        "run_capabilities",
        F.from_json("capabilities", "array<string>"),
    ).drop("run_json", "capabilities")
    return decide.decide(runs.derived(calls), policy, mode)
