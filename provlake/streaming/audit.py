"""The laundering audit over a stream: the findings of operators.audit, batch by batch.

The log is keyed by run. A run's state holds the untrusted content it has met and the findings it has made; a run_end row
clears both, abandoned runs expire after the time to live. Content is kept whole, the newest `most` of a run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from provlake.plans.policy import Policy
from provlake.runtime import ship
from provlake.schema import AUDIT_LEAST

OUTPUT = "run_id string, source string, tool string, argument string, seq long, agent_id string"
MOST = 10_000


class AuditState(StatefulProcessor):
    """Untrusted content and findings of one run."""

    def __init__(self, trusted: frozenset[str], ttl_ms: int | None, most: int):
        self.trusted, self.ttl_ms, self.most = trusted, ttl_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("audit", "known string, found string", self.ttl_ms)

    def _register(self, known: dict[str, list], text: str, source: str, at: int) -> None:
        if len(text) >= AUDIT_LEAST and source not in known.setdefault(text, {}):
            known[text][source] = at

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        known, found = {}, set()
        if self.state.exists():
            kept = self.state.get()
            known, found = json.loads(kept[0]), {tuple(x) for x in json.loads(kept[1])}
        out = []
        for row in batch.itertuples():
            if row.kind == "run_end":
                known, found = {}, set()
            elif row.kind == "ingress" and row.source not in self.trusted:
                # What enters counts for the calls after it.
                self._register(known, row.text or "", row.source, row.seq + 1)
            elif row.kind == "call":
                leaves = json.loads(row.leaves_json or "[]")
                for leaf in leaves:
                    if leaf.get("lineage") and not set(leaf["lineage"]) <= self.trusted:
                        self._register(known, leaf["text"], leaf["source"], row.seq)
                for leaf in leaves:
                    if leaf.get("lineage") is None and len(leaf["text"]) >= AUDIT_LEAST:
                        for content, sources in known.items():
                            for source, at in sources.items():
                                place = (source, row.tool, leaf["argument"])
                                if at <= row.seq and place not in found and content in leaf["text"]:
                                    found.add(place)
                                    out.append((key[0], *place, row.seq, row.agent_id))
        if known or found:
            newest = dict(list(known.items())[-self.most :])
            self.state.update((json.dumps(newest), json.dumps(sorted(found))))
        else:
            self.state.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def findings_stream(log: DataFrame, policy: Policy, ttl_ms: int | None = 24 * 3600 * 1000, most: int = MOST) -> DataFrame:
    """Findings of a streaming log (run_id, seq, kind, agent_id, source, text, tool, leaves_json), each once for a run.

    kind: ingress (with text), call or run_end. leaves_json: a JSON list of the call's text leaves, {argument, text} and,
    for a labeled one, source and lineage of its label. Rows without a run have no state and are left to the caller.
    """
    ship(log.sparkSession)
    trusted = frozenset(k for k, v in policy.sources.items() if v == "trusted")
    keyed = log.where("run_id IS NOT NULL").groupBy("run_id")
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return keyed.transformWithStateInPandas(AuditState(trusted, ttl_ms, most), OUTPUT, "Append", mode)
