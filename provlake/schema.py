"""Row types shared by all operators."""

from __future__ import annotations

LABEL = "struct<source:string,value_id:string,lineage:array<string>,ingested_by:array<string>,endorsements:array<string>>"
RUN_ENTRY = "struct<source:string,trust:string,ingested_by:array<string>>"
LEAF = f"struct<argument:string,text:string,label:{LABEL}>"
DECISION = f"struct<action:string,matched_rule:string,matched_condition:string,tool:string,contributing_labels:array<{LABEL}>,trifecta:array<string>,untrusted_sources:array<string>,run_tainted:boolean,run_ingress:array<{
    RUN_ENTRY
}>,run_trifecta:array<string>,mode:string,decision_id:string,agent_id:string,run_id:string,session_id:string>"
RECORD = f"record_type string, schema_version int, trace_id string, span_id string, policy_fingerprint string, timestamp timestamp, decision {
    DECISION
}, sources array<string>, outcome string, source string, tool string, argument string, kind string, note string, lineage array<string>, value_id string, agent_id string, run_id string, session_id string"
# Fixed values of the record and envelope formats and of the audit.
SCHEMA_VERSION = 11
WIRE_VERSION = 3
AUDIT_LEAST = 12
DEFAULT_DEPTH, MOST_DEPTH = 4, 10
MOST_ENTRIES, MOST_NAME, MOST_LIST = 100_000, 256, 64
SIDECAR = "__provenance__"
