"""One query for each family of operators, over the test tables, with the same definition in SQL."""

from __future__ import annotations

import logging
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.functions import labels, names, nested, strings
from provlake.functions.strings import Labeled, plain
from provlake.operators import audit, decide, describe, envelope, runs, trust
from provlake.plans import explain, lint
from provlake.plans.compile import Typed, to_column
from provlake.plans.policy import STARTER, Policy, from_document, from_text, init, load
from provlake.runtime import own_dir
from provlake.sources import records, tables
from provlake.sources.tables import table

CONVERSATIONS = """
version: "2.0"
defaults: {sink_action: require_approval}
sources:
  - {name: user_0, trust: trusted}
  - {name: user_1, trust: untrusted}
agents:
  agent-0: {groups: [senior, staff]}
  agent-1: {groups: [staff]}
sinks:
  default.tool_0:
    capabilities: [reads_private]
    rules:
      - {name: long_untrusted, when: 'taint.exists(t, t.trust == "untrusted") && size(args.text) > 400', action: block}
      - {name: senior, when: 'agent.groups.exists(g, g == "senior")', action: allow}
      - {name: late_turn, when: 'args.turn >= 4', action: allow}
  default.tool_1:
    capabilities: [reaches_external]
    rules:
      - {name: missing, when: 'args.nothing == "x"', action: allow}
      - {name: never_reached, action: allow}
  default.tool_2:
    capabilities: []
    rules:
      - {name: needs_review, require_endorsement: reviewed, action: block}
      - {name: rest, action: allow}
"""
EVENTS = """
version: "2.0"
defaults: {sink_action: allow}
sources:
  - {name: feed_0, trust: trusted}
  - {name: feed_1, trust: trusted}
sinks:
  default.view: {capabilities: [reads_private]}
  default.click:
    capabilities: []
    rules:
      - {name: big_key, when: 'args.k > 50 && run.tainted', action: block}
      - {name: low_key, when: 'args.k < 10', action: require_approval}
  default.purchase:
    capabilities: [reaches_external]
    rules:
      - {name: rule_of_two, when: size(run.trifecta) >= 3, action: block}
      - {name: tainted_run, when: run.tainted, action: require_approval}
      - {name: rest, action: allow}
"""
LINES = """
version: "2.0"
defaults: {sink_action: allow}
sources:
  - {name: supplier_0, trust: trusted}
  - {name: supplier_1, trust: trusted}
  - {name: supplier_2, trust: trusted}
sinks:
  default.step_0:
    capabilities: [reads_private]
    rules:
      - {name: many_untrusted, when: 'max_trust == "untrusted" && args.quantity > 40.0', action: block}
  default.step_1:
    capabilities: [reaches_external]
    rules:
      - {name: rule_of_two, when: 'size(run.trifecta) >= 3', action: block}
      - {name: open_line, when: 'args.status == "O" && run.tainted', action: require_approval}
  default.step_2:
    capabilities: []
    rules:
      - {name: untrusted_run, when: 'run.untrusted_sources.exists(s, s == "supplier_4")', action: require_approval}
      - {name: rest, action: allow}
"""


@cache
def policy(text: str) -> Policy:
    return from_text(text)


def joined(values: Column) -> Column:
    return F.array_join(values, ",")


def ordered(values: Column) -> Column:
    return F.array_join(F.array_sort(values), ",")


# --- SQL fragments that several oracles share -------------------------------------------------------------------------

_CONV = """
ing AS (SELECT conv_id, turn, 'agent-' || (conv_id + turn) % 4 AS agent, 'user_' || (conv_id + turn) % 3 AS source, text FROM conversations WHERE role = 'user'),
calls AS (
  SELECT c.conv_id, c.turn, 'conv-' || c.conv_id AS run_id, 'agent-' || c.conv_id % 4 AS agent_id, 'default.tool_' || (c.conv_id + c.turn) % 4 AS tool, c.text,
    i.source AS label_source, i.agent AS label_agent, coalesce(i.source <> 'user_0', false) AS untrusted
  FROM conversations c LEFT JOIN ing i ON i.conv_id = c.conv_id AND i.turn + 1 = c.turn WHERE c.role = 'assistant'
),
decided AS (
  SELECT *, CASE tool
      WHEN 'default.tool_0' THEN CASE WHEN untrusted AND text IS NULL THEN 'error' WHEN untrusted AND length(text) > 400 THEN 'block|long_untrusted' WHEN agent_id = 'agent-0' THEN 'allow|senior' WHEN turn >= 4 THEN 'allow|late_turn' ELSE 'require_approval|' END
      WHEN 'default.tool_1' THEN 'error'
      WHEN 'default.tool_2' THEN CASE WHEN untrusted THEN 'block|needs_review' ELSE 'allow|rest' END
      ELSE 'require_approval|' END AS verdict
  FROM calls
)"""
_EVENT = """
base AS (
  SELECT event_id, user_id::VARCHAR || '/' || strftime(ts, '%Y-%m-%d') AS run_id, epoch_us(ts) AS seq, 'agent-' || user_id % 5 AS agent_id, event_type, 'feed_' || event_id % 4 AS source, json_extract(props, '$.k')::BIGINT AS k FROM events
),
state AS (
  SELECT c.*, coalesce((SELECT bool_or(i.source IN ('feed_2', 'feed_3')) FROM base i WHERE i.event_type = 'error' AND i.run_id = c.run_id AND i.seq < c.seq), false) AS tainted,
    coalesce((SELECT bool_or(i.event_type = 'view') FROM base i WHERE i.run_id = c.run_id AND i.seq <= c.seq), false) AS private,
    coalesce((SELECT bool_or(i.event_type = 'purchase') FROM base i WHERE i.run_id = c.run_id AND i.seq <= c.seq), false) AS external
  FROM base c WHERE c.event_type <> 'error'
)"""


def trust_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = from_document({"version": "2.0", "sources": [{"name": f"src{k}", "trust": "trusted" if k % 2 else "untrusted"} for k in range(8)]})
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    by_join = trust.sources_by_join(docs, p.tables(spark)["sources"], "source").withColumnRenamed("trust", "trust_by_join")
    return by_join.select("source", "n", "trust_by_join", trust.source_trust(p, F.col("source")).alias("trust"))


TRUST_SQL = "SELECT source, count(*) AS n, CASE WHEN source IN ('src1','src3','src5','src7') THEN 'trusted' ELSE 'untrusted' END AS trust, CASE WHEN source IN ('src1','src3','src5','src7') THEN 'trusted' ELSE 'untrusted' END AS trust_by_join FROM documents GROUP BY source"


def untrusted_sources_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = from_document({"version": "2.0", "sources": [{"name": f"src{k}", "trust": "trusted"} for k in range(5)]})
    docs = table(spark, sf_dir, "documents").where(trust.is_untrusted(p, F.col("source")))
    return docs.groupBy("lang").agg(ordered(F.collect_set("source")).alias("untrusted_sources"), F.count("*").alias("n"))


UNTRUSTED_SQL = "SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS untrusted_sources, count(*) AS n FROM documents WHERE source IS NULL OR source NOT IN ('src0','src1','src2','src3','src4') GROUP BY lang"


def _conversations(spark: SparkSession, sf_dir: str, mode: str = "enforce") -> DataFrame:
    return decide.check(tables.conversation_calls(spark, sf_dir), policy(CONVERSATIONS), tables.conversation_ingress(spark, sf_dir), mode)


def decide_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select(
        "run_id",
        "seq",
        "tool",
        "action",
        "outcome",
        F.coalesce("matched_rule", F.lit("-")).alias("rule"),
        "max_trust",
        joined(F.col("untrusted_sources")).alias("untrusted"),
        ordered(F.col("trifecta")).alias("trifecta"),
    )


DECIDE_SQL = f"""WITH {_CONV}
SELECT run_id, turn AS seq, tool, CASE WHEN verdict = 'error' THEN 'block' ELSE split_part(verdict, '|', 1) END AS action,
  CASE WHEN verdict = 'error' THEN 'evaluation_error' ELSE split_part(verdict, '|', 1) END AS outcome,
  CASE WHEN verdict = 'error' OR split_part(verdict, '|', 2) = '' THEN '-' ELSE split_part(verdict, '|', 2) END AS rule,
  CASE WHEN untrusted THEN 'untrusted' ELSE 'trusted' END AS max_trust, CASE WHEN untrusted THEN label_source ELSE '' END AS untrusted,
  array_to_string(list_filter([CASE WHEN untrusted THEN 'from_untrusted' END, CASE tool WHEN 'default.tool_1' THEN 'reaches_external' WHEN 'default.tool_0' THEN 'reads_private' END], lambda x: x IS NOT NULL), ',') AS trifecta
FROM decided"""


def mode_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _conversations(spark, sf_dir).groupBy("action", "outcome", "reject_reason").agg(F.count("*").alias("n"))
    return decide.in_modes(counted).groupBy("mode", "action", "outcome").agg(F.sum("n").alias("n"))


MODE_SQL = f"""WITH {_CONV}, said AS (SELECT split_part(verdict, '|', 1) AS v FROM decided),
m AS (SELECT unnest(['enforce', 'monitor', 'dry_run']) AS mode)
SELECT mode, CASE WHEN mode = 'dry_run' THEN 'allow' WHEN v = 'error' THEN CASE mode WHEN 'enforce' THEN 'block' ELSE 'allow' END ELSE v END AS action,
  CASE WHEN v = 'error' THEN 'evaluation_error' ELSE v END AS outcome, count(*) AS n FROM said, m GROUP BY ALL"""


def run_tainted_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select(
        "run_id",
        "seq",
        "run_tainted",
        joined(F.col("run_sources")).alias("run_sources"),
        joined(F.col("run_untrusted_sources")).alias("run_untrusted"),
        joined(F.col("run_ingested_by")).alias("run_ingested_by"),
    )


TAINTED_SQL = f"""WITH {_CONV},
firsts AS (SELECT c.run_id, c.turn, i.source, min(i.turn) AS pos FROM calls c JOIN ing i ON i.conv_id = c.conv_id AND i.turn < c.turn GROUP BY ALL),
agents AS (SELECT c.run_id, c.turn, i.source, i.agent, min(i.turn) AS pos FROM calls c JOIN ing i ON i.conv_id = c.conv_id AND i.turn < c.turn GROUP BY ALL),
flat AS (SELECT a.run_id, a.turn, a.agent, min(f.pos * 1000 + a.pos) AS place FROM agents a JOIN firsts f USING (run_id, turn, source) GROUP BY ALL),
s AS (SELECT run_id, turn, string_agg(source, ',' ORDER BY pos) AS run_sources, coalesce(string_agg(source, ',' ORDER BY pos) FILTER (source <> 'user_0'), '') AS run_untrusted, bool_or(source <> 'user_0') AS t FROM firsts GROUP BY ALL),
g AS (SELECT run_id, turn, string_agg(agent, ',' ORDER BY place) AS run_ingested_by FROM flat GROUP BY ALL)
SELECT c.run_id, c.turn AS seq, coalesce(t, false) AS run_tainted, coalesce(run_sources, '') AS run_sources, coalesce(run_untrusted, '') AS run_untrusted, coalesce(run_ingested_by, '') AS run_ingested_by
FROM calls c LEFT JOIN s USING (run_id, turn) LEFT JOIN g USING (run_id, turn)"""


def run_trifecta_rule_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decide.check(tables.event_calls(spark, sf_dir), policy(EVENTS), tables.event_ingress(spark, sf_dir))
    return got.select(
        "event_id",
        "action",
        F.coalesce("matched_rule", F.lit("-")).alias("rule"),
        "run_tainted",
        ordered(F.col("run_trifecta")).alias("run_trifecta"),
    )


RULE_OF_TWO_SQL = f"""WITH {_EVENT}
SELECT event_id, tainted AS run_tainted,
  array_to_string(list_filter([CASE WHEN tainted THEN 'from_untrusted' END, CASE WHEN external THEN 'reaches_external' END, CASE WHEN private THEN 'reads_private' END], lambda x: x IS NOT NULL), ',') AS run_trifecta,
  CASE WHEN event_type = 'purchase' AND tainted AND private THEN 'block' WHEN event_type = 'purchase' AND tainted THEN 'require_approval' WHEN event_type = 'click' AND k > 50 AND tainted THEN 'block' WHEN event_type = 'click' AND k < 10 THEN 'require_approval' ELSE 'allow' END AS action,
  CASE WHEN event_type = 'purchase' AND tainted AND private THEN 'rule_of_two' WHEN event_type = 'purchase' AND tainted THEN 'tainted_run' WHEN event_type = 'purchase' THEN 'rest' WHEN event_type = 'click' AND k > 50 AND tainted THEN 'big_key' WHEN event_type = 'click' AND k < 10 THEN 'low_key' ELSE '-' END AS rule
FROM state"""


def decide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decide.check(tables.line_calls(spark, sf_dir), policy(LINES), tables.line_ingress(spark, sf_dir))
    return got.select("run_id", "seq", "action", F.coalesce("matched_rule", F.lit("-")).alias("rule"), "run_tainted")


LINES_SQL = """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey % 4 AS step, l_suppkey % 5 AS s, l_returnflag = 'R' AS ret, l_quantity AS q, l_linestatus AS st FROM lineitem),
w AS (SELECT *, coalesce(bool_or(ret AND s > 2) OVER p, false) AS t, coalesce(bool_or(ret AND s = 4) OVER p, false) AS four, bool_or(step = 0) OVER c AS priv FROM l
  WINDOW p AS (PARTITION BY o ORDER BY n RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c AS (PARTITION BY o ORDER BY n RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT o::VARCHAR AS run_id, n::BIGINT AS seq, t AS run_tainted,
  CASE WHEN step = 0 AND s > 2 AND q > 40 THEN 'block' WHEN step = 1 AND t AND priv THEN 'block' WHEN step = 1 AND st = 'O' AND t THEN 'require_approval' WHEN step = 2 AND four THEN 'require_approval' ELSE 'allow' END AS action,
  CASE WHEN step = 0 AND s > 2 AND q > 40 THEN 'many_untrusted' WHEN step = 1 AND t AND priv THEN 'rule_of_two' WHEN step = 1 AND st = 'O' AND t THEN 'open_line' WHEN step = 2 AND four THEN 'untrusted_run' WHEN step = 2 THEN 'rest' ELSE '-' END AS rule
FROM w"""


def decide_lines_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide_lines(spark, sf_dir).groupBy("action", "rule", "run_tainted").agg(F.count("*").alias("n"))


def args_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {
        "big": "args.k > 50",
        "has_k": "has(args.k)",
        "has_z": "has(args.z)",
        "sum": "args.k + 1 == 8",
        "text": 'args.k == "7"',
        "between": "args.k >= 20 && args.k <= 30 || args.k == 99",
        "absorbed": 'args.z == "x" && args.k < 0',
        "modulo": "int(args.k) % 7 == 3",
        "choice": "args.k > 50 ? args.k < 60 : args.k < 5",
        "member": '"k" in args',
        "tool_in": 'tool in ["default.view", "default.click"]',
        "ends": 'tool.endsWith("view") || tool.startsWith("default.s") || tool.contains("urch")',
        "matched": 'tool.matches("^default\\\\.[cs]")',
    }
    calls = tables.event_calls(spark, sf_dir).withColumn("args", F.try_parse_json("args"))
    scope = {"args": Typed(F.col("args"), "variant"), "tool": Typed(F.col("tool"), "string")}
    said = [F.coalesce(to_column(t, scope).cast("string"), F.lit("error")).alias(k) for k, t in tests.items()]
    return calls.select("event_id", *said)


ARGS_SQL = """WITH b AS (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, 'default.' || event_type AS tool FROM events WHERE event_type <> 'error')
SELECT event_id, (k > 50)::VARCHAR AS big, 'true' AS has_k, 'false' AS has_z, (k = 7)::VARCHAR AS "sum", 'error' AS "text", (k BETWEEN 20 AND 30 OR k = 99)::VARCHAR AS "between",
  CASE WHEN k < 0 THEN 'error' ELSE 'false' END AS absorbed, (k % 7 = 3)::VARCHAR AS modulo, (CASE WHEN k > 50 THEN k < 60 ELSE k < 5 END)::VARCHAR AS choice, 'true' AS member,
  (tool IN ('default.view', 'default.click'))::VARCHAR AS tool_in, (tool LIKE '%view' OR tool LIKE 'default.s%' OR tool LIKE '%urch%')::VARCHAR AS ends, (regexp_matches(tool, '^default\\.[cs]'))::VARCHAR AS matched FROM b"""


def cel_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantifiers and list functions over the run's context."""
    tests = {
        "any_user1": 'run.sources.exists(s, s == "user_1")',
        "all_users": 'run.sources.all(s, s.startsWith("user_"))',
        "one_user0": 'run.sources.exists_one(s, s == "user_0")',
        "mapped": 'size(run.sources.map(s, s + "!")) == size(run.sources)',
        "filtered": 'size(run.sources.filter(s, s != "user_2")) >= 1',
        "nested": 'taint.exists(t, t.lineage.exists(s, s == "user_2"))',
        "ingested": 'taint.exists(t, t.ingested_by.exists(a, a == "agent-1"))',
        "first": 'size(run.sources) > 0 && run.sources[0] == "user_0"',
        "legs": 'trifecta.contains("reads_private") || run.trifecta.contains("reaches_external")',
        "agent": 'agent.id == "agent-2" || "staff" in agent.groups',
        "counted": "run.sources.reduce(n, s, 0, n + 1) == 2",
        "unlabeled": "size(taint) == 0",
    }
    rules = "".join(f"      - {{name: r, when: '{t}', action: allow}}\n" for t in tests.values())
    p = policy(CONVERSATIONS)
    from_text(f'version: "2.0"\nsinks:\n  default.x:\n    rules:\n{rules}')  # each compiles as a rule of a policy, too
    from provlake.plans.compile import to_column

    calls = runs.with_run_state(decide.prepared(tables.conversation_calls(spark, sf_dir)), tables.conversation_ingress(spark, sf_dir), p)
    rows = decide.with_context(calls, p)
    return rows.select("run_id", "seq", *[F.coalesce(to_column(t).cast("string"), F.lit("error")).alias(k) for k, t in tests.items()])


MACRO_SQL = f"""WITH {_CONV},
r AS (SELECT c.*, coalesce((SELECT list(s ORDER BY pos) FROM (SELECT i.source AS s, min(i.turn) AS pos FROM ing i WHERE i.conv_id = c.conv_id AND i.turn < c.turn GROUP BY 1)), []) AS s,
  coalesce((SELECT bool_or((d.conv_id + d.turn) % 4 = 1) FROM conversations d WHERE d.role = 'assistant' AND d.conv_id = c.conv_id AND d.turn <= c.turn), false) AS ext FROM calls c)
SELECT run_id, turn AS seq, list_contains(s, 'user_1')::VARCHAR AS any_user1, 'true' AS all_users, list_contains(s, 'user_0')::VARCHAR AS one_user0, 'true' AS mapped,
  (len(list_filter(s, lambda x: x <> 'user_2')) >= 1)::VARCHAR AS filtered, coalesce(label_source = 'user_2', false)::VARCHAR AS nested, coalesce(label_agent = 'agent-1', false)::VARCHAR AS ingested,
  (len(s) > 0 AND s[1] = 'user_0')::VARCHAR AS "first", (tool = 'default.tool_0' OR ext)::VARCHAR AS legs, (agent_id IN ('agent-0', 'agent-1', 'agent-2'))::VARCHAR AS agent,
  (len(s) = 2)::VARCHAR AS counted, (label_source IS NULL)::VARCHAR AS unlabeled FROM r"""


def _two_labels() -> tuple[Column, Column]:
    key = F.col("doc_id")
    a = labels.fresh(F.col("source"), key, F.concat(F.lit("a"), (key % 2).cast("string")))
    b = labels.fresh(
        F.concat(F.lit("label_"), F.col("quality").cast("string")),
        F.concat(F.lit("q"), key.cast("string")),
        F.concat(F.lit("a"), (key % 3).cast("string")),
    )
    return F.when(key % 5 != 0, a), F.when(F.col("quality").isNotNull(), b)


def label_merge_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    a, b = _two_labels()
    a = F.when(F.col("doc_id") % 7 == 0, labels.endorse(labels.endorse(a, "scanned"), "reviewed")).otherwise(a)
    b = F.when(F.col("doc_id") % 2 == 0, labels.endorse(b, "reviewed")).otherwise(b)
    # Labels as columns of their own: an expression that uses one twice does not repeat what made it.
    rows = rows.withColumns({"a": a, "b": b})
    a, b = F.col("a"), F.col("b")
    rows = rows.withColumns({"m": labels.merge(a, b), "d": labels.derive("model", labels.present(a, b), F.col("doc_id"), F.lit("a9"))})
    m, d = F.col("m"), F.col("d")
    return rows.select(
        "doc_id",
        F.coalesce(m["source"], F.lit("-")).alias("source"),
        F.coalesce(joined(m["lineage"]), F.lit("-")).alias("lineage"),
        F.coalesce(joined(m["ingested_by"]), F.lit("-")).alias("ingested_by"),
        F.coalesce(joined(m["endorsements"]), F.lit("-")).alias("endorsements"),
        F.coalesce(m["value_id"] == a["value_id"], F.lit(False)).alias("same_id"),
        F.coalesce(d["source"], F.lit("-")).alias("derived"),
        F.coalesce(joined(d["ingested_by"]), F.lit("-")).alias("derived_by"),
        F.coalesce(joined(d["endorsements"]), F.lit("-")).alias("derived_endorsements"),
    )


MERGE_SQL = """WITH x AS (
  SELECT d.doc_id, CASE WHEN d.doc_id % 5 <> 0 THEN coalesce(d.source, '') END AS a, 'a' || d.doc_id % 2 AS aa, CASE WHEN quality IS NOT NULL THEN 'label_' || quality END AS b, 'a' || d.doc_id % 3 AS ba,
    CASE WHEN d.doc_id % 7 = 0 THEN 'scanned,reviewed' ELSE '' END AS ae, CASE WHEN d.doc_id % 2 = 0 THEN 'reviewed' ELSE '' END AS be
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, coalesce(a, b, '-') AS source, CASE WHEN a IS NULL AND b IS NULL THEN '-' WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE a || ',' || b END AS lineage,
  CASE WHEN a IS NULL AND b IS NULL THEN '-' WHEN a IS NULL THEN ba WHEN b IS NULL OR aa = ba THEN aa ELSE aa || ',' || ba END AS ingested_by,
  CASE WHEN a IS NULL AND b IS NULL THEN '-' WHEN a IS NULL THEN be WHEN b IS NULL THEN ae WHEN ae <> '' AND be <> '' THEN 'reviewed' ELSE '' END AS endorsements,
  a IS NOT NULL AND b IS NULL AS same_id, CASE WHEN a IS NULL AND b IS NULL THEN '-' ELSE 'model' END AS derived,
  CASE WHEN a IS NULL AND b IS NULL THEN '-' WHEN a IS NULL THEN ba WHEN b IS NULL OR aa = ba THEN aa ELSE aa || ',' || ba END || CASE WHEN a IS NULL AND b IS NULL THEN '' ELSE ',a9' END AS derived_by,
  CASE WHEN a IS NULL AND b IS NULL THEN '-' ELSE '' END AS derived_endorsements FROM x"""


def endorsement_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    fresh = labels.fresh(F.col("source"), F.col("doc_id"))
    made = F.when(F.col("quality") == 1, labels.endorse(fresh, "reviewed")).otherwise(labels.endorse(fresh, "seen"))
    calls = rows.select(
        F.col("doc_id").cast("string").alias("run_id"),
        F.col("doc_id").alias("seq"),
        F.lit("agent-1").alias("agent_id"),
        F.lit("publish").alias("tool"),
        F.lit("{}").alias("args"),
        F.array(made).alias("labels"),
        labels.endorsement_record(fresh, "reviewed", "by label")["kind"].alias("recorded"),
    )
    p = from_text(
        'version: "2.0"\nsources: [{name: src1, trust: trusted}]\nsinks: {default.publish: {rules: [{name: gate, require_endorsement: reviewed, action: block}, {name: rest, action: allow}]}}'
    )
    return decide.check(calls, p).select(F.col("seq").alias("doc_id"), "tool", "action", "matched_rule", "recorded")


ENDORSE_SQL = """SELECT doc_id, 'default.publish' AS tool, CASE WHEN quality = 1 OR source = 'src1' THEN 'allow' ELSE 'block' END AS action, CASE WHEN quality = 1 OR source = 'src1' THEN 'rest' ELSE 'gate' END AS matched_rule, 'reviewed' AS recorded
FROM documents JOIN labels USING (doc_id)"""


def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages enter untrusted runs, documents are unlabeled arguments of calls in them; a run is a number mod 8."""
    bench, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    ingress = bench.select(
        (F.col("item_id") % 8).cast("string").alias("run_id"),
        F.col("item_id").alias("seq"),
        F.concat(F.lit("bench_"), (F.col("item_id") % 3).cast("string")).alias("source"),
        "text",
    )
    leaves = docs.select(
        (F.col("doc_id") % 8).cast("string").alias("run_id"),
        (F.col("doc_id") + 20).alias("seq"),
        F.lit("agent-1").alias("agent_id"),
        F.concat(F.lit("default."), F.col("lang")).alias("tool"),
        F.lit("body").alias("argument"),
        "text",
        F.when(F.col("doc_id") % 11 == 0, labels.fresh("web", F.col("doc_id"))).otherwise(labels.none()).alias("label"),
    )
    p = from_text('version: "2.0"\nsources: [{name: bench_0, trust: trusted}]')
    return audit.findings(leaves, p, ingress).select("run_id", "source", "tool", "argument", "seq", "agent_id")


AUDIT_SQL = """WITH reg AS (SELECT item_id % 8 AS r, item_id + 1 AS from_seq, 'bench_' || item_id % 3 AS source, text FROM benchmark WHERE length(text) >= 12 AND item_id % 3 <> 0
  UNION ALL SELECT doc_id % 8, doc_id + 20, 'web', text FROM documents WHERE doc_id % 11 = 0 AND length(text) >= 12),
leaf AS (SELECT doc_id % 8 AS r, doc_id + 20 AS seq, 'default.' || lang AS tool, text FROM documents WHERE doc_id % 11 <> 0 AND length(text) >= 12)
SELECT leaf.r::VARCHAR AS run_id, source, tool, 'body' AS argument, min(seq) AS seq, 'agent-1' AS agent_id FROM leaf JOIN reg ON leaf.r = reg.r AND from_seq <= seq AND contains(leaf.text, reg.text) GROUP BY 1, 2, 3"""


def inspect_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decide.check(tables.event_calls(spark, sf_dir), policy(EVENTS), tables.event_ingress(spark, sf_dir), "monitor")
    recs = decide.events(got).withColumns({c: F.lit(None).cast("string") for c in ("run_id", "agent_id")})
    return records.counts(recs).select(
        "run_id",
        F.coalesce("agent_id", F.lit("-")).alias("agent_id"),
        "level",
        "n_events",
        "n_findings",
        "n_endorsements",
    )


INSPECT_SQL = f"""WITH {_EVENT}
SELECT run_id, coalesce(agent_id, '-') AS agent_id, CASE WHEN grouping(agent_id) = 1 THEN 'run' ELSE 'agent' END AS level, count(*) AS n_events, 0::BIGINT AS n_findings, 0::BIGINT AS n_endorsements
FROM state GROUP BY GROUPING SETS ((run_id, agent_id), (run_id))"""


def sink_default_fallthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = from_text(
        'version: "2.0"\ndefaults: {sink_action: block, fail_mode: monitor}\nsinks: {default.view: {capabilities: []}, default.click: {rules: [{name: low, when: "args.k < 10", action: allow}]}}'
    )
    got = decide.check(tables.event_calls(spark, sf_dir), p, mode="enforce", env_mode=None)
    return got.groupBy("tool", "action", "mode", F.coalesce("matched_rule", F.lit("-")).alias("rule")).agg(F.count("*").alias("n"))


DEFAULT_SQL = """WITH b AS (SELECT json_extract(props, '$.k')::BIGINT AS k, event_type AS e FROM events WHERE event_type <> 'error')
SELECT 'default.' || e AS tool, CASE WHEN e = 'click' AND k < 10 THEN 'allow' ELSE 'block' END AS action, 'monitor' AS mode, CASE WHEN e = 'click' AND k < 10 THEN 'low' ELSE '-' END AS rule, count(*) AS n FROM b GROUP BY ALL"""


def groups_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls by customers; the market segment decides the agent's groups."""
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    p = from_document(
        {
            "version": "2.0",
            "agents": {s: {"groups": ["buyers"] + (["heavy"] if s in ("BUILDING", "MACHINERY") else [])} for s in segments[:4]},
            "sinks": {
                "default.order": {
                    "rules": [
                        {"name": "heavy", "when": 'agent.groups.exists(g, g == "heavy") && args.price > 100000.0', "action": "block"},
                        {"name": "buyers", "when": '"buyers" in agent.groups', "action": "allow"},
                    ]
                }
            },
        }
    ).compile_check()
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    calls = orders.select(
        F.col("o_custkey").cast("string").alias("run_id"),
        F.col("o_orderkey").alias("seq"),
        F.upper("c_mktsegment").alias("agent_id"),
        F.lit("order").alias("tool"),
        F.to_json(F.struct(F.col("o_totalprice").alias("price"))).alias("args"),
    )
    return decide.check(calls, p).groupBy(
        "agent_id",
        "action",
        F.coalesce("matched_rule", F.lit("-")).alias("rule"),
    ).agg(F.count("*").alias("n"))


GROUPS_SQL = """WITH b AS (SELECT upper(c_mktsegment) AS a, o_totalprice AS p FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT a AS agent_id, CASE WHEN a = 'BUILDING' AND p > 100000 THEN 'block' WHEN a IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD') THEN 'allow' ELSE 'require_approval' END AS action,
  CASE WHEN a = 'BUILDING' AND p > 100000 THEN 'heavy' WHEN a IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD') THEN 'buyers' ELSE '-' END AS rule, count(*) AS n FROM b GROUP BY ALL"""


def unlabeled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id")
    with_, without = docs.join(known, "doc_id", "left_semi"), docs.join(known, "doc_id", "left_anti")
    return with_.groupBy("source").agg(F.count("*").alias("labeled")).join(without.groupBy("source").agg(F.count("*").alias("unlabeled")), "source", "full").select(
        "source",
        F.coalesce("labeled", F.lit(0)).alias("labeled"),
        F.coalesce("unlabeled", F.lit(0)).alias("unlabeled"),
    )


UNLABELED_SQL = "SELECT source, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS labeled, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabeled FROM documents GROUP BY source"


def _pairs() -> tuple[Labeled, Labeled]:
    text = Labeled(F.col("text"), labels.fresh(F.col("source"), F.col("doc_id")))
    lang = Labeled(F.col("lang"), F.when(F.col("doc_id") % 2 == 0, labels.fresh("langs", F.col("lang"))))
    return text, lang


def _said(x: Labeled, name: str) -> list[Column]:
    return [x.value.alias(name), F.coalesce(joined(x.label["lineage"]), F.lit("-")).alias(f"{name}_from")]


def _label_ops(docs: DataFrame, head: Labeled, lang: Labeled) -> DataFrame:
    cases = {
        "added": strings.concat(head, lang),
        "radded": strings.concat(plain(">> "), head),
        "replaced": strings.replace(head, "e", lang, 2),
        "formatted": strings.percent(Labeled(F.lit("%s/%s"), labels.none()), lang, head),
        "filled": strings.format_text("{0}-{x}", labels.none(), lang, x=head),
        "joined": strings.join(Labeled(F.lit(", "), labels.fresh("sep", F.lit(1))), head, lang),
        "lost": strings.join_plain(", ", head, lang),
        "spec": strings.format_spec(head, "30"),
        "upper": strings.upper(lang),
    }
    return docs.select("doc_id", *[c for k, x in cases.items() for c in _said(x, k)])


def string_ops_labels_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """string_ops_labels with every function over the whole text."""
    return _label_ops(table(spark, sf_dir, "documents"), *_pairs())


_M = "CASE WHEN doc_id % 2 = 0 THEN ',langs' ELSE '' END"
_ML = "CASE WHEN doc_id % 2 = 0 THEN 'langs,' ELSE '' END"
LABEL_OPS_SQL = f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, lang, text AS h FROM documents),
p AS (SELECT *, string_split(h, 'e') AS s FROM d)
SELECT doc_id, h || lang AS added, source || {_M} AS added_from, '>> ' || h AS radded, source AS radded_from,
  CASE len(s) WHEN 1 THEN h WHEN 2 THEN s[1] || lang || s[2] ELSE s[1] || lang || s[2] || lang || array_to_string(s[3:], 'e') END AS replaced, source || {_M} AS replaced_from,
  lang || '/' || h AS formatted, {_ML} || source AS formatted_from, lang || '-' || h AS filled, {_ML} || source AS filled_from, h || ', ' || lang AS joined, 'sep,' || source || {_M} AS joined_from,
  h || ', ' || lang AS lost, '-' AS lost_from, lpad(h, greatest(30, length(h))::INT, ' ') AS spec, '-' AS spec_from, upper(lang) AS upper, CASE WHEN doc_id % 2 = 0 THEN 'langs' ELSE '-' END AS upper_from FROM p"""


def _value_ops(docs: DataFrame, text: Labeled, head: Labeled) -> DataFrame:
    padded = Labeled(F.concat(F.lit(" \t"), head.value, F.lit("\n ")), labels.none())
    part = strings.partition(head, " ")
    rpart = strings.rpartition(head, " ")
    return docs.select(
        "doc_id",
        strings.strip(padded).value.alias("stripped"),
        strings.strip(head, "T.e").value.alias("stripped_chars"),
        F.array_join(strings.split(padded).value, "|").alias("words"),
        F.array_join(strings.split(head, "e", 2).value, "|").alias("split2"),
        strings.slice_(text, -5).value.alias("tail"),
        strings.ljust(head, 30, "*").value.alias("ljust"),
        strings.rjust(head, 30).value.alias("rjust"),
        strings.zfill(Labeled((F.col("doc_id") * -1).cast("string"), labels.none()), 8).value.alias("zfill"),
        strings.removeprefix(head, "The ").value.alias("noprefix"),
        strings.capitalize(strings.upper(Labeled(F.col("lang"), labels.none()))).value.alias("capital"),
        part.value["head"].alias("first_word"),
        rpart.value["tail"].alias("last_word"),
        F.size(strings.splitlines(text).value).alias("n_lines"),
        strings.repeat(Labeled(F.col("lang"), labels.none()), 3).value.alias("thrice"),
        F.hex(strings.encode(Labeled(F.col("lang"), labels.none())).value).alias("encoded"),
    )


def string_ops_values_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """string_ops_values with every function over the whole text."""
    text = Labeled(F.col("text"), labels.none())
    return _value_ops(table(spark, sf_dir, "documents"), text, text)


VALUES_SQL = """WITH d AS (SELECT doc_id, text, lang, text AS h FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(h, '^[\\s]+', ''), '[\\s]+$', '') AS stripped, trim(h, 'T.e') AS stripped_chars, array_to_string(list_filter(regexp_split_to_array(h, '\\s+'), lambda x: x <> ''), '|') AS words,
  CASE WHEN len(string_split(h, 'e')) <= 3 THEN array_to_string(string_split(h, 'e'), '|') ELSE array_to_string(string_split(h, 'e')[1:2], '|') || '|' || array_to_string(string_split(h, 'e')[3:], 'e') END AS split2,
  right(text, 5) AS tail, h || repeat('*', greatest(0, 30 - length(h))::INT) AS ljust, repeat(' ', greatest(0, 30 - length(h))::INT) || h AS rjust,
  CASE WHEN doc_id = 0 THEN '00000000' ELSE '-' || lpad(doc_id::VARCHAR, greatest(7, length(doc_id::VARCHAR))::INT, '0') END AS zfill, CASE WHEN starts_with(h, 'The ') THEN substr(h, 5) ELSE h END AS noprefix,
  upper(substr(lang, 1, 1)) || substr(lang, 2) AS capital, CASE WHEN contains(h, ' ') THEN split_part(h, ' ', 1) ELSE h END AS first_word, split_part(h, ' ', -1) AS last_word,
  (len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 1 ELSE 0 END)::INT AS n_lines, repeat(lang, 3) AS thrice, hex(encode(lang)) AS encoded FROM d"""


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    agent = F.when(F.col("doc_id") % 7 == 0, F.lit("bad agent")).when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.lit("a-1"))
    tool = F.when(F.col("doc_id") % 11 == 0, F.lit("a.b.c")).when(F.col("doc_id") % 3 == 0, F.lit("ns.tool")).otherwise(F.lit("bare"))
    args = F.when(F.col("doc_id") % 13 == 0, F.lit("{")).otherwise(F.lit("{}"))
    calls = docs.select(
        F.lit(None).cast("string").alias("run_id"),
        F.col("doc_id").alias("seq"),
        agent.alias("agent_id"),
        tool.alias("tool"),
        args.alias("args"),
    )
    got = decide.release(
        decide.check(calls, from_text('version: "2.0"\nsinks: {ns.tool: {rules: [{name: all, action: allow}]}}')),
        lambda df: F.col("seq") % 2 == 0,
    )
    return got.select(
        F.col("seq").alias("doc_id"),
        "tool",
        "agent_id",
        F.coalesce("reject_reason", F.lit("-")).alias("reject_reason"),
        F.coalesce("action", F.lit("-")).alias("action"),
        "released",
        F.coalesce(decide.message(), F.lit("-")).alias("message"),
        names.explicit_agent_is_valid(F.col("agent_id")).alias("explicit"),
    )


REJECTED_SQL = """WITH b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'bad agent' WHEN doc_id % 5 = 0 THEN 'default' ELSE 'a-1' END AS agent_id, CASE WHEN doc_id % 11 = 0 THEN 'a.b.c' WHEN doc_id % 3 = 0 THEN 'ns.tool' ELSE 'default.bare' END AS tool,
  CASE WHEN doc_id % 11 = 0 THEN 'invalid tool name' WHEN doc_id % 7 = 0 THEN 'invalid agent id' WHEN doc_id % 13 = 0 THEN 'arguments are no object' ELSE '-' END AS reject_reason FROM documents),
v AS (SELECT *, CASE WHEN reject_reason <> '-' THEN '-' WHEN tool = 'ns.tool' THEN 'allow' ELSE 'require_approval' END AS action FROM b)
SELECT doc_id, tool, agent_id, reject_reason, action, action = 'allow' OR (action = 'require_approval' AND doc_id % 2 = 0) AS released,
  CASE WHEN action = 'require_approval' THEN 'call to ' || tool || ' needs approval by rule default and got none' ELSE '-' END AS message, agent_id = 'a-1' AS explicit FROM v"""


def envelope_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of conversations, some tampered with, read back with the key, the wrong key and none."""
    key = b"0123456789abcdef0123456789abcdef"
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.to_json(F.struct("role", "turn", "text")).alias("body"))
    label = labels.fresh(F.concat(F.lit("user_"), (F.col("conv_id") % 3).cast("string")), F.concat_ws("/", "conv_id", "turn"))
    leaves = F.array(F.struct(F.lit("$.role").alias("path"), label.alias("label"), F.lit("str").alias("carrier")))
    run = F.array(
        F.struct(F.lit("web").alias("source"), F.lit("untrusted").alias("trust"), F.array(F.lit("b"), F.lit("a")).alias("ingested_by"))
    )
    sent = t.withColumn(
        "signed",
        envelope.pack(F.col("body"), leaves, run, F.array(F.lit("reads_private")), key, "k1"),
    ).withColumn("plain", envelope.pack(F.col("body"), leaves))
    case = F.col("conv_id") % 6
    got = F.when(case == 0, F.col("signed")).when(case == 1, F.replace(F.col("signed"), F.lit("untrusted"), F.lit("trusted"))).when(case == 2, F.replace(F.col("signed"), F.lit("user_"), F.lit("hacker_"))).when(
        case == 3,
        F.replace(F.col("signed"), F.lit('"version":3'), F.lit('"version":2')),
    ).when(case == 4, F.replace(F.col("plain"), F.lit('"label":0'), F.lit('"label":9'))).otherwise(F.col("plain"))
    sent = sent.withColumn("wire", envelope.unpack_from(envelope.pack_into(F.lit('{"other":1}'), got)))
    read = envelope.unpack(sent, "wire", key)
    e = F.col("envelope")
    return read.select(
        "conv_id",
        "turn",
        F.coalesce("reject_reason", F.lit("-")).alias("reject_reason"),
        F.coalesce(envelope.label_at(e, "$.role")["source"], F.lit("-")).alias("label"),
        F.coalesce(envelope.value_at(e, "$.role"), F.lit("-")).alias("role"),
        F.coalesce(joined(F.get(e["run"]["sources"], F.lit(0))["ingested_by"]), F.lit("-")).alias("ingested_by"),
    )


ENVELOPE_SQL = """SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN '-' WHEN 1 THEN '-' WHEN 2 THEN 'wrong code' WHEN 3 THEN 'version' WHEN 4 THEN 'schema' ELSE 'not signed' END AS reject_reason,
  CASE WHEN conv_id % 6 < 2 THEN 'user_' || conv_id % 3 ELSE '-' END AS label, CASE WHEN conv_id % 6 < 2 THEN role ELSE '-' END AS role, CASE WHEN conv_id % 6 < 2 THEN 'a,b' ELSE '-' END AS ingested_by FROM conversations"""


def variant_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.try_parse_json(
            F.to_json(
                F.struct(
                    "role",
                    F.array(F.struct(F.col("role").alias("r"), "turn")).alias("deep"),
                    F.struct(F.struct(F.struct(F.struct(F.struct("role").alias("e")).alias("d")).alias("c")).alias("b")).alias("a"),
                )
            )
        ).alias("v"),
    )
    return nested.explode_variant(t, "v", ["conv_id", "turn"], 4)


LEAVES_SQL = "SELECT conv_id, turn, unnest(['$.role', '$.deep[0].r']) AS path, role AS text FROM conversations WHERE role IS NOT NULL"


def variant_leaves_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as leaves of variants."""
    body = F.struct("role", "text", F.array(F.struct(F.col("text").alias("r"), "turn")).alias("deep"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.try_parse_json(F.to_json(body)).alias("v"))
    return nested.explode_variant(t, "v", ["conv_id", "turn"], 4)


LEAVES_TEXT_SQL = """SELECT conv_id, turn, '$.role' AS path, role AS text FROM conversations WHERE role IS NOT NULL
UNION ALL SELECT conv_id, turn, unnest(['$.text', '$.deep[0].r']) AS path, text FROM conversations WHERE text IS NOT NULL"""


def describe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decide.events(_conversations(spark, sf_dir, "monitor"))
    extra = {
        c: F.lit(None).cast(k) for c, k in (
            ("source", "string"),
            ("tool", "string"),
            ("argument", "string"),
            ("kind", "string"),
            ("note", "string"),
            ("lineage", "array<string>"),
            ("agent_id", "string"),
            ("run_id", "string"),
            ("session_id", "string"),
        )
    }
    got = got.withColumns(extra)
    r = F.struct(*got.columns)
    a = describe.span_attributes(r)
    return got.select(
        F.col("decision.run_id").alias("run"),
        describe.event(r).alias("event"),
        describe.decision(F.col("decision"), markup=True).alias("decision"),
        a["provlake.outcome"].alias("outcome"),
        a["provlake.run_ingested_sources"].alias("ingested"),
        F.map_contains_key(a, F.lit("provlake.session_id")).alias("has_session"),
        a["gen_ai.tool.name"].alias("tool_name"),
    )


DESCRIBE_SQL = f"""WITH {_CONV},
pairs AS (SELECT c.run_id, c.turn, i.source, i.agent, min(i.turn) AS pos FROM calls c JOIN ing i ON i.conv_id = c.conv_id AND i.turn < c.turn GROUP BY ALL),
per AS (SELECT run_id, turn, source, source || '@' || string_agg(agent, '+' ORDER BY pos) AS named FROM pairs GROUP BY run_id, turn, source),
st AS (SELECT run_id, turn, bool_or(source <> 'user_0') AS t, string_agg(named, '|' ORDER BY named) FILTER (source <> 'user_0') AS unt, '[' || string_agg('"' || source || '"', ',' ORDER BY source) || ']' AS ingested FROM per GROUP BY run_id, turn),
legs AS (SELECT c.run_id, c.turn, bool_or((d.conv_id + d.turn) % 4 = 0) AS priv, bool_or((d.conv_id + d.turn) % 4 = 1) AS ext FROM calls c JOIN conversations d ON d.role = 'assistant' AND d.conv_id = c.conv_id AND d.turn <= c.turn GROUP BY ALL),
w AS (SELECT d.*, CASE WHEN verdict = 'error' THEN 'allow' ELSE split_part(verdict, '|', 1) END AS action, CASE WHEN verdict = 'error' THEN 'evaluation_error' ELSE split_part(verdict, '|', 1) END AS outcome,
  nullif(split_part(verdict, '|', 2), '') AS rule, coalesce(t, false) AS t, coalesce('; run untrusted: ' || unt, '') AS unt, ingested,
  coalesce(label_source, 'none') AS src, coalesce(label_agent, 'none') AS by_, CASE WHEN untrusted THEN label_source ELSE 'none' END AS us,
  array_to_string(list_filter([CASE WHEN t THEN 'from_untrusted' END, CASE WHEN ext THEN 'reaches_external' END, CASE WHEN priv THEN 'reads_private' END], lambda x: x IS NOT NULL), '|') AS rt
  FROM decided d LEFT JOIN st USING (run_id, turn) LEFT JOIN legs USING (run_id, turn)),
said AS (SELECT *, CASE action WHEN 'allow' THEN 'cyan' WHEN 'block' THEN 'magenta' ELSE 'blue' END AS c, '; by: ' || coalesce(rule, '(no rule)') AS by_rule,
  CASE rule WHEN 'long_untrusted' THEN $$; since: taint.exists(t, t.trust == "untrusted") && size(args.text) > 400$$ WHEN 'senior' THEN $$; since: agent.groups.exists(g, g == "senior")$$
    WHEN 'late_turn' THEN $$; since: args.turn >= 4$$ WHEN 'needs_review' THEN $$; since: taint.exists(t, t.trust == "untrusted" && !t.endorsements.exists(k, k == "reviewed"))$$ ELSE '' END AS since FROM w)
SELECT run_id AS run,
  upper(action) || ' ' || tool || by_rule || '; under: monitor; from: ' || src || '; untrusted: ' || us || '; brought by: ' || by_ || '; run tainted: ' || CASE WHEN t THEN 'yes' ELSE 'no' END || unt AS event,
  '<' || c || '>' || upper(action) || '</> ' || tool || by_rule || since || '; under: monitor; untrusted: ' || us || '; brought by: ' || by_ || unt || CASE WHEN rt <> '' THEN '; legs: ' || rt ELSE '' END AS decision,
  outcome, coalesce(ingested, '[]') AS ingested, false AS has_session, tool AS tool_name
FROM said"""


def policy_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static checks of a faulty policy."""
    p = from_document(
        {
            "version": "2.0",
            "agents": {"a": {"groups": ["g"]}, "b": {"groups": ["g"]}},
            "sinks": {
                "default.x": {
                    "capabilities": [],
                    "rules": [
                        {"name": "r1", "when": 'agent.groups.exists(g, g == "g")', "action": "block"},
                        {"name": "r2", "when": 'agent.id == "a"', "action": "block"},
                        {"name": "r3", "when": 'trifecta.contains("reads_all")', "action": "block"},
                        {"name": "r4", "when": "taint.any(t, true)", "action": "block"},
                        {"name": "r5", "when": 'taint.all(t, t.source == "web")', "action": "allow"},
                        {"name": "r6", "when": "run.nothing", "action": "block"},
                        {"name": "r7", "action": "allow"},
                        {"name": "r8", "action": "allow"},
                    ],
                },
                "default.y": {
                    "rules": [
                        {"name": "s1", "when": 'agent.id == "z"', "action": "allow"},
                        {"name": "s2", "when": "a ==", "action": "allow"},
                        {"name": "s3", "when": 'run.sources.all(s, s == "q")', "action": "allow"},
                    ]
                },
            },
        }
    )
    return lint.frame(spark, lint.check(p)).select("severity", "sink", F.coalesce("rule", F.lit("-")).alias("rule"), "code")


LINT_SQL = """SELECT * FROM (VALUES ('error','default.x','r2','shadowed'), ('error','default.x','r3','unknown_leg'), ('error','default.x','r4','any_macro'), ('warning','default.x','r5','label_source'), ('warning','default.x','r5','taint_all_allows'),
 ('error','default.x','r6','unknown_run_field'), ('error','default.x','r8','after_catch_all'), ('error','default.x','r8','second_catch_all'), ('warning','default.y','-','capabilities'), ('warning','default.y','s1','identity_allows'), ('error','default.y','s2','parse'), ('warning','default.y','s3','run_all_allows')) t(severity, sink, rule, code)"""


def explain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = policy(CONVERSATIONS)
    rows = [
        (who, explain.frame(spark, got)) for who, got in (
            ("agent-0", explain.for_agent(p, "agent-0")),
            ("agent-3", explain.for_agent(p, "agent-3")),
            ("group staff", explain.for_group(p, "staff")),
        )
    ]
    out = None
    for who, df in rows:
        part = df.where("sink = 'default.tool_0'").select(
            F.lit(who).alias("who"),
            "ord",
            "rule",
            "outcome",
            F.coalesce("shadowed_by", F.lit("-")).alias("shadowed_by"),
            "depends_on_member",
        )
        out = part if out is None else out.unionByName(part)
    return out


EXPLAIN_SQL = """SELECT * FROM (VALUES ('agent-0',0,'long_untrusted','conditional','-',false), ('agent-0',1,'senior','unconditional','-',false), ('agent-0',2,'late_turn','eliminated','senior',false),
 ('agent-3',0,'long_untrusted','conditional','-',false), ('agent-3',1,'senior','eliminated','-',false), ('agent-3',2,'late_turn','conditional','-',false),
 ('group staff',0,'long_untrusted','conditional','-',false), ('group staff',1,'senior','conditional','-',true), ('group staff',2,'late_turn','conditional','-',false)) t(who, ord, rule, outcome, shadowed_by, depends_on_member)"""


def args_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arguments of a call compared and computed with: whole numbers, decimals of unlike scale, doubles, texts."""
    tests = {
        "less": "args.k < args.ten",
        "whole_and_decimal": "args.k > args.quarter",
        "decimals": "args.quarter > args.fixed",
        "equal": "args.quarter == args.half",
        "total": "args.k + args.ten > 50",
        "mixed_total": "args.k + args.quarter >= 20.5",
        "difference": "args.k - args.ten == args.ten",
        "product": "args.ten * args.quarter > args.k",
        "ratio": "args.k / 7 == args.ten",
        "texts": "args.kind < args.other",
        "unlike": "args.kind == args.k",
        "listed": "args.k in [args.ten, 20, 30]",
        "nothing": "args.none == null || args.kind == args.k",
        "same_list": "args.pair == [args.k, args.ten]",
        "keys": "size(args) == 8 && args.exists(k, k == 'quarter')",
    }
    ten, quarter = F.col("event_id") % 10, (F.col("event_id") % 7) / F.lit(4)
    k = F.get_json_object("props", "$.k").cast("long")
    number = lambda c: F.regexp_replace(F.format_number(c, 2), ",", "")
    parts = [
        '{"k":',
        k,
        ',"ten":',
        ten,
        ',"quarter":',
        number(quarter),
        ',"half":',
        F.when(ten % 2 == 0, F.lit("0.5")).otherwise(F.lit("0.500")),
    ]
    parts += [',"fixed":1.25,"kind":"', F.col("event_type"), '","other":"purchase","none":null,"pair":[', k, ",", ten, "]}"]
    text = F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    calls = table(spark, sf_dir, "events").where("event_type <> 'error'").select("event_id", F.parse_json(text).alias("args"))
    scope = {"args": Typed(F.col("args"), "variant")}
    said = [F.coalesce(to_column(test, scope).cast("string"), F.lit("error")).alias(name) for name, test in tests.items()]
    return calls.select("event_id", *said)


PAIRS_SQL = """WITH b AS (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, event_id % 10 AS ten, (event_id % 7) / 4.0 AS quarter, event_type AS kind FROM events WHERE event_type <> 'error')
SELECT event_id, (k < ten)::VARCHAR AS less, (k > quarter)::VARCHAR AS whole_and_decimal, (quarter > 1.25)::VARCHAR AS decimals, (quarter = 0.5)::VARCHAR AS equal,
  (k + ten > 50)::VARCHAR AS total, (k + quarter >= 20.5)::VARCHAR AS mixed_total, (k - ten = ten)::VARCHAR AS difference, (ten * quarter > k)::VARCHAR AS product,
  (k // 7 = ten)::VARCHAR AS ratio, (kind < 'purchase')::VARCHAR AS texts, 'error' AS unlike, (k IN (ten, 20, 30))::VARCHAR AS listed, 'true' AS nothing, 'true' AS same_list, 'false' AS keys FROM b"""


def string_ops_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text functions on whole texts as bytes; results are read as text again."""
    b = Labeled(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), labels.fresh("docs", F.col("doc_id")), True)
    word, rest = strings.partition(b, b" "), strings.rpartition(b, b" ")
    made = {
        "upper": strings.upper(b).value,
        "swapped": strings.swapcase(b).value,
        "stripped": strings.strip(b).value,
        "replaced": strings.replace(b, b"e", strings.plain(b"EE")).value,
        "filled": strings.zfill(strings.encode(plain(F.col("lang"))), 5).value,
        "padded": strings.ljust(strings.encode(plain(F.col("lang"))), 6, b"*").value,
        "prefix": strings.removeprefix(b, b"The ").value,
        "first": word.value["head"],
        "last": rest.value["tail"],
        "tabs": strings.expandtabs(strings.encode(plain(F.concat("lang", F.lit("\t"), "lang"))), 8).value,
        "cap": strings.capitalize(strings.lower(strings.encode(plain(F.col("lang"))))).value,
    }
    counts = {
        "n_bytes": F.octet_length(b.value),
        "n_words": F.size(strings.split(b).value),
        "n_lines": F.size(strings.splitlines(b).value),
        "code": strings.item(b, 0).value,
    }
    texts = [F.decode(v, "UTF-8").alias(k) for k, v in made.items()]
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        *texts,
        *[F.coalesce(v, F.lit(-1)).cast("long").alias(k) for k, v in counts.items()],
        strings.upper(b).label["source"].alias("label"),
    )


_AZ, _ZA = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BYTES_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang FROM documents)
SELECT doc_id, translate(t, '{_AZ}', '{_ZA}') AS upper, translate(t, '{_AZ}{_ZA}', '{_ZA}{_AZ}') AS swapped, trim(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS stripped,
  replace(t, 'e', 'EE') AS replaced,
  lpad(lang, 5, '0') AS filled,
  lang || '****' AS padded, CASE WHEN starts_with(t, 'The ') THEN substr(t, 5) ELSE t END AS prefix, split_part(t, ' ', 1) AS first, split_part(t, ' ', -1) AS last,
  lang || '      ' || lang AS tabs, upper(left(lang, 1)) || lower(substr(lang, 2)) AS cap, strlen(t)::BIGINT AS n_bytes,
  len(list_filter(regexp_split_to_array(t, '[\t-\r ]+'), lambda x: x <> ''))::BIGINT AS n_words,
  (len(regexp_split_to_array(t, '\r\n|[\n\r]')) - CASE WHEN t = '' OR regexp_matches(t, '[\n\r]$') THEN 1 ELSE 0 END)::BIGINT AS n_lines,
  CASE WHEN t = '' THEN -1 ELSE ('0x' || left(hex(encode(t)), 2))::BIGINT END AS code, 'docs' AS label FROM d"""


def text_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions whose semantics Spark has none for, over whole texts and languages."""
    text, lang = plain(F.coalesce("text", F.lit(""))), plain(F.col("lang"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        strings.casefold(text).value.alias("folded"),
        strings.swapcase(text).value.alias("swapped"),
        strings.title(lang).value.alias("title"),
        strings.expandtabs(plain(F.concat("lang", F.lit("\t"), "lang")), 8).value.alias("tabs"),
        strings.capitalize(plain(F.concat(F.lit("ß"), "lang"))).value.alias("cap"),
        strings.slice_(text, None, None, -1).value.alias("turned"),
        F.array_join(strings.rsplit(text, " ", 1).value, "|").alias("last_apart"),
    )


CASE_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang FROM documents)
SELECT doc_id, replace(lower(t), 'ß', 'ss') AS folded,
  array_to_string(list_transform(string_split(t, ''), lambda c: CASE WHEN c = 'ß' THEN 'SS' WHEN c = upper(c) THEN lower(c) ELSE upper(c) END), '') AS swapped,
  upper(left(lang, 1)) || lower(substr(lang, 2)) AS title, lang || '      ' || lang AS tabs, 'Ss' || lower(lang) AS cap, reverse(t) AS turned,
  CASE WHEN contains(t, ' ') THEN left(t, length(t) - length(split_part(t, ' ', -1)) - 1) || '|' || split_part(t, ' ', -1) ELSE t END AS last_apart FROM d"""


def typed_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of typed values: mapped, collected and counted; bytes are leaves, too."""
    value = F.struct(
        "text",
        F.struct("lang", "n_chars").alias("about"),
        F.array("source", "lang").alias("list"),
        F.create_map(F.lit("k"), F.col("source")).alias("map"),
        F.encode("lang", "UTF-8").alias("raw"),
    )
    t = table(spark, sf_dir, "documents").select("doc_id", value.alias("v"))
    kind = t.schema["v"].dataType
    marked = nested.map_leaves(F.col("v"), kind, lambda x: F.concat(F.lit("<"), x.cast("string"), F.lit(">")))
    found = nested.collect_leaves(F.col("v"), kind)
    return t.select(
        "doc_id",
        marked["about"]["lang"].alias("lang"),
        marked["list"][0].alias("source"),
        marked["raw"].alias("raw"),
        F.size(found).cast("long").alias("n"),
        joined(F.slice(found, 2, 10)).alias("rest"),
        F.lit(len(list(nested.leaf_paths(kind)))).cast("long").alias("n_paths"),
    )


TYPED_SQL = """SELECT doc_id, '<' || lang || '>' AS lang, '<' || source || '>' AS source, '<' || lang || '>' AS raw,
  (3 + 1 + (text IS NOT NULL)::INT + 2 * (source IS NOT NULL)::INT - 0)::BIGINT AS n, concat_ws(',', CASE WHEN text IS NULL THEN NULL ELSE lang END, source, lang, 'k', source, lang) AS rest, 6::BIGINT AS n_paths FROM documents"""


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's output over a document and, for every third, a label of its source: derived labels and endorsements."""
    t = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("source", F.lit("none")).alias("source"))
    a = labels.endorse(labels.fresh(F.col("source"), F.col("doc_id"), F.lit("reader")), "checked")
    b = F.when(F.col("doc_id") % 3 == 0, labels.fresh(F.concat(F.lit("lang_"), "lang"), F.col("doc_id")))
    t = t.select(
        "doc_id",
        labels.track_model_call([a, b], F.col("doc_id"), F.lit("writer")).alias("label"),
        labels.track_model_call([labels.none()], F.col("doc_id")).alias("nothing"),
        labels.endorsement_record(a, "checked", "seen", F.lit("reader")).alias("record"),
    )
    return t.select(
        "doc_id",
        "label.source",
        joined(F.col("label.lineage")).alias("lineage"),
        joined(F.col("label.ingested_by")).alias("agents"),
        F.size("label.endorsements").cast("long").alias("endorsements"),
        F.col("nothing").isNull().alias("unlabeled"),
        F.concat_ws("/", "record.kind", "record.note", "record.agent_id").alias("record"),
    )


MODEL_SQL = """SELECT doc_id, 'model' AS source, concat_ws(',', coalesce(source, 'none'), CASE WHEN doc_id % 3 = 0 THEN 'lang_' || lang END) AS lineage,
  concat_ws(',', 'reader', CASE WHEN doc_id % 3 = 0 AND lang IS NOT NULL THEN 'default' END, 'writer') AS agents, 0::BIGINT AS endorsements, true AS unlabeled, 'checked/seen/reader' AS record FROM documents"""


def record_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions written as JSON lines by a fan-out of which one sink fails, read back, and counted by run and agent."""
    path = f"{own_dir(spark)}/records-{uuid.uuid4().hex}"
    decided = decide.check(tables.event_calls(spark, sf_dir), policy(EVENTS), tables.event_ingress(spark, sf_dir))

    def failing(_: DataFrame) -> None:
        raise RuntimeError("this sink fails")

    fan = records.FanOut(failing)
    fan.add(lambda rows: records.write(rows, path))
    fan.add(records.to_null)
    logging.getLogger("provlake").addFilter(_quiet)
    try:
        fan(decide.events(decided))
    finally:
        logging.getLogger("provlake").removeFilter(_quiet)
    good, bad = records.read(spark, path)
    counted = records.tree(good).groupBy("run_id", "agent_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.length("summary") > 0).alias("n_said"),
    )
    return counted.withColumn("n_bad", F.lit(bad.count()).cast("long"))


def _quiet(record: logging.LogRecord) -> bool:
    return "record sink failed" not in record.getMessage()


LOG_SQL = f"""WITH {_EVENT}
SELECT run_id, agent_id, count(*) AS n, count(*) AS n_said, 0::BIGINT AS n_bad FROM state GROUP BY ALL"""


def stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, decided with run state kept by Spark, until the input is used up."""
    from provlake.streaming.runs import decide_stream

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    place = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "events")
    rows = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    error = F.col("event_type") == "error"
    log = rows.select(
        *tables.event_run(),
        F.when(error, "ingress").otherwise("call").alias("kind"),
        F.lit(None).cast("string").alias("session_id"),
        F.concat(F.lit("feed_"), (F.col("event_id") % 4).cast("string")).alias("source"),
        F.concat(F.lit("default."), "event_type").alias("tool"),
        F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), "event_id")).alias("args_json"),
        F.lit(None).cast("string").alias("labels_json"),
    )
    decided = decide_stream(log, policy(EVENTS), ttl_ms=None)
    decided = decided.select(
        F.try_variant_get("args", "$.event_id", "long").alias("event_id"),
        "run_tainted",
        joined(F.col("run_trifecta")).alias("run_trifecta"),
        "action",
        F.coalesce("matched_rule", F.lit("-")).alias("rule"),
        "late",
    )
    try:
        query = decided.writeStream.format("parquet").option("path", f"{place}/out").option(
            "checkpointLocation",
            f"{place}/state",
        ).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return spark.read.schema(decided.schema).parquet(f"{place}/out").where("NOT late").drop("late")


def newest_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twenty findings of the audit, as a bounded registry keeps them."""
    return audit.newest(audit_findings(spark, sf_dir), 20)


def laundered_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns enter as untrusted content; the next assistant turn repeats them in a nested argument, without a label."""
    p = from_text('version: "2.0"\nsources: [{name: user_0, trust: trusted}]')
    said = tables.conversation_ingress(spark, sf_dir).where(F.length("text") >= 12)
    body = F.to_json(
        F.struct(
            F.array(F.struct(F.concat(F.lit("They said: "), "text").alias("quote"))).alias("parts"),
            F.lit("a note of no one").alias("note"),
        )
    )
    calls = said.select("run_id", (F.col("seq") + 1).alias("seq"), "agent_id", F.lit("default.post").alias("tool"), body.alias("args"))
    return audit.findings(audit.argument_leaves(calls), p, said).select("run_id", "source", "tool", "argument", "seq")


LAUNDERED_SQL = """WITH ing AS (SELECT 'conv-' || conv_id AS run_id, turn, 'user_' || (conv_id + turn) % 3 AS source, text FROM conversations WHERE role = 'user' AND length(text) >= 12)
SELECT c.run_id, i.source, 'default.post' AS tool, 'parts' AS argument, min(c.turn + 1) AS seq FROM ing c JOIN ing i ON c.run_id = i.run_id AND i.turn + 1 <= c.turn + 1 AND contains(c.text, i.text) AND i.source <> 'user_0' GROUP BY 1, 2"""


def envelope_in_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes beside the keys of a document, some of which are changed; what the sound ones bring into a reader's run."""
    key = b"0123456789abcdef0123456789abcdef"
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("body"))
    leaves = F.array(
        F.struct(
            F.lit("$.text").alias("path"),
            labels.fresh("web", F.concat_ws("/", "conv_id", "turn")).alias("label"),
            F.lit("str").alias("carrier"),
        )
    )
    run = F.array(F.struct(F.lit("web").alias("source"), F.lit("untrusted").alias("trust"), F.array(F.lit("a")).alias("ingested_by")))
    wire = envelope.pack(F.col("body"), leaves, run, F.array(F.lit("reads_private")), key)
    sent = t.withColumn("sent", wire).withColumn("own", F.concat(F.lit('{"amount":'), F.col("turn").cast("string"), F.lit(',"to":"x"}')))
    sent = sent.withColumn("d", envelope.pack_into(F.col("own"), F.col("sent"), key))
    case = F.col("conv_id") % 4
    changed = F.when(case == 1, F.regexp_replace("d", '"amount":[0-9]+', '"amount":999')).when(
        case == 2,
        F.replace("d", F.lit('"label_pool":[{'), F.lit('"label_pool":[{"more":1,')),
    ).when(case == 3, F.replace("d", F.lit('"to":"x"'), F.lit('"to": "x"'))).otherwise(F.col("d"))
    sent = sent.withColumn("d", changed).withColumn("wire", envelope.unpack_from(F.col("d"))).withColumns(
        {"run_id": F.concat(F.lit("conv-"), F.col("conv_id").cast("string")), "seq": F.col("turn")}
    )
    read = envelope.unpack(sent, "wire", key, "d")
    brought = envelope.replay_capabilities(read).groupBy("run_id", "seq").agg(joined(F.collect_set("capability")).alias("brought"))
    texts = envelope.replay_texts(read).select("run_id", "seq", F.length("text").cast("long").alias("text_chars"))
    out = read.select("conv_id", "turn", "run_id", "seq", F.coalesce("reject_reason", F.lit("-")).alias("reject_reason"))
    out = out.join(brought, ["run_id", "seq"], "left").join(texts, ["run_id", "seq"], "left")
    return out.select(
        "conv_id",
        "turn",
        "reject_reason",
        F.coalesce("brought", F.lit("-")).alias("brought"),
        F.coalesce("text_chars", F.lit(-1)).cast("long").alias("text_chars"),
    )


DOCUMENT_SQL = """SELECT conv_id, turn, CASE conv_id % 4 WHEN 1 THEN CASE WHEN turn = 999 THEN '-' ELSE 'wrong code' END WHEN 2 THEN 'schema' ELSE '-' END AS reject_reason,
  CASE WHEN conv_id % 4 IN (0, 3) THEN 'reads_private' ELSE '-' END AS brought, CASE WHEN conv_id % 4 IN (0, 3) AND text IS NOT NULL THEN length(text) ELSE -1 END::BIGINT AS text_chars FROM conversations"""


def starter_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The starter policy: written, read, checked and compiled; its rules, its problems and what its fingerprint tells."""
    with tempfile.TemporaryDirectory() as folder:
        path = f"{folder}/policy.yaml"
        init(path)
        p, problems = load(path), lint.validate(path)
    other = from_text(STARTER.replace("action: block", "action: require_approval", 1))
    mentions = {r["rule"]: (r["agents"], r["groups"]) for key in p.sinks for r in explain.for_tool(p, key)}
    rows = [
        (
            key,
            n,
            r.name,
            r.action,
            ",".join(mentions[r.name][0] + mentions[r.name][1]) or "-",
        ) for key, s in p.sinks.items() for n, r in enumerate(s.rules)
    ]
    same = p.fingerprint == from_text(STARTER).fingerprint and p.fingerprint != other.fingerprint
    return spark.createDataFrame(
        [(*row, len(problems), same) for row in rows],
        "sink string, ord int, rule string, action string, mentions string, n_problems int, fingerprint_tells boolean",
    )


STARTER_SQL = """SELECT * FROM (VALUES ('desk.refund', 0, 'own_desk', 'allow', 'refund-clerk', 0, true), ('desk.refund', 1, 'unread_sources', 'block', '-', 0, true),
  ('mail.send', 0, 'three_legs', 'block', '-', 0, true), ('mail.send', 1, 'inside', 'allow', '-', 0, true), ('mail.send', 2, 'ask', 'require_approval', '-', 0, true)) t(sink, ord, rule, action, mentions, n_problems, fingerprint_tells)"""

REGISTERED = {
    "trust_resolution": (trust_resolution, TRUST_SQL),
    "untrusted_sources_by_lang": (untrusted_sources_by_lang, UNTRUSTED_SQL),
    "decide_first_match": (decide_first_match, DECIDE_SQL),
    "mode_matrix": (mode_matrix, MODE_SQL),
    "run_tainted_prefix": (run_tainted_prefix, TAINTED_SQL),
    "run_trifecta_rule_of_two": (run_trifecta_rule_of_two, RULE_OF_TWO_SQL),
    "decide_lines": (decide_lines, LINES_SQL),
    "decide_lines_summary": (decide_lines_summary, f"WITH q AS ({LINES_SQL}) SELECT action, rule, run_tainted, count(*) AS n FROM q GROUP BY ALL"),
    "args_predicate": (args_predicate, ARGS_SQL),
    "cel_macros": (cel_macros, MACRO_SQL),
    "label_merge_lineage": (label_merge_lineage, MERGE_SQL),
    "endorsement_gate": (endorsement_gate, ENDORSE_SQL),
    "audit_findings": (audit_findings, AUDIT_SQL),
    "inspect_rollup": (inspect_rollup, INSPECT_SQL),
    "sink_default_fallthrough": (sink_default_fallthrough, DEFAULT_SQL),
    "groups_gate": (groups_gate, GROUPS_SQL),
    "unlabeled_documents": (unlabeled_documents, UNLABELED_SQL),
    "string_ops_labels_whole": (string_ops_labels_whole, LABEL_OPS_SQL),
    "string_ops_values_whole": (string_ops_values_whole, VALUES_SQL),
    "rejected_rows": (rejected_rows, REJECTED_SQL),
    "envelope_round_trip": (envelope_round_trip, ENVELOPE_SQL),
    "variant_leaves": (variant_leaves, LEAVES_SQL),
    "variant_leaves_text": (variant_leaves_text, LEAVES_TEXT_SQL),
    "describe_events": (describe_events, DESCRIBE_SQL),
    "policy_problems": (policy_problems, LINT_SQL),
    "explain_rules": (explain_rules, EXPLAIN_SQL),
    "args_pairs": (args_pairs, PAIRS_SQL),
    "string_ops_bytes": (string_ops_bytes, BYTES_SQL),
    "text_case": (text_case, CASE_SQL),
    "typed_leaves": (typed_leaves, TYPED_SQL),
    "model_calls": (model_calls, MODEL_SQL),
    "record_log": (record_log, LOG_SQL),
    "stream_decisions": (stream_decisions, RULE_OF_TWO_SQL),
    "newest_findings": (newest_findings, f"SELECT * FROM ({AUDIT_SQL}) ORDER BY seq DESC, run_id, source, tool, argument LIMIT 20"),
    "laundered_arguments": (laundered_arguments, LAUNDERED_SQL),
    "envelope_in_document": (envelope_in_document, DOCUMENT_SQL),
    "starter_rules": (starter_rules, STARTER_SQL),
}
