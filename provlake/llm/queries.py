"""The operators' registered queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm import html_text, licenses, minhash, mixture, neighbours, packing, secrets, tokens, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.mix(table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "row.source", "row.text", "copy", "n_copies", "shuffle_key")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.findings(docs, secrets.up_to_date(docs), keep=["doc_id"])
    base = [r.kind for r in secrets.RULES if r.base]

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    first = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        "row.doc_id",
        *map(count, base),
        F.sha2(secrets.listed(first).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def queries() -> dict:
    return {
        f.__name__: f for f in (
            op1_token_counts,
            op2_mixture,
            op3_toxicity,
            op4_neighbours,
            op5_html_text,
            op6_licenses,
            op7_minhash,
            op8_secrets,
            op9_packing,
            op10_topk,
        )
    }


MIXTURE_SQL = """
WITH RECURSIVE sized AS (
  SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source
), shares AS (
  SELECT source, CASE WHEN size > 0 THEN pow(size, 0.5) / size * ((SELECT sum(size) FROM sized) / (SELECT sum(pow(size, 0.5)) FROM sized WHERE size > 0)) ELSE 1.0 END AS rate FROM sized
), drawn AS (
  SELECT d.*, s.rate, (('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source
), cdf AS (
  SELECT source, rate, 0 AS k, -rate AS logp, exp(-rate) AS below FROM shares
  UNION ALL
  SELECT source, rate, k + 1, logp + ln(rate) - ln(k + 1), below + exp(logp + ln(rate) - ln(k + 1)) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
), lists AS (SELECT source, list(below) AS cdf FROM cdf GROUP BY source
), counted AS (
  SELECT w.*, len(list_filter(l.cdf, lambda c: c < w.u))::INT AS n_copies FROM drawn w JOIN lists l ON w.source IS NOT DISTINCT FROM l.source
), copies AS (SELECT *, unnest(range(n_copies))::INT AS copy FROM counted)
SELECT doc_id, source, text, copy, n_copies,
  (('0x' || substr(md5('18|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy::VARCHAR), 1, 13))::BIGINT) AS shuffle_key
FROM copies
"""


def _secrets_sql() -> str:
    """The same definition over RE2: each match with the text before it, and running sums of their lengths."""
    parts = []
    for no, r in enumerate(secrets.RULES):
        pattern = "(([0-9a-f]+))" if r.kind == "hex" else r.pattern  # as the definition has it
        parts.append(f"""SELECT doc_id, text, {no} AS kind_no, '{r.kind}' AS kind, {r.least} AS least,
  regexp_extract_all(coalesce(text, ''), $re$(?s).*?(?-s){pattern}$re$, 0) AS g, regexp_extract_all(coalesce(text, ''), $re$(?s).*?(?-s){pattern}$re$, 1) AS w,
  regexp_extract_all(coalesce(text, ''), $re$(?s).*?(?-s){pattern}$re$, 2) AS p FROM documents""")
    base = ", ".join(f"'{r.kind}'" for r in secrets.RULES if r.base)
    return f"""
WITH every AS ({' UNION ALL '.join(parts)}),
one AS (SELECT doc_id, kind_no, kind, least, g, w, p, unnest(range(1, len(g) + 1)) AS i FROM every),
span AS (
  SELECT doc_id, kind_no, kind, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT AS stop, length(w[i]) AS size
  FROM one WHERE length(p[i]) >= least
), said AS (SELECT *, stop - size AS start, kind || ':' || (stop - size)::BIGINT || ':' || stop AS s FROM span),
agg AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(s, ',' ORDER BY start, kind_no) FILTER (kind IN ({base})) AS base, string_agg(s, ',' ORDER BY start, kind_no) AS spans FROM said GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN agg USING (doc_id)
"""


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_topk": TOPK_SQL, "op2_mixture": MIXTURE_SQL, "op8_secrets": _secrets_sql()}
