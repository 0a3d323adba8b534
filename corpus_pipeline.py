"""The training-data pipeline over documents: five stages, each an operator over all that the one before it kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame. All stages but the last return the columns of
documents; between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm import minhash, mixture, packing, secrets, toxicity
from provlake.runtime import checked_ids, written

#: Documents are near-duplicates if their sets of five-word shingles share so many hundredths of their union.
SIMILARITY = 80


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores below 0.5; the others go."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(docs["text"], model) < 0.5)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id.

    Rows that repeat an id are documents of their own where their sets of shingles differ; then the least set decides. Of
    rows with the same id and the same set the least hash of the text, then of the whole row, decides. Rows without an id
    or without words are linked with nothing, and stay.
    """
    near = minhash.near_duplicates(docs, percent=SIMILARITY, apart=True).where("doc_id IS NOT NULL AND n_shingles > 0")
    near = written(near.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "set_id", "least"), "near")
    sets = near.where("least").groupBy("__id", "set_id")
    chosen = sets.agg(F.count("*").alias("n"), F.min("__hash").alias("__hash")).where("n > 1").select("__id", "set_id", "__hash")
    chosen = written(chosen, "chosen")
    # Of each id and text: whether it goes; whole texts move only for rows that repeat an id and a set.
    gone = near.where("NOT least").select("__id", "__hash")
    again = near.join(chosen.select("__id", "set_id"), ["__id", "set_id"], "left_semi").select("__id", "__hash")
    apart = written(gone.unionByName(again).distinct(), "apart")
    key = F.xxhash64(docs["text"])
    once = docs.join(checked_ids(apart), (docs["doc_id"] == apart["__id"]) & (key == apart["__hash"]), "left_anti")
    if chosen.isEmpty():
        return once
    one = chosen.select("__id", "__hash")
    rows = docs.join(checked_ids(one), (docs["doc_id"] == one["__id"]) & (key == one["__hash"]), "left_semi")
    whole = F.struct(*[rows[c] for c in docs.columns])
    least = rows.groupBy(rows["doc_id"].alias("__id"), F.xxhash64(rows["text"]).alias("__hash"))
    least = least.agg(F.min_by(whole, F.xxhash64(*[rows[c] for c in docs.columns])).alias("__row"))
    return once.unionByName(least.select("__row.*"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the spans of the secrets found in it replaced by a mark and n_chars to match."""
    found = secrets.findings(docs, secrets.up_to_date(docs))
    text = secrets.redact(F.col("row.text"), F.col("spans"))
    count = F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))
    put = {"text": text, "n_chars": count}
    return found.select(*[put.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mixed_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for, in global random order."""
    return mixture.mix(docs).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("near-duplicates", one_of_each_group),
    ("secrets", without_secrets),
    ("mixing", mixed_by_source),
    ("packing", packed),
]
#: No stage but mixing and secrets can be said in SQL: tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
