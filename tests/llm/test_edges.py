"""Every operator and stage on null ids and texts, empty and very long texts, repeated rows, empty tables and extra
columns whose names clash with those used inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from provlake.llm import html_text, licenses, minhash, mixture, neighbours, packing, secrets, tokens, topk, toxicity

EXTRA = ["n_tokens", "score", "row", "spans", "copy", "id", "component_id", "kept", "length", "blob", "__u", "__text", "sig", "key", "rate", "n_copies"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
LONG = " ".join(f"w{k % 977}" for k in range(60_000))
ROWS = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (4, LONG, "en", "b"), (5, "one two", "en", "a"), (5, "one two", "en", "a"), (None, "one two", "en", "a"), (6, "password=abcdefghijkl token:xyz", "en", "c"), (7, LONG + " end", "en", "b"), (8, "ﬀ 漢字 ١٢ ​", "en", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["x"] * len(EXTRA)) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (None, 0, 1), (4, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "tokens": lambda d, y: tokens.token_counts(d),
    "mixture": lambda d, y: mixture.mix(d),
    "toxicity": lambda d, y: toxicity.toxicity(d, y),
    "licenses": lambda d, y: licenses.license_scan(d),
    "minhash": lambda d, y: minhash.near_duplicates(d),
    "secrets": lambda d, y: secrets.findings(d, secrets.scan(d)),
    "packing": lambda d, y: packing.pack(d),
    "html": lambda d, y: html_text.main_text(d, "doc_id", "lang", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, docs, labels, name):
    df = OPERATORS[name](docs, labels)
    rows = df.collect()
    if name in ("tokens", "toxicity", "licenses", "minhash", "secrets", "html"):
        assert len(rows) == len(ROWS)
    empty = OPERATORS[name](docs.where("false"), labels.where("false"))
    assert empty.columns == df.columns and empty.collect() == []


def test_defined_results(docs):
    got = {r["doc_id"]: r for r in tokens.token_counts(docs).collect()}
    assert (got[1]["n_bytes"], got[1]["n_tokens"]) == (got[2]["n_bytes"], got[2]["n_tokens"]) == (0, 0) and got[None]["n_tokens"] == 2
    near = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert (near[1]["n_shingles"], near[1]["component_id"], near[1]["kept"]) == (0, 1, True) and near[3]["n_shingles"] == 0
    assert near[7]["component_id"] == 4 and not near[7]["kept"] and near[5]["component_id"] == 5 and near[None]["component_id"] is None and near[None]["kept"]
    pieces = packing.pack(docs).collect()
    assert sum(r["doc_id"] == 1 and r["length"] == 1 for r in pieces) == 1 and sum(r["doc_id"] == 5 for r in pieces) == 2
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in html_text.main_text(docs, "doc_id", "lang", "text").where("doc_id IN (1, 2, 3)").collect())


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage(spark, docs, labels, tmp_path, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    f = dict(corpus_pipeline.STAGES)[stage]
    out = f(spark, docs, str(tmp_path))
    assert stage == "packing" or out.columns == docs.columns
    n = out.count()
    assert n == {"toxicity": len(ROWS), "near-duplicates": 8, "secrets": len(ROWS)}.get(stage, n)
    assert f(spark, docs.where("false"), str(tmp_path)).count() == 0


VECTORS = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (8, []), (9, [0.5, 0.5])]


def test_vectors(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in VECTORS], "vec_id long, embedding array<float>, id string, v string")
    got = [tuple(r) for r in neighbours.nearest(df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect()]
    d = 0.5**0.5
    assert got == [(0, 1, 100, 0.0), (0, 2, 100, 0.0), (0, 3, 7, d), (0, 4, 9, d), (100, 1, 0, 0.0), (100, 2, 7, d), (100, 3, 9, d)]
    got = [tuple(r) for r in topk.top_products(df, F.col("id") % 50 == 0).where("query_id = 0").orderBy("rank").collect()]
    assert got == [(0, 1, 100, 65536), (0, 2, 100, 65536), (0, 3, 7, 32768), (0, 4, 9, 32768), (0, 5, 1, 0)]
    for f in (neighbours.nearest, topk.top_products):
        assert f(df.where("false"), F.col("id") % 50 == 0).collect() == []
