"""The pipeline's stages, each on its own input, against plain Python; and the queries that have SQL against it."""

import glob
import os
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from provlake.llm import queries, secrets
from provlake.runtime import written

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages_in_order(spark):
    from test_minhash import brute_components, brute_sets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near-duplicates", "secrets", "mixing", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in kept.collect()}
        kept = written(stage(spark, kept, SF), name)
        rows = kept.collect()
        if name != "packing":
            assert kept.columns == docs.columns
        if name == "toxicity":
            scored = {r["doc_id"]: r["predicted"] for r in queries.op3_toxicity(spark, SF).collect()}
            assert {r["doc_id"] for r in rows} == {k for k, p in scored.items() if not p}
        elif name == "near-duplicates":
            ids = sorted(before)
            sets = brute_sets([before[k]["text"] for k in ids])
            links = [(a, b) for a in range(len(ids)) for b in range(a) if (i := len(sets[a] & sets[b])) and 100 * i >= 80 * len(sets[a] | sets[b])]
            assert sorted(r["doc_id"] for r in rows) == [k for n, k in enumerate(ids) if brute_components(len(ids), links)[n] == n]
        elif name == "secrets":
            from test_secrets_mixture import brute

            assert {r["doc_id"] for r in rows} == set(before)
            assert not any(brute(r["text"]) for r in rows) and all((r["text"] == before[r["doc_id"]]["text"]) == (not brute(before[r["doc_id"]]["text"])) or "[secret]" in r["text"] for r in rows)
            assert all(r["n_chars"] == len(r["text"]) for r in rows if "[secret]" in r["text"])
        elif name == "mixing":
            assert all(tuple(r) == tuple(before[r["doc_id"]]) for r in rows)
        else:
            mixed = before
            assert {r["doc_id"] for r in rows} == set(mixed) and max(r["offset"] + r["length"] for r in rows) <= 2048
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


def test_no_text_is_lost_to_a_repeated_id(spark):
    """Rows that share an id: different texts stay, whatever becomes of the others; equal ones leave one, the same each time."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "en", "t", 1), (5, b, "de", "s", 1), (4, a, "en", "s", 1), (6, b + " x", "en", "s", 1), (6, c, "en", "s", 1), (6, c.upper(), "en", "s", 1), (7, "", "en", "s", 0), (7, "", "en", "s", 0), (None, a, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [sorted((str(tuple(r)) for r in corpus_pipeline.one_of_each_group(spark, docs.repartition(n), SF).collect())) for n in (1, 4)]
    assert kept[0] == kept[1]
    got = corpus_pipeline.one_of_each_group(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in got) == [(0, a), (4, a), (5, b), (6, c), (7, ""), (7, "")]
    assert set(map(tuple, got)) <= set(rows)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(t).stem} AS SELECT * FROM '{t}'")
    df = queries.queries()[name](spark, SF)
    want = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    assert sorted(tuple(str(r[k]) for k in cols) for r in df.collect()) == sorted(tuple(str(r[names.index(k)]) for k in cols) for r in want.fetchall())


def test_every_rule_has_its_needle():
    assert all(r.needles or r.kind == "hex" for r in secrets.RULES)
