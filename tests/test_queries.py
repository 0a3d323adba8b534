"""Every registered query of the engine against its SQL in DuckDB, and the rules of the package's layers."""

import ast
import glob
import os
from pathlib import Path

import duckdb
import pytest

from provlake.queries import REGISTERED

SF = "/root/testdata/sf0.001"
PACKAGE = Path(__file__).resolve().parent.parent / "provlake"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(t).stem} AS SELECT * FROM '{t}'")
    return c


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTERED.items() if sql])
def test_against_sql(spark, duck, name):
    query, sql = REGISTERED[name]
    df = query(spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    ours = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert ours == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["run_id", "seq", "tool", "action", "outcome", "rule", "max_trust", "untrusted", "trifecta"]
    assert set(REGISTERED) <= set(__spark_entry__.queries())


ORDER = ["errors", "schema", "runtime", "functions", "plans", "operators", "sources", "streaming", "queries", "cli"]


def test_layers():
    """A module imports only from its own layer or from those before it, and nothing imports the llm subpackage."""
    for path in PACKAGE.rglob("*.py"):
        layer = path.relative_to(PACKAGE).parts[0].removesuffix(".py")
        for node in ast.walk(ast.parse(path.read_text())):
            for name in [node.module] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []:
                parts = (name or "").split(".")
                if parts[0] == "provlake" and len(parts) > 1 and layer not in ("llm", "__init__"):
                    assert parts[1] != "llm", path
                    assert ORDER.index(parts[1]) <= ORDER.index(layer), (path, name)


def test_string_functions_see_whole_texts(spark, tmp_path):
    texts = ["x" * 30 + " e e e e \n two\tlines " + "y" * 40 + " The end...", "The " + "ab e " * 5_000 + "Te.", "", "short", "T" * 50 + "\n\n" + "e" * 50 + " last"]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in REGISTERED["string_ops_labels_whole"][0](spark, str(tmp_path)).collect():
        t = texts[r["doc_id"]]
        assert (r["added"], r["replaced"], r["formatted"], r["filled"]) == (t + "en", t.replace("e", "en", 2), "en/" + t, "en-" + t)
        assert (r["joined"], r["lost"], r["spec"], r["radded"]) == (t + ", en", t + ", en", format(t, ">30"), ">> " + t)
    for r in REGISTERED["string_ops_values_whole"][0](spark, str(tmp_path)).collect():
        t = texts[r["doc_id"]]
        assert (r["stripped"], r["stripped_chars"], r["words"], r["split2"]) == (t.strip(), t.strip("T.e"), "|".join(t.split()), "|".join(t.split("e", 2)))
        assert (r["ljust"], r["rjust"], r["noprefix"]) == (t.ljust(30, "*"), t.rjust(30), t.removeprefix("The "))
        assert (r["first_word"], r["last_word"], r["n_lines"]) == (t.partition(" ")[0], t.rpartition(" ")[2], len(t.splitlines()))
