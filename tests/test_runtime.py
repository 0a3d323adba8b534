import pandas as pd
from pyspark.sql import functions as F

from provlake.runtime import BATCH_BYTES, bounded_batches, clear, remove, shared_dir, spread, written


def test_written_cuts_lineage_and_can_be_removed(spark):
    a, b = written(spark.range(5).withColumn("x", F.col("id") * 2), "t"), written(spark.range(3).toDF("id"), "t")
    assert a.count() == 5 and a.schema["x"].dataType.typeName() == "long" and shared_dir(spark) in a.inputFiles()[0]
    remove(a)
    assert b.count() == 3
    other = f"{shared_dir(spark)}/provlake-another-application/t"
    spark.range(4).write.parquet(other)
    clear(spark)
    own = f"provlake-{spark.sparkContext.applicationId}"
    assert own not in (spark.sparkContext._jvm.java.io.File(shared_dir(spark).removeprefix("file:")).list() or [])
    assert spark.read.parquet(other).count() == 4


def test_batches_are_bounded_by_bytes(spark):
    bounded_batches(spark)
    sizes = lambda batches: (pd.DataFrame({"n": [int(b["t"].str.len().sum())]}) for b in batches)
    df = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("x"), 50_000).alias("t"))
    assert max(r["n"] for r in df.mapInPandas(sizes, "n long").collect()) <= 1.1 * BATCH_BYTES


def test_spread_moves_only_few_parts(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(100).repartition(8).write.option("parquet.block.size", 1024).parquet(f"{tmp_path}/many")
    one = spread(spark.read.parquet(f"{tmp_path}/one"))
    assert "Exchange" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 10
