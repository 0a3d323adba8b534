"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def session() -> SparkSession:
    """The active session, or one made now: Columns, and so checks of a policy, need one."""
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="provlake-")) / "provlake.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    sc.addPyFile(os.path.abspath(target))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir where the cluster names one, else a temporary folder (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="provlake-shared-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's tables within the shared folder."""
    return f"{shared_dir(spark)}/provlake-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, so a lost executor costs a reread only."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete a table that written() made, when nothing will read it again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/provlake-{spark.sparkContext.applicationId}/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: The most bytes of one batch that travels to a Python worker, but for a single row that is longer.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts and vectors travel to Python in batches: bound them by bytes, so that rows of any length fit a worker.
    One value for the session, as results are lazy; a value that the session has already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "-1", str(2**31 - 1)):
        spark.conf.set(name, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan dealt to all cores where its files split into fewer parts than there are cores: only a small input, or
    one of a few unsplittable files, is moved. Not for a plan with joins or aggregates, which this would run."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def clear(spark: SparkSession) -> None:
    """Delete every table that written() left for this application, when no result that reads one is needed any more.
    Tables of other applications in the same shared folder stay."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Up to so many ids a table of ids is broadcast (some 16 MB); beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000


def checked_ids(ids: DataFrame) -> DataFrame:
    """A written table of one id column, marked for broadcast if it is counted to be small enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
