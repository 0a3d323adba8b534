"""Connected components by alternating large-star and small-star.

Each pass is a minimum for each node (combined on the map side) and an equi-join that adaptive execution can split at a
hub; tables between passes are written to the shared folder, so lineage stays short and nothing gathers on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.runtime import remove, written


def _stars(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """Links from each v of pairs (u, v) to the least node m of u's neighbourhood."""
    return pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (u, v): component is the least node reachable.

    Links of a node with itself, repeated links and links with a null end do no harm and add no node. Passes go on until
    one changes nothing; their number grows with the logarithm of the nodes, squared at worst.
    """
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(_stars(both.where("v > u"), least).distinct(), "large")
        below = written(large.groupBy("u").agg(F.min("v").alias("m")), "below")
        small = _stars(large, below).unionByName(below.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "edges")
        n, check = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (now, least, large, below):
            remove(old)
        now = after
        if (n, check) == mark:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        mark = (n, check)
