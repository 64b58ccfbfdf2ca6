"""Connected components of an edge list, as Spark joins.

Alternating large-star and small-star rounds: each round is two groupings with
map-side ``min`` and two joins, so no node's neighbours are ever gathered in
one row.  Rounds grow with the logarithm of the longest path.  Lineage is cut
with ``checkpoint()`` in the folder that the cluster shares.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: what ``spark.checkpoint.dir`` names, else the context's checkpoint folder.

    Only on a local master (tests) a new temporary folder is made; a cluster
    without the setting is an error, as executors do not see each other's disks.
    """
    context = spark.sparkContext
    now = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (now.get() if now.isDefined() else None)
    if folder is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges ``(hi, lo)`` with ``hi > lo``."""
    if large:
        near = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = near.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
        both = edges.join(least, "hi")
        out = both.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo")))
    return out.where(F.col("hi") > F.col("lo")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge of two different nodes.

    ``component`` is the smallest node reachable.  Self-loops and rows with a
    null end add nothing; nodes without an edge are not returned.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
    now = durable(pairs.distinct())
    mark = None
    for _ in range(max_rounds):
        now = durable(_star(_star(now, True), False))
        seen = now.agg(F.count("*"), F.sum(F.hash("hi", "lo").cast("long")), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()
