"""Connected components by alternating large-star and small-star steps.

Every step is one aggregation and one join on edges; the number of steps grows with the logarithm of the
number of nodes, not with the diameter.  Each round's edges are written to the shared folder, so lost
executors cost a re-read and plans stay short; those of the round before are deleted.  A node that holds many of the edges, as the root of a giant
component does after some rounds, is joined by broadcast (``skew.join_heavy``), so its edges stay where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.skew import join_heavy
from quillmark.sources.tables import materialize


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_k")).withColumn("m", F.least("u", "m"))
    moved = join_heavy(both.where("v > u"), least, ["u"], "_k", 2 * total)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_k"))
    moved = join_heavy(down, least, ["u"], "_k", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component of every node with an edge; the component's name is its smallest node.

    ``edges`` has ``u`` and ``v`` of one orderable type.  Loops and repeated edges do no harm; null ends
    are dropped; an empty table gives an empty result.
    """
    now = edges.select("u", "v").where("u is not null and v is not null")
    loops = now.where("u = v").select(F.col("u").alias("node"))
    now = materialize(now.where("u <> v").distinct(), "edges")
    total = now.count()
    mark = None
    for _ in range(most_rounds):
        now = materialize(_small_star(_large_star(now, total), total), "edges", replaces=now)
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("xxhash64(u, v) % 1000000007")).alias("s")).first()
        if mark == (row.n, row.s):
            break
        mark, total = (row.n, row.s), row.n
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    out = found.union(roots)
    alone = loops.distinct().join(out, "node", "left_anti").select("node", F.col("node").alias("component"))
    return out.union(alone)
