"""Connected components of an edge table, as DataFrame rounds.

Alternating large-star / small-star (Kiveris et al. 2014). Every round is a
few equi-joins and partial aggregates; a node that a third of all edges meet
is a sort-merge join that adaptive execution splits, never a group held in one
task. Rounds are written to the shared folder, so a lost executor replays one
round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node
    reachable. Self loops and repeated edges do no harm; null ends are
    dropped."""
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
               .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
               .distinct(), "edges")
    while True:
        # small star: the smaller neighbours of u, and u itself, point to the least of them
        least = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        many = least.where("n > 1").select("u", "m").hint("shuffle_merge")
        moved = e.join(many, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e1 = stored(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        # now every u has one smaller neighbour; large star: its larger neighbours point there too
        up = e1.select("u", "v")
        parent = up.groupBy("u").agg(F.min("v").alias("m")).hint("shuffle_merge")
        hung = (up.join(parent.withColumnRenamed("u", "p"), F.col("v") == F.col("p"), "left")
                .select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved")))
        e2 = stored(hung, "large-star")
        e = e2.select("u", "v").distinct()
        if e2.where("moved").isEmpty() and e1.groupBy("u").count().where("count > 1").isEmpty():
            return e2.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e2.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
