"""Connected components over an edge table, without collecting anything.

Alternating large-star and small-star rounds (Kiveris et al., 2014): each round
hangs every node under the smallest neighbour it knows, and the edges shrink to
stars whose centres are the components' smallest nodes. Every round is written
to the shared folder. Neighbourhood minima are partial aggregates; the joins are
between two written tables, so Spark can split a centre that many edges share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh_path, materialize, remove


def _star(edges: DataFrame, large: bool, paths: list[str]) -> DataFrame:
    """One star step on edges (a, b) with a > b."""
    spark = edges.sparkSession

    def table(df: DataFrame, name: str) -> DataFrame:
        paths.append(fresh_path(spark, name))
        return materialize(df, name, paths[-1])

    reach = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = table(reach.groupBy("a").agg(F.min("b").alias("m")), "cc-min").select("a", F.least("a", "m").alias("m"))
    pairs = reach.join(least, "a")
    if large:
        moved = pairs.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return table(moved.where("a <> b").groupBy("a", "b").agg(F.lit(1).alias("_one")).select("a", "b"), "cc-star")


def components(edges: DataFrame) -> DataFrame:
    """``edges``: src, dst of any one orderable type. (node, component) of every node with an edge to another node;
    the component is its smallest node. Nulls and self-loops link nothing."""
    spark, paths = edges.sparkSession, []
    tidy = edges.where("src is not null and dst is not null and src <> dst")
    tidy = tidy.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    paths.append(fresh_path(spark, "cc-edges"))
    now = materialize(tidy, "cc-edges", paths[-1])
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before, old = state, list(paths)
        now = _star(_star(now, True, paths), False, paths)
        for p in old:
            remove(spark, p)
            paths.remove(p)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
