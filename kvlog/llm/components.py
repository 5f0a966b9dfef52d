"""Connected components by randomised contraction: joins and aggregates only, a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlog.llm.common import cut, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of ``edges`` (columns a, b); component is the least id of the connected part.

    Each round points every node at the neighbour (or itself) with the least hash of (node, round) and contracts; hashes
    instead of ids shrink any graph by a constant factor a round.  Rounds hand over written tables: a checkpoint carries
    the plan's constraints along, which double each round.  Null ends are ignored.
    """
    live = edges.select("a", "b").where(F.col("a") != F.col("b"))
    live = stored(live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges").distinct()
    roots = live.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct()
    k = 0
    while not live.isEmpty():
        ranked = F.struct(F.xxhash64("b", F.lit(k)).alias("r"), F.col("b").alias("v"))
        least = live.groupBy("a").agg(F.min(ranked).alias("m"))
        own = F.struct(F.xxhash64("a", F.lit(k)).alias("r"), F.col("a").alias("v"))
        to = stored(least.select("a", F.least(own, F.col("m"))["v"].alias("p")), "to")
        roots = stored(roots.join(to, roots["root"] == to["a"], "left").select("id", F.coalesce("p", "root").alias("root")), "roots")
        half = live.join(to, "a").select("b", F.col("p").alias("pa"))
        to_b = to.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        live = stored(half.join(to_b, "b").where(F.col("pa") != F.col("pb")).select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
        k += 1
    named = roots.groupBy("root").agg(F.min("id").alias("component"))
    return cut(roots.join(named, "root").select("id", "component"))
