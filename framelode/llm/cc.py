"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is an aggregation for the smallest neighbour, combined before the shuffle and written once, and a join of the edges with it. The smallest neighbours of
vertices with one edge in ``HOT_SHARE`` or more, of which there are few at any size, are joined by broadcast, so that their edges
stay where they are; nothing is gathered in one task or on the driver. The loop ends when the edges are stars, each vertex's one edge leading to the smallest of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.llm import common


#: A vertex is hot if one in so many ends of edges is its own.
HOT_SHARE = 1000


def _smallest(edges: DataFrame) -> tuple[DataFrame, list[tuple[int, int]], int]:
    """Of ``edges`` (u, v), written: u, ``m``, the smallest of itself and its neighbours, and ``n``, its edges; (u, m) of the hot ones, if any are needed; and how many u have several edges and are not
    their own smallest."""
    table = common.written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "smallest")
    ends = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ends"), F.count_if(F.expr("n > 1 and m < u")).alias("open")).first()
    # HOT_SHARE rows at most
    hot = [tuple(r) for r in table.where(F.col("n") * HOT_SHARE >= F.lit(ends.ends)).select("u", "m").collect()] if ends.open else []
    return table, hot, ends.open


def _with_smallest(edges: DataFrame, smallest: DataFrame, hot: list[tuple[int, int]]) -> DataFrame:
    """``edges`` (u, v) with the ``m`` of their u."""
    if not hot:
        return edges.join(smallest.select("u", "m"), "u")
    few = F.broadcast(edges.sparkSession.createDataFrame(hot, "u long, m long"))
    return edges.join(few, "u").unionByName(edges.join(few, "u", "left_anti").join(smallest.select("u", "m"), "u"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``id`` and ``component``, the smallest id that it reaches, for every id of the edges (``a``, ``b``).

    Self-loops, repeated edges and nulls add nothing; an empty table has no components. The steps needed grow with the logarithm of the longest path; an error is raised if ``rounds`` of them,
    enough for far longer paths than a table can hold, don't settle it."""
    spark = edges.sparkSession
    now = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest, hot, left = _smallest(both)
        if not left:
            common.dropped(spark, smallest)
            break
        large = common.written(_with_smallest(both.where("v > u"), smallest, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        common.dropped(spark, smallest, now)
        # small star: every edge leads from the larger to the smaller end
        down, hot, _ = _smallest(large)
        now = common.written(_with_smallest(large, down, hot).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct(), "edges")
        common.dropped(spark, down, large)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
