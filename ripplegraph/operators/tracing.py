"""Contact tracing: breadth-first search from many people at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators.seir import INFECTIOUS, SUSCEPTIBLE


def newly_infected(state: DataFrame, before: DataFrame) -> DataFrame:
    """(id) of those who were susceptible the day before and aren't now."""
    was = before.where(F.col("st") == SUSCEPTIBLE).select("id")
    return state.where(F.col("st") != SUSCEPTIBLE).select("id").join(was, "id", "left_semi")


def infectious(state: DataFrame) -> DataFrame:
    return state.where(F.col("st") == INFECTIOUS).select("id")


def reached(adj: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """(id, hops) of everyone within `depth` hops of the sources (ids), these included with 0. Each person has one row, with the
    fewest hops; each hop is one join of the frontier, made distinct before it is compared with those already seen."""
    seen = sources.select("id").distinct().select("id", F.lit(0).alias("hops"))
    frontier = seen.select("id")
    for hop in range(1, depth + 1):
        near = adj.join(frontier.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        frontier = near.join(seen.select("id"), "id", "left_anti")
        seen = seen.unionAll(frontier.select("id", F.lit(hop).alias("hops")))
    return seen


def trace(adj: DataFrame, sources: DataFrame, depth: int = 2) -> DataFrame:
    """One row: source_count, and contacts_traced, the people within `depth` hops who aren't sources."""
    found = reached(adj, sources, depth)
    return found.agg(F.coalesce(F.sum(F.when(F.col("hops") == 0, 1).otherwise(0)), F.lit(0)).cast("long").alias("source_count"), F.coalesce(F.sum(F.when(F.col("hops") > 0, 1).otherwise(0)), F.lit(0)).cast("long").alias("contacts_traced"))
