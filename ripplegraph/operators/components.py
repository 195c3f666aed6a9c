"""Connected components by alternating star contractions (Kiveris et al., 2014).

Each round hangs every vertex's larger neighbours on the least vertex it sees (large star), then its smaller ones (small
star). Edges never multiply, and the edge set turns into stars within a logarithmic number of rounds. Every round is one
pre-aggregated minimum per vertex and one join, written to the shared folder, so nothing is collected and lineage stays short.
A vertex with more than a HUBS-th of all rows would be one task's: there are at most HUBS of these, so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.runtime import drop, materialize

#: The most vertices that are broadcast, and the rows of a vertex that are never too many for a task.
HUBS, FEW = 10_000, 256


def _with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """rows(u, v) with u's m of least(u, m, n), where the n add up to total at most; rows of hubs stay where they are."""
    if total <= 16 * FEW:
        return rows.join(least.select("u", "m"), "u")
    hubs = least.where(F.col("n") > max(FEW, total // HUBS)).select("u", F.col("m").alias("hub"))
    told = rows.join(F.broadcast(hubs), "u", "left")  # fewer than HUBS rows
    near = told.where("hub IS NULL").select("u", "v").join(least.select("u", "m"), "u").select("u", "v", "m")
    return near.unionAll(told.where("hub IS NOT NULL").select("u", "v", F.col("hub").alias("m")))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a long, b long), undirected, to (id, component): each vertex of an edge and the least vertex of its component.

    Self-loops, repeated and reversed edges are allowed; edges with a null end are ignored; no edges give no rows. Isolated
    vertices aren't in the result: join vertices to it and take the vertex itself where there is no match.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    loops = edges.where("a = b").select(F.col("a").alias("id")).distinct()
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both.where("v > u"), least, 2 * mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = _with_least(large, least, mark[0])
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, materialize(small, "small-star")
        drop(last)
        drop(large)
    else:
        raise RuntimeError(f"no fixpoint after {most_rounds} rounds")
    labels = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    found = labels.unionAll(roots)
    out = found.unionAll(loops.join(found.select("id"), "id", "left_anti").withColumn("component", F.col("id")))
    out._ripplegraph_path = now._ripplegraph_path  # drop(result), once it has been used, removes its table
    return out
