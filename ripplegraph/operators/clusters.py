"""Outbreak clusters: connected components of the contacts among infectious people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators.components import connected_components
from ripplegraph.operators.tracing import infectious


def cluster_members(adj: DataFrame, state: DataFrame) -> DataFrame:
    """(id, component) of the infectious; someone without infectious contacts is a cluster alone."""
    sick = infectious(state)
    inner = adj.where("src < dst").join(sick.withColumnRenamed("id", "src"), "src", "left_semi").join(sick.withColumnRenamed("id", "dst"), "dst", "left_semi")
    found = connected_components(inner.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return sick.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def cluster_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("component").agg(F.count("*").alias("size"))


def cluster_summary(members: DataFrame) -> DataFrame:
    """One row: clusters and largest, 0 and 0 where nobody is infectious."""
    return cluster_sizes(members).agg(F.count("*").alias("clusters"), F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("largest"))
