"""The daily response: spread, tracing of the newly infected, clusters of the infectious and, every so often, vaccination."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators import centrality, clusters, tracing
from ripplegraph.operators.seir import Days, Epidemic, step

LOG = "step long, susceptible long, exposed long, infectious long, recovered long, newly_infected long, contacts_traced long, clusters long, largest_cluster long, vaccinated long"


@dataclass(frozen=True)
class Response:
    depth: int = 2
    rounds: int = 20
    every: int = 20
    vaccines: int | None = None  # a hundredth of the people, unless told


def respond(people: DataFrame, adj: DataFrame, state: DataFrame, epidemic: Epidemic, response: Response) -> DataFrame:
    """The response's log, a row for each day (from 1). Tracing and clusters see the day's state before vaccination, counts after.
    PageRank doesn't depend on the state and is computed once."""
    spark, n = state.sparkSession, people.count()
    vaccines = n // 100 if response.vaccines is None else response.vaccines
    adj = adj.repartition("src").sortWithinPartitions("src").persist()
    scores = centrality.pagerank(people, adj, response.rounds) if epidemic.days else None
    days, rows = Days(state), []
    for day in range(epidemic.days):
        before = days.now
        counts = days.move(step(adj, before, epidemic, day), day + 1)
        now = days.now
        traced = tracing.trace(adj, tracing.newly_infected(now, before), response.depth).first()
        found = clusters.cluster_summary(clusters.cluster_members(adj, now)).first()
        vaccinated = 0
        if day % response.every == 0:
            targets = centrality.top_targets(scores, now, n, vaccines).persist()
            vaccinated = targets.count()
            counts = days.move(centrality.vaccinate(now, targets), day + 1)
            targets.unpersist()
        rows.append((*counts, *traced, *found, vaccinated))
    adj.unpersist()
    return spark.createDataFrame(rows, LOG)


def intervention_effect(without: DataFrame, log: DataFrame) -> DataFrame:
    """(caught_without, caught_with, vaccinated): recovered on the last day of a plain curve, and of a response's log less the vaccinated."""
    plain = without.agg(F.max_by("recovered", "step").alias("caught_without"))
    told = log.agg(F.max_by("recovered", "step").alias("r"), F.coalesce(F.sum("vaccinated"), F.lit(0)).alias("vaccinated"))
    return plain.crossJoin(told).select("caught_without", (F.col("r") - F.col("vaccinated")).alias("caught_with"), "vaccinated")  # one row each
