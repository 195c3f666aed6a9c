"""Who to vaccinate: PageRank over the contact graph, and the most central susceptible people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.running import running_sum
from ripplegraph.operators.graph import neighbours
from ripplegraph.operators.seir import RECOVERED, SUSCEPTIBLE
from ripplegraph.runtime import drop, materialize

DAMPING = 0.85
CUT = 5  # rounds in one plan


def pagerank(people: DataFrame, adj: DataFrame, rounds: int = 20) -> DataFrame:
    """people(id) to (id, score): a fixed number of rounds from 1/n; a person without contacts ends at 0.15/n, and its share isn't
    dealt to others. Parallel edges weigh as often as they are listed.

    Everyone's neighbours are lists of bounded length (a hub has many), so a round is one join with a row for each person and one sum by
    person with one shuffle. A list with everyone itself and nothing to give makes everyone turn up among the receivers: scores are
    read once a round, and several rounds are one plan.
    """
    n = people.count()
    lists = neighbours(adj).select("src", (F.lit(DAMPING) / F.col("degree")).alias("share"), "dsts")
    lists = lists.unionAll(people.select(F.col("id").alias("src"), F.lit(0.0).alias("share"), F.array("id").alias("dsts")))
    lists = lists.repartition("src").sortWithinPartitions("src").persist()
    scores = people.select(F.col("id").alias("src"), F.lit(1.0 / max(n, 1)).alias("score"))
    last = None
    for i in range(1, rounds + 1):
        scores = lists.join(scores, "src").select((F.col("score") * F.col("share")).alias("gift"), F.explode("dsts").alias("src")).groupBy("src").agg((F.lit((1 - DAMPING) / max(n, 1)) + F.sum("gift")).alias("score"))
        if i % CUT == 0 or i == rounds:
            scores = materialize(scores, "pagerank")
            if last is not None:
                drop(last)
            last = scores
    lists.unpersist()
    return scores.select(F.col("src").alias("id"), "score")


def top_targets(scores: DataFrame, state: DataFrame, n: int, k: int) -> DataFrame:
    """(rank, id, score): the k susceptible people with the largest score * n (rounded to six places), ties to the smaller id. Numbered by
    ranges, as k may be a share of all people."""
    able = scores.join(state.where(F.col("st") == SUSCEPTIBLE).select("id"), "id", "left_semi")
    able = able.select("id", F.round(F.col("score") * n, 6).alias("score"), F.lit(1).alias("one")).withColumn("less", -F.col("score"))
    return running_sum(able, "one", ["less", "id"], "rank").where(F.col("rank") <= k).select(F.col("rank").cast("int").alias("rank"), "id", "score")


def vaccinate(state: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets who are still susceptible count as recovered."""
    chosen = targets.select("id").distinct().withColumn("chosen", F.lit(True))
    return state.join(chosen, "id", "left").select("id", F.when((F.col("st") == SUSCEPTIBLE) & F.col("chosen").isNotNull(), RECOVERED).otherwise(F.col("st")).cast("int").alias("st"))
