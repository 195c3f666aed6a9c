"""Susceptible-exposed-infectious-recovered epidemics on a contact graph.

States: 0 susceptible, 1 exposed, 2 infectious, 3 recovered. A day reads the state of the day before only. All dice are keyed
(seed, person, day, throw), so the epidemic is the same under any partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ripplegraph.functions.keyed import unit, unit_text, wrapping
from ripplegraph.operators.graph import neighbours
from ripplegraph.runtime import drop, materialize

SUSCEPTIBLE, EXPOSED, INFECTIOUS, RECOVERED = range(4)
NAMES = ("susceptible", "exposed", "infectious", "recovered")


@dataclass(frozen=True)
class Epidemic:
    """beta: a contact infects; sigma: the exposed turn infectious; gamma: the infectious recover (each a day)."""

    beta: float = 0.05
    sigma: float = 0.20
    gamma: float = 0.10
    days: int = 120
    first: int = 5
    seed: int = 12345

    def over(self, days: int) -> Epidemic:
        return replace(self, days=days)


def seed_infected(people: DataFrame, n: int, epidemic: Epidemic) -> DataFrame:
    """people(id), ids 0..n-1, to (id, st): the first throws (seed, -1, 0, t) that name different people make these infectious."""
    spark, wanted = people.sparkSession, min(epidemic.first, n)
    throws, chosen = max(4 * wanted, 16), []
    while len(chosen) < wanted:  # a handful of rows; doubled until enough different people are named
        with wrapping(spark):
            rolls = spark.range(throws).select("id", F.floor(unit(epidemic.seed, -1, 0, "id") * n).cast("long").alias("node"))
        named = rolls.groupBy("node").agg(F.min("id").alias("at")).orderBy("at").limit(wanted)
        chosen, throws = [r["node"] for r in named.collect()], throws * 2
    return people.select("id", F.when(F.col("id").isin(chosen), INFECTIOUS).otherwise(SUSCEPTIBLE).cast("int").alias("st"))


def exposures(adj: DataFrame, state: DataFrame) -> DataFrame:
    """(id, k): over how many slots infectious people reach each person. Filtered before the join; the small side is Spark's choice."""
    sick = state.where(F.col("st") == INFECTIOUS).select(F.col("id").alias("src"))
    return adj.join(sick, "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("k"))


def moved(epidemic: Epidemic, st: str, k: str, day: int | str, first: str) -> Column:
    """The next state from the columns st and k; `first` is the person's first throw of the day, which most need alone."""
    more = f"exists(sequence(1L, greatest({k} - 1L, 1L)), c -> {unit_text(epidemic.seed, 'id', day, 'c')} < {epidemic.beta!r}D)"
    return F.expr(f"""CAST(CASE
        WHEN {st} = {SUSCEPTIBLE} AND {k} > 0 THEN IF({first} < {epidemic.beta!r}D OR ({k} > 1 AND {more}), {EXPOSED}, {SUSCEPTIBLE})
        WHEN {st} = {EXPOSED} AND {first} < {epidemic.sigma!r}D THEN {INFECTIOUS}
        WHEN {st} = {INFECTIOUS} AND {first} < {epidemic.gamma!r}D THEN {RECOVERED}
        ELSE {st} END AS INT)""")


def step(adj: DataFrame, state: DataFrame, epidemic: Epidemic, day: int) -> DataFrame:
    """state(id, st) of `day` (from 0) to that of the day after."""
    with wrapping(state.sparkSession):
        met = state.join(exposures(adj, state), "id", "left").select("id", "st", F.coalesce("k", F.lit(0).cast("long")).alias("k"), unit(epidemic.seed, "id", day, 0).alias("u"))
        return met.select("id", moved(epidemic, "st", "k", day, "u").alias("st"))


def counters() -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("st") == i, 1).otherwise(0)), F.lit(0)).cast("long").alias(NAMES[i]) for i in range(4)]


def state_counts(state: DataFrame, day: int) -> DataFrame:
    """One row: how many people are in each state, all four, 0 where there are none."""
    return state.agg(*counters()).select(F.lit(day).cast("long").alias("step"), *NAMES)


class Days:
    """A run's state from day to day. Each day is written to the shared folder: its plan reads the state twice, so a plan over several
    days would double with each of them. What is counted on the way is observed while the day is written, not in a job of its own."""

    def __init__(self, state: DataFrame):
        self.now, self.before = state, None

    def move(self, state: DataFrame, day: int) -> tuple:
        """Make `state` the current one; give its state_counts row. The day before stays readable until the next move."""
        seen = Observation()
        state = materialize(state.observe(seen, *counters()), "day")
        if self.before is not None:
            drop(self.before)
        self.before, self.now = self.now, state
        return (day, *(seen.get[name] for name in NAMES))


class Rounds:
    """Two days in one job. The expressions are built once, and the day is a column, so that all rounds run the same compiled code."""

    def __init__(self, lists: DataFrame, epidemic: Epidemic):
        self.lists = lists
        u, v = unit(epidemic.seed, "id", "day", 0).alias("u"), unit(epidemic.seed, "id", "day + 1", 0).alias("v")
        self.active = ["id", "day", "st", u]
        stays = F.expr(f"st = {EXPOSED} AND u < {epidemic.sigma!r}D OR st = {INFECTIOUS} AND u >= {epidemic.gamma!r}D")
        self.sick = [F.col("id").alias("src"), "day", F.expr(f"IF(st = {INFECTIOUS}, 1L, 0L)").alias("now"), stays.cast("long").alias("next")]
        self.met = [F.explode("dsts").alias("id"), "day", "now", "next", F.lit(SUSCEPTIBLE).alias("st")]
        self.ill = ["id", "day", F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("next"), "st"]
        self.sums = [F.max("day").alias("day"), F.sum("now").alias("now"), F.sum("next").alias("next"), F.max("st").alias("st")]
        self.dice = ["id", "day", "now", "next", "st", u, v]
        self.one = ["id", "day", "next", "v", moved(epidemic, "st", "now", "day", "u").alias("one")]
        self.two = ["id", "day", "one", moved(epidemic, "one", "next", "day + 1", "v").alias("two")]

    def after(self, ill: DataFrame) -> DataFrame:
        """ill(id, day, st), everyone who isn't susceptible on a day, to (id, day, one, two): their states one and two days after, with
        those who fell ill meanwhile. Who is exposed isn't infectious on the day after, so who is infectious on both days is known at
        once. Slots of the infectious and the ill meet in one sum by person."""
        with wrapping(ill.sparkSession):
            sick = ill.where(f"st IN ({EXPOSED}, {INFECTIOUS})").select(*self.active).select(*self.sick).where("now + next > 0")
            both = self.lists.join(sick, "src").select(*self.met).unionAll(ill.select(*self.ill))
            return both.groupBy("id").agg(*self.sums).select(*self.dice).select(*self.one).select(*self.two).where(f"two <> {SUSCEPTIBLE}")


def simulate(adj: DataFrame, state: DataFrame, epidemic: Epidemic) -> DataFrame:
    """The epidemic's curve: (step, susceptible, exposed, infectious, recovered), days + 1 rows, row 0 the given state.

    Only people who are or were ill are kept, and each job advances two days and counts both while it writes the second.
    """
    spark = state.sparkSession
    begun = state.agg(*counters()).first()
    n, rows = sum(begun), [(0, *begun)]
    lists = neighbours(adj).select("src", "dsts").persist()
    ill = materialize(state.where(F.col("st") != SUSCEPTIBLE).select("id", F.lit(0).alias("day"), F.col("st").cast("int").alias("st")), "ill")
    rounds, counts = Rounds(lists, epidemic), [F.expr(f"count_if({when} = {st})").alias(f"{when}{st}") for when in ("one", "two") for st in (EXPOSED, INFECTIOUS, RECOVERED)]
    later = ["id", F.expr("day + 2").alias("day"), F.col("two").alias("st")]
    for day in range(0, epidemic.days, 2):
        seen = Observation()
        last, ill = ill, materialize(rounds.after(ill).observe(seen, *counts).select(*later), "ill")
        drop(last)
        for when, at in (("one", day + 1), ("two", day + 2)):
            if at <= epidemic.days:
                told = [seen.get[f"{when}{st}"] for st in (EXPOSED, INFECTIOUS, RECOVERED)]
                rows.append((at, n - sum(told), *told))
    lists.unpersist()
    drop(ill)
    return spark.createDataFrame(rows, "step long, susceptible long, exposed long, infectious long, recovered long")
