"""Analytics over run times: best and median runs, speed-up, efficiency, comparisons and overlap.

Timings have the columns of sources.tables.TIMINGS and `seq`, the order in which they were taken. Quotients with a zero
denominator give the stated default. Results are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.functions.running import running_sum
from ripplegraph.runtime import ship

#: Shuffles that one draw makes, and the most counts it makes at once.
TRIALS_AT_ONCE, CELLS_AT_ONCE = 256, 1 << 20
CONFIG = ("label", "processes", "threads", "people", "network")


def ratio(over: Column, under: Column, default: float | None = 0.0) -> Column:
    return F.round(F.when(under > 0, over / under).otherwise(F.lit(default)), 6)


def approach() -> Column:
    p, t = F.col("processes"), F.col("threads")
    return F.when((p == 1) & (t == 1), "sequential").when(p == 1, "threads only").when(t == 1, "processes only").otherwise("hybrid")


def timing_best(timings: DataFrame) -> DataFrame:
    """The fastest run of each configuration with its own comm_seconds and imbalance; of equally fast ones the first taken."""
    first = F.struct("seconds", "seq")
    return timings.groupBy(*CONFIG).agg(F.min("seconds").alias("seconds"), F.min_by("comm_seconds", first).alias("comm_seconds"), F.min_by("imbalance", first).alias("imbalance"))


def timing_report(timings: DataFrame) -> DataFrame:
    """timing_best with speed-up over the best 1x1 run of the same people and network (null without one), efficiency per worker, and
    communication in percent of the run."""
    best = timing_best(timings)
    alone = F.min(F.when((F.col("processes") == 1) & (F.col("threads") == 1), F.col("seconds"))).over(W.partitionBy("people", "network"))
    best = best.withColumn("baseline", alone)
    speedup = F.when((F.col("baseline") > 0) & (F.col("seconds") > 0), F.col("baseline") / F.col("seconds"))
    return best.select(
        *CONFIG,
        "seconds",
        F.round(speedup, 6).alias("speedup"),
        F.round(speedup / (F.col("processes") * F.col("threads")), 6).alias("efficiency"),
        ratio(100.0 * F.col("comm_seconds"), F.col("seconds")).alias("comm_percent"),
        "imbalance",
    )


def timing_groups(timings: DataFrame) -> DataFrame:
    """(place, people, network, configurations): the report's groups, numbered from 1 in the order in which they first turn up."""
    groups = timings.groupBy("people", "network").agg(F.min("seq").alias("first"), F.countDistinct("label", "processes", "threads").alias("configurations"))
    place = F.row_number().over(W.orderBy("first"))  # as many rows as sizes and kinds of networks
    return groups.select(place.alias("place"), "people", "network", "configurations")


def mean_runs(runs: DataFrame) -> DataFrame:
    """runs(processes, threads, seconds): per configuration the number of runs, their mean, median, least and most. Null times aren't runs."""
    one = runs.where("seconds IS NOT NULL").groupBy("processes", "threads")
    return one.agg(F.count("*").alias("runs"), F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.round(F.median("seconds"), 6).alias("median_seconds"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))


def grid_medians(runs: DataFrame) -> DataFrame:
    """runs(processes, threads, seconds, comm): per configuration median, least, most, spread in percent, speed-up over the 1x1 median and
    median comm."""
    one = runs.groupBy("processes", "threads").agg(F.median("seconds").alias("m"), F.min("seconds").alias("least"), F.max("seconds").alias("most"), F.median("comm").alias("comm"))
    base = runs.where("processes = 1 AND threads = 1").agg(F.median("seconds").alias("base"))
    return one.crossJoin(F.broadcast(base)).select(  # one row
        (F.col("processes") * F.col("threads")).alias("workers"),
        "processes",
        "threads",
        approach().alias("approach"),
        F.round("m", 6).alias("median_seconds"),
        "least",
        "most",
        ratio(100.0 * (F.col("most") - F.col("least")), F.col("least")).alias("spread_percent"),
        ratio(F.col("base"), F.col("m"), None).alias("speedup"),
        F.round("comm", 6).alias("comm"),
    )


def best_per_approach(grid: DataFrame) -> DataFrame:
    """The row of grid_medians with the largest speed-up for each approach but sequential; of equal ones the one with fewer workers, then
    fewer processes."""
    first = W.partitionBy("approach").orderBy(F.desc("speedup"), "workers", "processes")
    ranked = grid.where("approach <> 'sequential'").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return ranked.select("approach", "processes", "threads", "median_seconds", "least", "most", "speedup")


def hybrid_margin(best: DataFrame) -> DataFrame:
    """One row: hybrid's lead over the better pure approach in percent, and whether its slowest run beats the rival's fastest."""
    mixed = best.where("approach = 'hybrid'").agg(F.max("speedup").alias("h"), F.max("most").alias("h_most"))
    pure = best.where("approach <> 'hybrid'").agg(F.max("speedup").alias("p"), F.max_by("least", "speedup").alias("p_least"))
    return mixed.crossJoin(pure).select(ratio(100.0 * (F.col("h") - F.col("p")), F.col("p"), None).alias("margin_percent"), (F.col("h_most") < F.col("p_least")).alias("clear_win"))  # one row each


def pair_wins(x: DataFrame, y: DataFrame) -> DataFrame:
    """x(seconds), y(seconds): over all pairs, how often x is faster, ties half. Counted by one sorted pass over both, not by pairs."""
    both = x.select("seconds", F.lit(1).alias("mine")).unionAll(y.select("seconds", F.lit(0).alias("mine")))
    bins = both.groupBy("seconds").agg(F.sum("mine").alias("xs"), F.sum(1 - F.col("mine")).alias("ys"))
    bins = running_sum(bins, "ys", ["seconds"], "later", descending=True)
    scored = bins.select(((F.col("later") - 0.5 * F.col("ys")) * F.col("xs")).alias("won"), "xs", "ys")
    return scored.agg(F.coalesce(F.sum("won"), F.lit(0.0)).alias("wins"), (F.coalesce(F.sum("xs"), F.lit(0)) * F.coalesce(F.sum("ys"), F.lit(0))).alias("pairs"))


def _medians(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The median of each row of counts over the ascending values; counts of a row have the same sum, not 0."""
    upto = np.cumsum(counts, axis=1)
    n = int(upto[0, -1])
    low, high = ((upto <= k).sum(axis=1) for k in ((n - 1) // 2, n // 2))
    return 0.5 * values[low] + 0.5 * values[high]


def permutation_test(x: DataFrame, y: DataFrame, trials: int = 200_000, seed: int = 12345) -> DataFrame:
    """One row: observed median(y) - median(x), and p = (hits + 1) / (trials + 1) over label shuffles keyed (seed, block of trials).

    Runs of equal time are alike, so a shuffle is drawn as how many of each time's runs get the first label (multivariate
    hypergeometric). Times and their counts go to the driver and every task: as many numbers as there are different times, however
    many runs there are (fewer than 10^9, as numpy draws). Null times aren't runs; without runs on a side observed is null."""
    spark = x.sparkSession
    ship(spark)
    both = x.select("seconds", F.lit(1).alias("mine")).unionAll(y.select("seconds", F.lit(0).alias("mine"))).where("seconds IS NOT NULL")
    bins = both.groupBy("seconds").agg(F.sum("mine").alias("xs"), F.count("*").alias("runs")).toArrow()
    order = np.argsort(bins["seconds"].to_numpy().astype(np.float64))
    values, xs, runs = bins["seconds"].to_numpy().astype(np.float64)[order], bins["xs"].to_numpy()[order], bins["runs"].to_numpy()[order]
    n = int(xs.sum())
    if n == 0 or n == runs.sum():
        return spark.range(1).select(F.lit(None).cast("double").alias("observed"), F.lit(1 / (trials + 1)).alias("p"))
    observed = float((_medians(values, (runs - xs)[None]) - _medians(values, xs[None]))[0])
    held = spark.sparkContext.broadcast((values, runs))
    block = max(1, min(TRIALS_AT_ONCE, CELLS_AT_ONCE // len(values)))

    def shuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, runs = held.value
        for b in batches:
            hits = []
            for k in b["id"].to_pylist():
                first = np.random.Generator(np.random.Philox(key=[seed, k])).multivariate_hypergeometric(runs, n, size=min(block, trials - k * block))
                hits.append(int((_medians(values, runs - first) - _medians(values, first) >= observed).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.int64())], ["hits"])

    hits = spark.range(-(-trials // block)).mapInArrow(shuffled, "hits long").agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    return hits.select(F.round(F.lit(observed), 6).alias("observed"), ((F.col("hits") + 1) / (trials + 1)).alias("p"))


def amdahl_fit(runs: DataFrame) -> DataFrame:
    """runs(workers, seconds), one row each: (workers, speedup, serial_share, predicted). The serial share is the mean over workers > 1 of
    (1/S - 1/p) / (1 - 1/p), held within 0 and 1."""
    p, s = F.col("workers"), F.col("speedup")
    base = F.max(F.when(p == 1, F.col("seconds"))).over(W.partitionBy())  # as many rows as worker counts
    rows = runs.select("workers", (base / F.col("seconds")).alias("speedup"))
    share = F.when(p > 1, F.least(F.greatest((1 / s - 1 / p) / (1 - 1 / p), F.lit(0.0)), F.lit(1.0)))
    rows = rows.withColumn("f", F.avg(share).over(W.partitionBy()))
    return rows.select("workers", F.round("speedup", 6).alias("speedup"), F.round("f", 6).alias("serial_share"), F.round(1 / (F.col("f") + (1 - F.col("f")) / p), 6).alias("predicted"))


def strong_scaling(grid: DataFrame) -> DataFrame:
    """(series, workers, speedup, efficiency) of grid_medians along threads alone and along processes alone."""
    rows = grid.where("threads = 1").select(F.lit("processes").alias("series"), "workers", "speedup").unionAll(grid.where("processes = 1").select(F.lit("threads").alias("series"), "workers", "speedup"))
    return rows.select("series", "workers", "speedup", F.round(F.col("speedup") / F.col("workers"), 6).alias("efficiency"))


def combined_modes(grid: DataFrame) -> DataFrame:
    """grid_medians as the published table of modes, by workers and then processes: seconds to five places, speed-up to two, comm to none."""
    mode = F.when(F.col("approach") == "sequential", "sequential").otherwise("hybrid")
    rows = grid.orderBy("workers", "processes")
    return rows.select(mode.alias("mode"), "processes", "threads", F.round("median_seconds", 5).alias("seconds"), F.round("speedup", 2).alias("speedup"), F.round("comm").alias("comm"))


def compare_machines(here: DataFrame, there: DataFrame) -> DataFrame:
    """Two machines' grid_medians to (series, workers, here, there, lead): the speed-ups of each along threads and along processes, and
    here's over there's; null where a machine has no such run."""
    one, other = (strong_scaling(g).select("series", "workers", F.col("speedup").alias(name)) for g, name in ((here, "here"), (there, "there")))
    return one.join(other, ["series", "workers"], "full").select("series", "workers", "here", "there", ratio(F.col("here"), F.col("there"), None).alias("lead"))


def weak_scaling(runs: DataFrame) -> DataFrame:
    """runs(workers, people, seconds): efficiency is the time of the fewest workers over the row's time."""
    first = F.first("seconds").over(W.orderBy("workers").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))  # as many rows as worker counts
    return runs.select("workers", "people", "seconds", ratio(first, F.col("seconds"), None).alias("efficiency"))


def rank_loads(ranks: DataFrame) -> DataFrame:
    """ranks(rank, elapsed, compute, comm) to one row: the largest of each, imbalance (largest over mean compute; 1 without any) and
    communication's share of the slowest (0 without any)."""
    one = ranks.agg(F.max("elapsed").alias("elapsed"), F.max("compute").alias("compute"), F.max("comm").alias("comm"), F.avg("compute").alias("mean"))
    return one.select("elapsed", "compute", "comm", ratio(F.col("compute"), F.col("mean"), 1.0).alias("imbalance"), ratio(F.col("comm"), F.col("compute") + F.col("comm")).alias("comm_share"))


def rank_totals(ranks: DataFrame) -> DataFrame:
    """ranks(rank, compute, comm, border, ghosts) to one row of sums over all ranks, 0 without any."""
    return ranks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("compute", "comm", "border", "ghosts")))


def timeline_overlap(timeline: DataFrame) -> DataFrame:
    """timeline(task, start, stop) to one row: the most different tasks at work at once, and when that was first so. Ends come before starts
    at the same time; tasks of one kind may overlap themselves. Rows without a start or a stop don't count."""
    events = timeline.where("start IS NOT NULL AND stop IS NOT NULL").select("task", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("change")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("change")))).alias("e")).select("task", "e.*")
    moves = events.groupBy("task", "at", "change").agg(F.sum("change").alias("step"))
    # a task's changes add up to none, so the sum over all tasks before is that of the task's own
    live = running_sum(moves, "step", ["task", "at", "change"], "now")
    turns = live.withColumn("turn", (F.col("now") > 0).cast("int") - (F.col("now") > F.col("step")).cast("int")).where("turn <> 0")
    turns = running_sum(turns.select("at", "change", "task", "turn"), "turn", ["at", "change", "task"], "active")
    return turns.agg(F.coalesce(F.max("active"), F.lit(0)).cast("long").alias("most"), F.min_by("at", F.struct(-F.col("active"), "at")).alias("first_at"))
