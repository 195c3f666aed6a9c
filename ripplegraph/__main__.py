"""Command line: python -m ripplegraph <program> [options]. Each program prints its result and, with --out, writes it as CSV under the
published headers of its kind.

simulate      an epidemic's curve
response      the daily response's log
schedule      concurrent analyses of each day (with --failure: one run of a job stays silent; with --timeline: who was at work when)
borders       ghosts between blocks of people
tasks         the four tasks' answers and times on the state after some days
degrees       degree histogram and summary
timings       the timing report over a CSV file, networks in the order in which they turn up
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from ripplegraph.operators import centrality, clusters, graph, response, scaling, seir, tracing
from ripplegraph.plans import scheduler
from ripplegraph.sources import generators, tables

SIZES = {"simulate": 10_000, "response": 20_000, "schedule": 50_000, "borders": 100_000, "tasks": 500_000, "degrees": 500_000, "timings": 0}
#: The files that the programs write.
KINDS = {"simulate": "curve", "response": "response", "tasks": "tasks", "degrees": "degrees"}
#: What the programs do unless told otherwise, where that isn't 120 days on the scale-free network with seed 12345.
DEFAULTS = {"tasks": {"days": 60, "network": "smallworld", "seed": 777}, "degrees": {"seed": 777}}


def network(spark: SparkSession, kind: str, n: int, seed: int) -> DataFrame:
    """smallworld and scalefree are the sequential networks; the -keyed ones scale."""
    make = {"smallworld": lambda: generators.small_world_exact(spark, n, 6, 0.1, seed), "scalefree": lambda: generators.scale_free_exact(spark, n, 3, seed), "smallworld-keyed": lambda: generators.small_world(spark, n, 6, 0.1, seed), "scalefree-keyed": lambda: generators.copy_model(spark, n, 3, seed)}
    return graph.adjacency(make[kind]())


def task_times(people: DataFrame, adj: DataFrame, state: DataFrame, n: int, e: seir.Epidemic, day: int) -> DataFrame:
    """(task, threads, seconds, answer) of spread, tracing, targeting and clustering on one state."""

    def spread() -> int:
        return seir.step(adj, state, e, day).agg({"st": "sum"}).first()[0]

    def target() -> int:
        top = centrality.top_targets(centrality.pagerank(people, adj), state, n, n // 100).persist()
        first = top.orderBy("rank").first()
        return top.count() * 1000 + first["id"] if first else 0

    def cluster() -> int:
        found = clusters.cluster_summary(clusters.cluster_members(adj, state)).first()
        return found["clusters"] * 1_000_000 + found["largest"]

    threads, rows = tables.hardware(state.sparkSession)[0], []
    for name, run in (("A spread", spread), ("B tracing", lambda: tracing.trace(adj, tracing.infectious(state)).first()["contacts_traced"]), ("C targeting", target), ("D clustering", cluster)):
        began = time.perf_counter()
        answer = run()
        rows.append((name, threads, time.perf_counter() - began, answer))
    return state.sparkSession.createDataFrame(rows, "task string, threads int, seconds double, answer long")


def main(args: list[str] | None = None) -> DataFrame:
    p = argparse.ArgumentParser(prog="ripplegraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("program", choices=SIZES)
    p.add_argument("--people", type=int)
    p.add_argument("--network", choices=("smallworld", "scalefree", "smallworld-keyed", "scalefree-keyed"))
    p.add_argument("--seed", type=int)
    p.add_argument("--days", type=int)
    p.add_argument("--parts", type=int, default=8)
    p.add_argument("--file", default="timings.csv")
    p.add_argument("--failure", action="store_true")
    p.add_argument("--timeout", type=float, default=30.0)
    p.add_argument("--out")
    p.add_argument("--timeline")
    a = p.parse_args(args)
    for name, value in ({"days": 120, "network": "scalefree", "seed": 12345} | DEFAULTS.get(a.program, {})).items():
        if getattr(a, name) is None:
            setattr(a, name, value)
    spark, n = SparkSession.builder.getOrCreate(), a.people or SIZES[a.program]
    e = seir.Epidemic(seed=a.seed, days=a.days)
    people = spark.range(n)
    if a.program == "timings":
        runs = tables.read_timings(spark, a.file)
        groups = scaling.timing_groups(runs).select("place", "people", "network")
        out = scaling.timing_report(runs).join(groups, ["people", "network"]).orderBy("place", "label", "processes", "threads").drop("place")
    else:
        adj = network(spark, a.network, n, a.seed).persist()
        start = seir.seed_infected(people, n, e)
        if a.program == "simulate":
            out = seir.simulate(adj, start, e)
        elif a.program == "response":
            out = response.respond(people, adj, start, e, response.Response())
        elif a.program == "schedule":
            silent: list[int] = []

            def fault(job: scheduler.Job) -> None:
                if a.failure and job.task_id == 2 and not silent:
                    silent.append(job.task_id)
                    time.sleep(2 * a.timeout)

            out, timeline = scheduler.timed_pipeline(people, adj, start, e, timeout=a.timeout, fault=fault)
            if a.timeline:
                tables.write_table(tables.published(timeline, "timeline"), a.timeline, one_file=True)
        elif a.program == "borders":
            out = graph.halo(adj, a.parts, n)
        elif a.program == "tasks":
            days = seir.Days(start)
            for day in range(a.days):
                days.move(seir.step(adj, days.now, e, day), day + 1)
            out = task_times(people, adj, days.now, n, e, a.days + 1)
        else:
            degrees = graph.degree(people, adj)
            graph.degree_summary(degrees).show()
            out = graph.degree_histogram(degrees).orderBy("degree")
    out.show(200, truncate=False)
    if a.out:
        tables.write_table(tables.published(out, KINDS[a.program]) if a.program in KINDS else out, a.out, one_file=True)
    return out


if __name__ == "__main__":
    main()
