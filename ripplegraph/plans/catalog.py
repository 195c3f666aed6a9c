"""Registered queries of the contact-network operators over the driver tables.

The graph is that of ripplegraph.operators.graph.contacts over orders, its people are customer's; every 300th is infectious at
first. Timings and timelines are read off lineitem and events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions.keyed import unit, wrapping
from ripplegraph.operators import centrality, clusters, graph, response, scaling, seir, tracing
from ripplegraph.plans import oracle, scheduler
from ripplegraph.sources import generators

EPIDEMIC = seir.Epidemic(seed=777, days=20)
PARTS = 8


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Town:
    """The people, contacts and first state of a scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.people = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
        self.edges = graph.contacts(_read(spark, sf_dir, "orders"))
        self.adj = graph.adjacency(self.edges)
        self.state = self.people.select("id", F.when(F.col("id") % 300 == 0, seir.INFECTIOUS).otherwise(seir.SUSCEPTIBLE).cast("int").alias("st"))
        self.twelfth = self.people.select("id", F.when(F.col("id") % 12 == 0, seir.INFECTIOUS).otherwise(seir.SUSCEPTIBLE).cast("int").alias("st"))

    @property
    def n(self) -> int:
        return self.people.count()

    def days(self, n: int) -> list[DataFrame]:
        states = [self.state]
        for d in range(n):
            states.append(seir.step(self.adj, states[-1], EPIDEMIC, d))
        return states


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.array(*(F.lit(x) for x in (1, 2, 4, 8)))
    return _read(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("label"),
        F.get(side, (F.col("l_linenumber") % 4).cast("int")).alias("processes"),
        F.get(side, (F.col("l_suppkey") % 4).cast("int")).alias("threads"),
        (100000 * (1 + F.col("l_partkey") % 2)).cast("int").alias("people"),
        F.when(F.col("l_orderkey") % 2 == 0, "smallworld").otherwise("scalefree").alias("network"),
        (F.col("l_quantity") + F.col("l_discount")).alias("seconds"),
        F.col("l_discount").alias("comm_seconds"),
        (1.0 + F.col("l_tax")).alias("imbalance"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timings(spark, sf_dir).withColumn("comm", F.col("comm_seconds"))


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return _read(spark, sf_dir, "events").select(F.col("event_type").alias("task"), start.alias("start"), (start + F.col("value")).alias("stop"))


def _per_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.grid_medians(_runs(spark, sf_dir)).groupBy("workers").agg(F.min("median_seconds").alias("seconds"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Town(spark, sf_dir)
    return seir.simulate(t.adj, t.state, EPIDEMIC.over(10))


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    with wrapping(spark):
        return _read(spark, sf_dir, "orders").select("o_orderkey", unit(777, "o_custkey", "o_orderkey % 120", "o_orderkey - 3").alias("u"), unit(4294967295, -1, "o_custkey", 2).alias("v"))


def _top(t: Town, k: int = 15) -> DataFrame:
    return centrality.top_targets(centrality.pagerank(t.people, t.adj), t.twelfth, t.n, k)


def _checks(t: Town) -> DataFrame:
    """The answers of the four tasks as single numbers."""
    n = t.n
    a = seir.step(t.adj, t.twelfth, EPIDEMIC, 0).agg(F.sum("st").cast("long").alias("value")).select(F.lit("spread").alias("task"), "value")
    b = tracing.trace(t.adj, tracing.infectious(t.twelfth)).select(F.lit("trace").alias("task"), F.col("contacts_traced").alias("value"))
    c = _top(t, n // 100).agg(F.count("*").alias("k"), F.min_by("id", "rank").alias("id")).select(F.lit("target").alias("task"), F.when(F.col("k") > 0, F.col("k") * 1000 + F.col("id")).otherwise(0).alias("value"))
    d = clusters.cluster_summary(clusters.cluster_members(t.adj, t.twelfth)).select(F.lit("cluster").alias("task"), (F.col("clusters") * 1_000_000 + F.col("largest")).alias("value"))
    return a.unionAll(b).unionAll(c).unionAll(d)


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Town(spark, sf_dir)
    return seir.seed_infected(t.people, t.n, EPIDEMIC).where("st = 2").select("id")


def _new(t: Town) -> DataFrame:
    s = t.days(3)
    return tracing.newly_infected(s[3], s[2])


def _wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = timings(spark, sf_dir)
    return scaling.pair_wins(runs.where("processes = 4 AND threads = 2"), runs.where("processes = 8 AND threads = 1"))


def _permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from_one = timings(spark, sf_dir).where("people = 100000")
    return scaling.permutation_test(from_one.where("processes = 4 AND threads = 2"), from_one.where("processes = 8 AND threads = 1"))


def _loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("rank")).agg(F.max("l_quantity").alias("elapsed"), F.sum("l_quantity").alias("compute"), F.count("*").cast("double").alias("comm"))
    return scaling.rank_loads(ranks)


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Town(spark, sf_dir)
    ghosts = graph.halo(t.adj, PARTS, t.n).groupBy(F.col("owner").alias("rank")).agg(F.sum("ghosts").alias("ghosts"))
    border = graph.border(t.adj, PARTS, t.n).groupBy(F.col("owner").alias("rank")).agg(F.sum("people").alias("border"))
    work = t.people.groupBy(graph.block_owner(F.col("id"), PARTS, t.n).alias("rank")).agg(F.count("*").alias("compute"))
    return scaling.rank_totals(work.join(ghosts, "rank", "left").join(border, "rank", "left").withColumn("comm", F.col("ghosts")))


def _machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return scaling.compare_machines(*(scaling.grid_medians(runs.where(f"people = {n}")) for n in (100000, 200000)))


def _effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Town(spark, sf_dir)
    plan = response.Response(every=2, vaccines=20)
    return response.intervention_effect(seir.simulate(t.adj, t.state, EPIDEMIC.over(3)), response.respond(t.people, t.adj, t.state, EPIDEMIC.over(3), plan))


def _town(f: Callable[[Town], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Town(spark, sf_dir))


def _weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.weak_scaling(_per_worker(spark, sf_dir).select("workers", (F.col("workers") * 100000).alias("people"), "seconds"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "rng_unit": _unit,
        "contacts": _town(lambda t: t.edges),
        "supply_degree_summary": lambda s, d: graph.degree_summary(_supply_degrees(s, d)),
        "adjacency": _town(lambda t: t.adj),
        "degree": _town(lambda t: graph.degree(t.people, t.adj)),
        "degree_histogram": _town(lambda t: graph.degree_histogram(graph.degree(t.people, t.adj))),
        "degree_summary": _town(lambda t: graph.degree_summary(graph.degree(t.people, t.adj))),
        "slot_offsets": _town(lambda t: graph.offsets(t.people, t.adj)),
        "owner_block": _town(lambda t: t.people.select("id", graph.block_owner(F.col("id"), PARTS, t.n).alias("owner"))),
        "cut_edges": _town(lambda t: graph.cut_edges(t.adj, PARTS, t.n)),
        "halo_block": _town(lambda t: graph.halo(t.adj, PARTS, t.n)),
        "border_block": _town(lambda t: graph.border(t.adj, PARTS, t.n)),
        "halo_summary": _town(lambda t: graph.halo_summary(t.adj, PARTS, t.n)),
        "seed_infected": _seeded,
        "seir_step": _town(lambda t: seir.step(t.adj, t.state, EPIDEMIC, 0)),
        "seir_curve": _town(lambda t: seir.simulate(t.adj, t.state, EPIDEMIC)),
        "state_counts": _town(lambda t: seir.state_counts(t.twelfth, 0)),
        "newly_infected": _town(_new),
        "trace_newly_infected": _town(lambda t: tracing.trace(t.adj, _new(t))),
        "trace_infectious": _town(lambda t: tracing.trace(t.adj, tracing.infectious(t.state))),
        "reached": _town(lambda t: tracing.reached(t.adj, tracing.infectious(t.state), 2)),
        "pagerank": _town(lambda t: _rounded(centrality.pagerank(t.people, t.adj), t.n)),
        "top_targets": _town(_top),
        "apply_vaccination": _town(lambda t: centrality.vaccinate(t.twelfth, _top(t))),
        "cluster_members": _town(lambda t: clusters.cluster_members(t.adj, t.twelfth)),
        "cluster_sizes": _town(lambda t: clusters.cluster_sizes(clusters.cluster_members(t.adj, t.twelfth))),
        "outbreak_clusters": _town(lambda t: clusters.cluster_summary(clusters.cluster_members(t.adj, t.twelfth))),
        "response_log": _town(lambda t: response.respond(t.people, t.adj, t.state, EPIDEMIC.over(3), response.Response(every=2, vaccines=20))),
        "intervention_effect": _effect,
        "task_checks": _town(_checks),
        "small_world": lambda s, d: generators.small_world(s, 3000, 6, 0.1, 777),
        "small_world_exact": lambda s, d: generators.small_world_exact(s, 2000, 6, 0.1, 777),
        "scale_free_exact": lambda s, d: generators.scale_free_exact(s, 2000, 3, 777),
        "copy_model": lambda s, d: generators.copy_model(s, 2000, 3, 777),
        "timing_best": lambda s, d: scaling.timing_best(timings(s, d)),
        "timing_report": lambda s, d: scaling.timing_report(timings(s, d)),
        "grid_medians": lambda s, d: scaling.grid_medians(_runs(s, d)),
        "best_per_approach": lambda s, d: scaling.best_per_approach(scaling.grid_medians(_runs(s, d))),
        "hybrid_margin": lambda s, d: scaling.hybrid_margin(scaling.best_per_approach(scaling.grid_medians(_runs(s, d)))),
        "pair_wins": _wins,
        "permutation_test": _permuted,
        "amdahl_fit": lambda s, d: scaling.amdahl_fit(_per_worker(s, d)),
        "strong_scaling": lambda s, d: scaling.strong_scaling(scaling.grid_medians(_runs(s, d))),
        "weak_scaling": _weak,
        "rank_loads": _loads,
        "rank_totals": _totals,
        "timing_groups": lambda s, d: scaling.timing_groups(timings(s, d)),
        "mean_runs": lambda s, d: scaling.mean_runs(timings(s, d)),
        "combined_modes": lambda s, d: scaling.combined_modes(scaling.grid_medians(_runs(s, d))),
        "compare_machines": _machines,
        "timeline_overlap": lambda s, d: scaling.timeline_overlap(_timeline(s, d)),
        "scheduled_pipeline": _town(lambda t: scheduler.run_pipeline(t.people, t.adj, t.state, EPIDEMIC.over(3), every=2, vaccines=20).select("task_id", "task", "step", "status", "value1", "value2")),
    }


def _supply_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = graph.adjacency(graph.supplies(_read(spark, sf_dir, "lineitem")))
    return graph.degree(adj.select(F.col("src").alias("id")).distinct(), adj)


def _rounded(scores: DataFrame, n: int) -> DataFrame:
    return scores.select("id", F.round(F.col("score") * n, 6).alias("score"))


def oracle_sql() -> dict[str, str]:
    o = oracle
    base = f"WITH {o.ADJ}, {o.PEOPLE}"
    twelfth = "twelfth AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 12 = 0 THEN 2 ELSE 0 END AS st FROM customer)"
    recursive = f"WITH RECURSIVE {o.ADJ}, {o.PEOPLE}, {o.SICK}, {twelfth}"
    ranked = recursive + o.pagerank()
    top = "top AS (SELECT row_number() OVER (ORDER BY round(score * (SELECT count(*) FROM people), 6) DESC, id)::INT AS rank, id, round(score * (SELECT count(*) FROM people), 6) AS score FROM r20 JOIN twelfth USING (id) WHERE st = 0)"
    times = f"WITH {o.TIMINGS}, "
    newly = "SELECT s3.id FROM s3 JOIN s2 USING (id) WHERE s2.st = 0 AND s3.st <> 0"
    throw = o.unit("777", "-1", "0", "t")
    supply = "WITH pairs AS (SELECT DISTINCT l_partkey AS a, l_suppkey + (SELECT max(l_partkey) + 1 FROM lineitem) AS b FROM lineitem), deg AS (SELECT count(*) AS degree FROM (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY id), "
    per_worker = "pw AS (SELECT workers, min(median_seconds) AS seconds FROM grid GROUP BY workers)"
    return {
        "rng_unit": f"SELECT o_orderkey, {o.unit('777', 'o_custkey', 'o_orderkey % 120', 'o_orderkey - 3')} AS u, {o.unit('4294967295', '-1', 'o_custkey', '2')} AS v FROM orders",
        "contacts": o.CONTACTS,
        "supply_degree_summary": supply + o.summary("SELECT degree FROM deg"),
        "adjacency": f"{base} SELECT src, dst FROM adj",
        "degree": f"{base}, {o.DEGREE} SELECT id, degree FROM degree",
        "degree_histogram": f"{base}, {o.DEGREE} SELECT degree, count(*) AS people FROM degree GROUP BY degree",
        "degree_summary": f"{base}, {o.DEGREE}, " + o.summary("SELECT degree FROM degree"),
        "slot_offsets": f"{base}, {o.DEGREE} SELECT id, (sum(degree) OVER w - degree)::BIGINT AS start, (sum(degree) OVER w)::BIGINT AS stop FROM degree WINDOW w AS (ORDER BY id ROWS UNBOUNDED PRECEDING)",
        "owner_block": f"WITH {o.PEOPLE} SELECT id, ((id * 8) // (SELECT count(*) FROM people))::INT AS owner FROM people",
        "cut_edges": f"{base}, {o.GHOSTS} SELECT src, dst, src_owner, dst_owner FROM cut WHERE src_owner <> dst_owner",
        "halo_block": f"{base}, {o.GHOSTS} SELECT owner, neighbour, count(*) AS ghosts FROM ghosts GROUP BY ALL",
        "border_block": f"{base}, {o.GHOSTS} SELECT neighbour AS owner, owner AS neighbour, count(*) AS people FROM ghosts GROUP BY ALL",
        "halo_summary": f"{base}, {o.GHOSTS} SELECT count(*) AS ghosts, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM people), 6) AS percent, count(*) * 4 // 1024 AS kb_per_day FROM ghosts",
        "seed_infected": f"WITH throws AS (SELECT t, floor({throw} * (SELECT count(*) FROM customer))::BIGINT AS id FROM range(64) r(t)) SELECT id FROM throws GROUP BY id ORDER BY min(t) LIMIT 5",
        "seir_step": o.states(1) + " SELECT id, st FROM s1",
        "seir_curve": o.states(20) + " " + " UNION ALL ".join(f"SELECT {d}::BIGINT AS step, count(*) FILTER (WHERE st = 0) AS susceptible, count(*) FILTER (WHERE st = 1) AS exposed, count(*) FILTER (WHERE st = 2) AS infectious, count(*) FILTER (WHERE st = 3) AS recovered FROM s{d}" for d in range(21)),
        "state_counts": f"WITH {twelfth} SELECT 0::BIGINT AS step, count(*) FILTER (WHERE st = 0) AS susceptible, count(*) FILTER (WHERE st = 1) AS exposed, count(*) FILTER (WHERE st = 2) AS infectious, count(*) FILTER (WHERE st = 3) AS recovered FROM twelfth",
        "newly_infected": o.states(3) + " " + newly,
        "trace_newly_infected": o.states(3, o.trace(newly)) + " SELECT " + o.TRACED.format(""),
        "trace_infectious": recursive + o.trace("SELECT id FROM state WHERE st = 2") + " SELECT " + o.TRACED.format(""),
        "reached": recursive + o.trace("SELECT id FROM state WHERE st = 2") + " SELECT id, 0 AS hops FROM src UNION ALL SELECT id, 1 FROM hop1 UNION ALL SELECT id, 2 FROM hop2",
        "pagerank": ranked + " SELECT id, round(score * (SELECT count(*) FROM people), 6) AS score FROM r20",
        "top_targets": f"{ranked}, {top} SELECT rank, id, score FROM top WHERE rank <= 15",
        "apply_vaccination": f"{ranked}, {top} SELECT id, CASE WHEN st = 0 AND id IN (SELECT id FROM top WHERE rank <= 15) THEN 3 ELSE st END AS st FROM twelfth",
        "cluster_members": recursive + o.clusters("SELECT * FROM twelfth") + " SELECT id, component FROM comp",
        "cluster_sizes": recursive + o.clusters("SELECT * FROM twelfth") + " SELECT component, count(*) AS size FROM comp GROUP BY component",
        "outbreak_clusters": recursive + o.clusters("SELECT * FROM twelfth") + " SELECT " + o.CLUSTERED.format("", "largest"),
        "response_log": o.response(3, 2, 20),
        "intervention_effect": f"SELECT (SELECT recovered FROM ({o.states(3)} SELECT count(*) FILTER (WHERE st = 3) AS recovered FROM s3)) AS caught_without, max(recovered) FILTER (WHERE step = 3) - sum(vaccinated)::BIGINT AS caught_with, sum(vaccinated)::BIGINT AS vaccinated FROM ({o.response(3, 2, 20)})",
        "task_checks": f"{ranked}, {top}, one AS ({o.next_state('0', 'SELECT * FROM twelfth')})" + o.trace("SELECT id FROM twelfth WHERE st = 2") + o.clusters("SELECT * FROM twelfth") + " SELECT 'spread' AS task, sum(st)::BIGINT AS value FROM one UNION ALL SELECT 'trace', (SELECT count(*) FROM hop1) + (SELECT count(*) FROM hop2) UNION ALL SELECT 'target', count(*) * 1000 + min(id) FILTER (WHERE rank = 1) FROM top WHERE rank <= (SELECT count(*) FROM people) // 100 UNION ALL SELECT 'cluster', clusters * 1000000 + largest FROM (SELECT " + o.CLUSTERED.format("", "largest") + ")",
        "small_world": o.small_world(3000, 777),
        "copy_model": o.copy_model(2000, 3, 777),
        "scheduled_pipeline": o.scheduled(3, 2, 20),
        "rank_totals": f"{base}, {o.GHOSTS} SELECT (SELECT count(*) FROM people) AS compute, count(*) AS comm, count(*) AS border, count(*) AS ghosts FROM ghosts",
        "timing_groups": f"{times}g AS (SELECT people, network, min(seq) AS first, count(DISTINCT (label, processes, threads)) AS configurations FROM timings GROUP BY ALL) SELECT row_number() OVER (ORDER BY first)::INT AS place, people, network, configurations FROM g",
        "mean_runs": f"{times}m AS (SELECT processes, threads, count(seconds) AS runs, round(avg(seconds), 6) AS mean_seconds, round(median(seconds), 6) AS median_seconds, min(seconds) AS least, max(seconds) AS most FROM timings GROUP BY ALL) SELECT * FROM m",
        "combined_modes": f"{times}{o.GRID} SELECT CASE WHEN approach = 'sequential' THEN approach ELSE 'hybrid' END AS mode, processes, threads, round(median_seconds, 5) AS seconds, round(speedup, 2) AS speedup, round(comm) AS comm FROM grid",
        "compare_machines": o.machines(),
        "timing_best": f"{times}{o.BEST} SELECT * FROM best",
        "timing_report": f"{times}{o.BEST}, b AS (SELECT *, min(CASE WHEN processes = 1 AND threads = 1 THEN seconds END) OVER (PARTITION BY people, network) AS baseline FROM best) SELECT label, processes, threads, people, network, seconds, round(baseline / seconds, 6) AS speedup, round(baseline / seconds / (processes * threads), 6) AS efficiency, round(100.0 * comm_seconds / seconds, 6) AS comm_percent, imbalance FROM b",
        "grid_medians": f"{times}{o.GRID} SELECT * FROM grid",
        "best_per_approach": f"{times}{o.GRID}, {o.BEST_OF} SELECT * FROM best_of",
        "hybrid_margin": f"{times}{o.GRID}, {o.BEST_OF}, rival AS (SELECT * FROM best_of WHERE approach <> 'hybrid' ORDER BY speedup DESC LIMIT 1) SELECT round(100.0 * (h.speedup - r.speedup) / r.speedup, 6) AS margin_percent, h.most < r.least AS clear_win FROM best_of h, rival r WHERE h.approach = 'hybrid'",
        "pair_wins": f"{times}x AS (SELECT seconds FROM timings WHERE processes = 4 AND threads = 2), y AS (SELECT seconds FROM timings WHERE processes = 8 AND threads = 1) SELECT sum(CASE WHEN x.seconds < y.seconds THEN 1.0::DOUBLE WHEN x.seconds = y.seconds THEN 0.5::DOUBLE ELSE 0 END) AS wins, count(*) AS pairs FROM x, y",
        "amdahl_fit": f"{times}{o.GRID}, {per_worker}, s AS (SELECT workers, (SELECT seconds FROM pw WHERE workers = 1) / seconds AS speedup FROM pw), f AS (SELECT avg(least(greatest((1 / speedup - 1.0::DOUBLE / workers) / (1 - 1.0::DOUBLE / workers), 0), 1)) AS f FROM s WHERE workers > 1) SELECT workers, round(speedup, 6) AS speedup, round(f, 6) AS serial_share, round(1 / (f + (1 - f) / workers), 6) AS predicted FROM s, f",
        "strong_scaling": f"{times}{o.GRID} SELECT 'processes' AS series, workers, speedup, round(speedup / workers, 6) AS efficiency FROM grid WHERE threads = 1 UNION ALL SELECT 'threads', workers, speedup, round(speedup / workers, 6) FROM grid WHERE processes = 1",
        "weak_scaling": f"{times}{o.GRID}, {per_worker} SELECT workers, workers * 100000 AS people, seconds, round((SELECT seconds FROM pw ORDER BY workers LIMIT 1) / seconds, 6) AS efficiency FROM pw",
        "rank_loads": "WITH r AS (SELECT l_suppkey, max(l_quantity) AS elapsed, sum(l_quantity) AS compute, count(*)::DOUBLE AS comm FROM lineitem GROUP BY l_suppkey) SELECT max(elapsed) AS elapsed, max(compute) AS compute, max(comm) AS comm, round(max(compute) / avg(compute), 6) AS imbalance, round(max(comm) / (max(compute) + max(comm)), 6) AS comm_share FROM r",
        "timeline_overlap": f"WITH {o.TIMELINE}, e AS (SELECT task, start AS t, 1 AS change FROM timeline UNION ALL SELECT task, stop, -1 FROM timeline), r AS (SELECT *, row_number() OVER (ORDER BY t, change, task) AS k FROM e), l AS (SELECT *, sum(change) OVER (PARTITION BY task ORDER BY k) AS now FROM r), d AS (SELECT *, CASE WHEN now > 0 THEN 1 ELSE 0 END - CASE WHEN now - change > 0 THEN 1 ELSE 0 END AS turn FROM l), a AS (SELECT *, sum(turn) OVER (ORDER BY k) AS active FROM d) SELECT max(active)::BIGINT AS most, min(t) FILTER (WHERE active = (SELECT max(active) FROM a)) AS first_at FROM a",
    }
