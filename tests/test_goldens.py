"""Known results: whole runs and histograms on the exact networks."""

from ripplegraph.operators import graph, seir
from ripplegraph.sources import generators


def test_small_world_run(spark):
    n, e = 2000, seir.Epidemic(seed=777, days=120)
    adj = graph.adjacency(generators.small_world_exact(spark, n, 6, 0.1, 777))
    got = {r[0]: tuple(r)[1:] for r in seir.simulate(adj, seir.seed_infected(spark.range(n), n, e), e).collect()}
    want = {0: (1995, 0, 5, 0), 1: (1993, 2, 3, 2), 30: (1933, 17, 20, 30), 60: (1862, 12, 23, 103), 120: (1659, 18, 42, 281)}
    assert len(got) == 121 and {d: got[d] for d in want} == want


def test_scale_free_run(spark):
    n, e = 10_000, seir.Epidemic(seed=12345, days=60)
    adj = graph.adjacency(generators.scale_free_exact(spark, n, 3, 12345))
    got = {r[0]: tuple(r)[1:] for r in seir.simulate(adj, seir.seed_infected(spark.range(n), n, e), e).collect()}
    want = {0: (9995, 0, 5, 0), 1: (9993, 2, 5, 0), 10: (9963, 17, 15, 5), 30: (9299, 341, 249, 111), 60: (3836, 728, 1825, 3611)}
    assert {d: got[d] for d in want} == want


def test_degrees_of_half_a_million(spark):
    n = 500_000
    adj = graph.adjacency(generators.small_world_exact(spark, n, 6, 0.1, 777))
    bins = dict(graph.degree_histogram(graph.degree(spark.range(n), adj)).collect())
    assert (bins[3], bins[4]) == (399, 9947) and sum(bins.values()) == n
    assert [graph.halo_summary(adj, p, n).first()["ghosts"] for p in (2, 4, 8)] == [130444, 209681, 252926]


def test_scale_free_degrees_of_half_a_million(spark):
    n = 500_000
    adj = graph.adjacency(generators.scale_free_exact(spark, n, 3, 777))
    bins = dict(graph.degree_histogram(graph.degree(spark.range(n), adj)).collect())
    assert [bins[d] for d in range(3, 10)] == [199939, 99874, 57273, 35643, 23888, 16678, 12218]
    assert sorted(bins.items())[-2:] == [(2202, 1), (2379, 1)] and sum(bins.values()) == n
    assert [graph.halo_summary(adj, p, n).first()["ghosts"] for p in (2, 4, 8)] == [440650, 981671, 1511322]
