from pyspark.sql import functions as F

from ripplegraph.operators import graph


def edges(spark, rows):
    return spark.createDataFrame(rows, "a long, b long")


def people(spark, n):
    return spark.range(n)


def test_degree_counts_slots(spark):
    # a parallel edge, a self-loop and an isolated node
    adj = graph.adjacency(edges(spark, [(0, 1), (0, 1), (2, 2)]))
    assert dict(graph.degree(people(spark, 4), adj).collect()) == {0: 2, 1: 2, 2: 2, 3: 0}
    assert sorted(map(tuple, graph.degree_histogram(graph.degree(people(spark, 4), adj)).collect())) == [(0, 1), (2, 3)]


def test_summary_by_ranks(spark):
    degrees = spark.createDataFrame([(i, d) for i, d in enumerate([0, 1, 1, 2, 2, 3, 3, 4, 9, 15])], "id long, degree long")
    row = graph.degree_summary(degrees).first().asDict()
    assert row == {"mean": 4.0, "median": 3, "p99": 15, "largest": 15, "top_share": 0.375, "largest_to_median": 5.0}


def test_blocks_and_borders(spark):
    # path of four in two blocks: 0 1 | 2 3
    adj = graph.adjacency(edges(spark, [(0, 1), (1, 2), (1, 2), (2, 3)]))
    assert sorted(map(tuple, graph.cut_edges(adj, 2, 4).collect())) == [(1, 2, 0, 1)] * 2 + [(2, 1, 1, 0)] * 2
    assert sorted(map(tuple, graph.halo(adj, 2, 4).collect())) == [(0, 1, 1), (1, 0, 1)]
    assert sorted(map(tuple, graph.border(adj, 2, 4).collect())) == [(0, 1, 1), (1, 0, 1)]
    assert tuple(graph.halo_summary(adj, 2, 4).first()) == (2, 50.0, 0)
    assert tuple(graph.halo_summary(adj, 1, 4).first()) == (0, 0.0, 0)


def test_offsets(spark):
    adj = graph.adjacency(edges(spark, [(0, 1), (1, 2), (2, 3)]))
    assert sorted(map(tuple, graph.offsets(people(spark, 5), adj).collect())) == [(0, 0, 1), (1, 1, 3), (2, 3, 5), (3, 5, 6), (4, 6, 6)]


def test_empty(spark):
    adj = graph.adjacency(edges(spark, []))
    assert graph.halo(adj, 4, 10).count() == 0
    assert {r["degree"] for r in graph.degree(people(spark, 3), adj).collect()} == {0}


def test_any_assignment_of_owners(spark):
    n, parts = 60, 4
    adj = graph.adjacency(spark.createDataFrame([(i, (7 * i + 3) % n) for i in range(n)], "a long, b long"))
    blocks = spark.range(n).select("id", graph.block_owner(F.col("id"), parts, n).alias("owner"))
    for f in (graph.cut_edges, graph.halo, graph.border, graph.halo_summary):
        assert sorted(map(tuple, f(adj, parts, n, blocks).collect())) == sorted(map(tuple, f(adj, parts, n).collect()))
    odd = spark.range(n).select("id", (F.col("id") % 2).cast("int").alias("owner"))
    assert all(a % 2 != b % 2 for a, b, *_ in graph.cut_edges(adj, parts, n, odd).collect())
