import random

from ripplegraph.operators.components import connected_components


def plain(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


def test_random_graphs_long_path_and_star(spark):
    rnd = random.Random(3)
    for edges in (
        [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)],
        [(i, i + 1) for i in range(300)],
        [(500 - i, 500) for i in range(1, 200)] + [(7, 7), (900, 900)],
    ):
        got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
        assert got == plain(edges)


def test_nothing_and_nulls(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([(1, None), (None, 2)], "a long, b long")).count() == 0


def test_hubs(spark):
    rnd = random.Random(5)
    edges = [(9000 + i, 3) for i in range(3000)] + [(9000 + i, 8000) for i in range(0, 3000, 7)] + [(20000 + i, 19999) for i in range(900)] + [(rnd.randrange(4000, 6000), rnd.randrange(4000, 6000)) for _ in range(1500)]
    rnd.shuffle(edges)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(got.collect()) == plain(edges) and got.count() == len(plain(edges))
