import pytest
from pyspark.sql import functions as F

from ripplegraph.functions.keyed import unit_of
from ripplegraph.operators import centrality, clusters, graph, response, seir, tracing
from ripplegraph.sources import generators


def plain_step(n, adj, state, e, day):
    out = list(state)
    for i in range(n):
        if state[i] == 0:
            k = sum(state[j] == 2 for j in adj[i])
            out[i] = int(any(unit_of(e.seed, i, day, c) < e.beta for c in range(k)))
        elif state[i] == 1 and unit_of(e.seed, i, day, 0) < e.sigma:
            out[i] = 2
        elif state[i] == 2 and unit_of(e.seed, i, day, 0) < e.gamma:
            out[i] = 3
    return out


@pytest.fixture(scope="module")
def town(spark):
    n = 300
    edges = generators.small_world(spark, n, 5, 0.2, 7).persist()
    rows = [tuple(r) for r in edges.collect()]
    plain = [[] for _ in range(n)]
    for a, b in rows:
        plain[a].append(b)
        plain[b].append(a)
    return n, spark.range(n), graph.adjacency(edges).persist(), plain


def test_simulation_equals_plain(spark, town):
    n, people, adj, plain = town
    e = seir.Epidemic(beta=0.3, seed=777, days=15)
    first = [0] * n
    for i in (3, 50, 51, 200):
        first[i] = 2
    first[10], first[11] = 1, 3
    state = spark.createDataFrame(list(enumerate(first)), "id long, st int")
    want, now = [], first
    for day in range(e.days + 1):
        want.append((day, *(now.count(i) for i in range(4))))
        now = plain_step(n, plain, now, e, day)
    got = sorted(map(tuple, seir.simulate(adj, state, e).collect()))
    assert got == want
    assert all(sum(r[1:]) == n for r in got)
    one = dict(seir.step(adj, state, e, 0).collect())
    assert [one[i] for i in range(n)] == plain_step(n, plain, first, e, 0)


@pytest.mark.parametrize("parts", ["1", "3", "7"])
def test_partitions_do_not_matter(spark, town, parts):
    n, people, adj, _ = town
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        e = seir.Epidemic(beta=0.3, seed=5, days=6)
        got = sorted(map(tuple, seir.simulate(adj, seir.seed_infected(people, n, e), e).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    test_partitions_do_not_matter.seen = getattr(test_partitions_do_not_matter, "seen", got)
    assert got == test_partitions_do_not_matter.seen


def test_published_seeding(spark):
    e = seir.Epidemic(seed=12345)
    chosen, t = [], 0
    while len(chosen) < 5:
        node = int(unit_of(e.seed, -1, 0, t) * 50)
        t += 1
        if node not in chosen:
            chosen.append(node)
    got = seir.seed_infected(spark.range(50), 50, e).where("st = 2")
    assert sorted(r["id"] for r in got.collect()) == sorted(chosen)
    assert seir.seed_infected(spark.range(3), 3, e).where("st = 2").count() == 3


def test_tracing(spark):
    adj = graph.adjacency(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (0, 2)], "a long, b long"))
    src = spark.createDataFrame([(0,), (0,)], "id long")
    assert dict(tracing.reached(adj, src, 2).collect()) == {0: 0, 1: 1, 2: 1, 3: 2}
    assert tuple(tracing.trace(adj, src, 2).first()) == (1, 3)
    assert tuple(tracing.trace(adj, src.limit(0), 2).first()) == (0, 0)


def test_pagerank_and_targets(spark):
    adj = graph.adjacency(spark.createDataFrame([(0, 1), (0, 2), (0, 3), (0, 3)], "a long, b long"))
    n, slots = 5, {0: [1, 2, 3, 3], 1: [0], 2: [0], 3: [0, 0], 4: []}
    score = {i: 1 / n for i in range(n)}
    for _ in range(20):
        score = {i: 0.15 / n + 0.85 * sum(score[j] / len(slots[j]) for j in slots[i]) for i in range(n)}
    ranks = centrality.pagerank(spark.range(n), adj)
    got = dict(ranks.collect())
    assert all(abs(got[i] - score[i]) < 1e-12 for i in range(n))
    state = spark.createDataFrame([(0, 2), (1, 0), (2, 0), (3, 0), (4, 0)], "id long, st int")
    top = centrality.top_targets(ranks, state, n, 3)
    assert [r["id"] for r in top.orderBy("rank").collect()] == [3, 1, 2]  # 1 and 2 tie
    assert dict(centrality.vaccinate(state, top).collect()) == {0: 2, 1: 3, 2: 3, 3: 3, 4: 0}


def test_clusters(spark):
    # two triangles joined by someone susceptible, and someone alone
    adj = graph.adjacency(spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 6), (6, 3), (3, 4), (4, 5), (5, 3)], "a long, b long"))
    state = spark.range(8).select("id", F.when(F.col("id") == 6, 0).otherwise(2).alias("st"))
    members = clusters.cluster_members(adj, state)
    assert dict(members.collect()) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 7: 7}
    assert tuple(clusters.cluster_summary(members).first()) == (3, 3)
    assert tuple(clusters.cluster_summary(clusters.cluster_members(adj, state.withColumn("st", F.lit(0)))).first()) == (0, 0)


def test_response(spark, town):
    n, people, adj, _ = town
    e = seir.Epidemic(beta=0.3, seed=9, days=4)
    log = response.respond(people, adj, seir.seed_infected(people, n, e), e, response.Response(every=3)).orderBy("step").collect()
    assert [r["vaccinated"] for r in log] == [3, 0, 0, 3]
    assert all(r["susceptible"] + r["exposed"] + r["infectious"] + r["recovered"] == n for r in log)
    assert all(a["susceptible"] >= b["susceptible"] and a["recovered"] <= b["recovered"] for a, b in zip(log, log[1:], strict=False))
