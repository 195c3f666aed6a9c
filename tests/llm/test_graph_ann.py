import numpy as np

from ripplegraph.llm import graph_ann as G

SCHEMA = "vec_id long, embedding array<float>, label int, query_id int, rank int, score double"


def frame(spark, data):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], 1, 2, 3, 0.5) for i, v in data], SCHEMA)


def brute(data, k=20):
    ok = {}
    for i, v in data:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.asarray(v, np.float32).astype(float)
    out = {}
    for q, v in ok.items():
        if q % 20 == 0:
            scored = sorted((-float(v @ w), i) for i, w in ok.items() if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) for q in want)
    return hits / max(1, sum(map(len, want.values())))


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_exact_scores(spark):
    rnd = np.random.default_rng(1)
    data = [(i, v) for i, v in enumerate(rnd.standard_normal((3000, 24)).astype(np.float32) * rnd.uniform(0.5, 2, (3000, 1)).astype(np.float32))]
    got, want = answers(G.search(frame(spark, data), shard=1000)), brute(data)
    assert set(got) == set(want) and recall(got, want) >= 0.97
    table = dict(data)
    for q, found in got.items():
        assert len(found) == 20
        keys = [(-s, i) for i, s in found]
        assert keys == sorted(keys)
        for i, s in found:
            assert abs(s - float(table[q].astype(float) @ table[i].astype(float))) < 1e-9


def test_edge_vectors_and_ties(spark):
    rnd = np.random.default_rng(2)
    one = [0.5, 0.25, -1.0, 2.0]
    data = [(i, one) for i in range(0, 90)]  # a large group of equal vectors
    data += [(100 + i, rnd.standard_normal(4).astype(np.float32).tolist()) for i in range(60)]
    data += [(200, None), (220, []), (240, [0, 0, 0, 0]), (260, [1, None, 0, 0]), (280, [1, float("nan"), 0, 0]), (300, [float("inf"), 0, 0, 0]), (None, one), (320, [1.0, 2.0]), (321, [3.0, 1.0]), (340, one), (340, one), (360, [-0.0, 1.0, 0.0, 0.0])]
    got = answers(G.search(frame(spark, data)))
    want = brute(data)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert [i for i, _ in got[20] if i < 90][:3] == [0, 1, 2] and 20 not in {i for i, _ in got[20]}
    assert got[320] == [(321, 5.0)]


def test_a_vec_id_with_several_vectors_and_large_numbers(spark):
    data = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), *((1, [1.0 + i / 64, 0.0]) for i in range(200)), (2, [0.5, 0.25]), (3, [0.0, 0.5])]
    assert answers(G.search(frame(spark, data))) == {20: [(1, 1.0 + 199 / 64), (2, 0.5), (3, 0.5)]}
    wide = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e50, 3e40]), (2, [5e50, -1e200])], "vec_id long, embedding array<double>")
    assert [i for i, _ in answers(G.search(wide))[0]] == [2, 1]


def test_the_query_walks_a_part_of_its_shard(spark, write):
    rnd = np.random.default_rng(3)
    data = [(i, v) for i, v in enumerate((rnd.standard_normal((40, 16))[rnd.integers(40, size=9000)] + 0.3 * rnd.standard_normal((9000, 16))).astype(np.float32))]
    got, want = answers(G.op9_graph_ann(spark, write(embeddings=frame(spark, data)))), brute(data)
    assert set(got) == set(want) and recall(got, want) >= 0.95
    points = G.lifted(np.array([v for _, v in data], np.float64))
    graph, start = G.build(points)
    assert (graph < len(points)).sum(1).max() <= G.DEGREE * G.SLACK
    _, _, worked = G.beam_search(points, (points**2).sum(1), graph, start, points[:100], G.BEAM)
    assert worked < 0.25 * 100 * len(points)


def test_few_and_none(spark):
    assert G.search(frame(spark, [])).count() == 0
    assert G.search(frame(spark, [(0, [1.0, 2.0])])).count() == 0
    assert answers(G.search(frame(spark, [(0, [1.0, 2.0]), (5, [1.0, 0.0])]))) == {0: [(5, 1.0)]}


def test_pruning_keeps_the_nearest_and_drops_the_shadowed():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [5, 5]], np.float32)
    kept = G.robust_prune(points, np.array([0]), np.array([[4, 2, 1, 1, 3, 0, 5]]), 3, 1.2)[0].tolist()
    assert kept[:2] == [1, 3] and 2 not in kept
