from collections import Counter

import pytest
from pyspark.sql import functions as F

from ripplegraph.operators import graph
from ripplegraph.sources import generators, tables


def test_edge_file(spark, tmp_path):
    (tmp_path / "e.txt").write_text("0 1\n  2\t5 \n\n3 1\nend 4\n9 9\n")
    edges, n = tables.read_edges(spark, str(tmp_path / "e.txt"))
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (2, 5), (3, 1)]
    assert n == 6
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        tables.read_edges(spark, str(tmp_path / "none.txt"))


def test_timings_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("label,processes,threads,numberOfNodes,networkType,cores,machine,seconds\na,1,2,10,smallworld,4,m,1.5\n")
    row = tables.read_timings(spark, str(tmp_path / "t.csv")).first()
    assert (row["seconds"], row["compute_seconds"], row["comm_seconds"], row["imbalance"]) == (1.5, 0.0, 0.0, 1.0)
    tables.append_timing(tables.read_timings(spark, str(tmp_path / "t.csv")), str(tmp_path / "out"))
    tables.append_timing(tables.read_timings(spark, str(tmp_path / "t.csv")), str(tmp_path / "out"))
    assert tables.read_timings(spark, str(tmp_path / "out")).count() == 2


def test_runs_with_either_header(spark, tmp_path):
    for head in ("procs", "processes"):
        (tmp_path / f"{head}.csv").write_text(f"{head},threads,repeat,seconds,comm\n2,4,1,0.5,9.5\n")
        assert tuple(tables.read_runs(spark, str(tmp_path / f"{head}.csv")).first()) == (2, 4, 1, 0.5, 9.5)


def test_small_world_exact_degrees(spark):
    edges = generators.small_world_exact(spark, 1000, 5, 0.1, 777)  # 5 is made 6
    assert edges.count() == 3000
    d = graph.degree(spark.range(1000), graph.adjacency(edges))
    assert d.agg(F.sum("degree")).first()[0] == 6000


def test_scale_free_exact(spark):
    rows = [tuple(r) for r in generators.scale_free_exact(spark, 500, 3, 777).collect()]
    assert len(rows) == 6 + 3 * 496
    assert all(n == 3 for a, n in Counter(a for a, _ in rows).items() if a > 3)
    assert len(set(rows)) == len(rows)
    with pytest.raises(ValueError):
        generators.scale_free_exact(spark, 3, 3)


def test_twister_is_the_standard_one():
    t = generators.Twister(5489)
    assert [t.draw() for _ in range(3)] == [3499211612, 581869302, 3890346734]


def test_copy_model_is_heavy_tailed(spark):
    edges = generators.copy_model(spark, 2000, 3, 1)
    assert edges.where("b IS NULL OR b > a").count() == 0
    d = [r["degree"] for r in graph.degree(spark.range(2000), graph.adjacency(edges)).collect()]
    assert max(d) > 20 * sorted(d)[1000]


def test_timings_are_appended_under_published_headers(spark, tmp_path):
    row = spark.createDataFrame([("a", 2, 4, 10, "s", 1.5, 1.0, 0.5, 1.25)], "label string, processes int, threads int, people int, network string, seconds double, compute_seconds double, comm_seconds double, imbalance double")
    for _ in range(2):
        tables.append_timing(row, str(tmp_path / "t"))
    assert {f.read_text().splitlines()[0] for f in (tmp_path / "t").glob("*.csv")} == {"label,processes,threads,numberOfNodes,networkType,cores,machine,seconds,computeSeconds,commSeconds,imbalance"}
    got = tables.read_timings(spark, str(tmp_path / "t")).collect()
    assert [(r["people"], r["cores"], r["seconds"], r["imbalance"]) for r in got] == [(10, tables.hardware(spark)[0], 1.5, 1.25)] * 2
