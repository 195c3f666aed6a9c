import itertools
import random
import statistics

from ripplegraph.operators import scaling
from ripplegraph.plans import catalog


def test_best_keeps_its_own_row_and_the_first_of_ties(spark):
    rows = [("x", 1, 1, 10, "s", 2.0, 0.5, 1.5, 0), ("x", 1, 1, 10, "s", 1.0, 0.1, 1.1, 1), ("x", 1, 1, 10, "s", 1.0, 0.9, 1.9, 2), ("x", 2, 1, 10, "s", 0.5, 0.1, 1.0, 3), ("x", 2, 1, 20, "s", 0.5, 0.1, 1.0, 4)]
    t = spark.createDataFrame(rows, "label string, processes int, threads int, people int, network string, seconds double, comm_seconds double, imbalance double, seq long")
    best = {(r["processes"], r["people"]): (r["seconds"], r["comm_seconds"], r["imbalance"]) for r in scaling.timing_best(t).collect()}
    assert best[1, 10] == (1.0, 0.1, 1.1)
    report = {(r["processes"], r["people"]): r for r in scaling.timing_report(t).collect()}
    assert (report[2, 10]["speedup"], report[2, 10]["efficiency"], report[2, 10]["comm_percent"]) == (2.0, 1.0, 20.0)
    assert report[2, 20]["speedup"] is None


def test_wins_over_all_pairs(spark):
    rnd = random.Random(1)
    x, y = ([float(rnd.randrange(6)) for _ in range(n)] for n in (17, 23))
    frame = lambda v: spark.createDataFrame([(a,) for a in v], "seconds double")
    want = sum((a < b) + 0.5 * (a == b) for a, b in itertools.product(x, y))
    assert tuple(scaling.pair_wins(frame(x), frame(y)).first()) == (want, 17 * 23)
    assert tuple(scaling.pair_wins(frame(x), frame([])).first()) == (0.0, 0)


def test_permutation(spark):
    frame = lambda v: spark.createDataFrame([(a,) for a in v], "seconds double")
    x, y = [1.0, 1.1, 1.2, 1.05, 1.15], [2.0, 2.1, 2.2, 2.05, 2.15]
    observed, p = scaling.permutation_test(frame(x), frame(y), 500).first()
    assert observed == round(statistics.median(y) - statistics.median(x), 6)
    pool = x + y
    deals = [[pool[i] for i in range(10) if i not in c] for c in itertools.combinations(range(10), 5)]
    hits = sum(round(statistics.median(d) - statistics.median([v for v in pool if v not in d]), 9) >= observed for d in deals)
    assert abs(p - hits / len(deals)) < 0.03


def test_permutation_covers_all_runs(spark, tmp_path):
    # the two configurations differ only in orders from 200 on
    rows = [(k, 1 if k % 2 else 0, 2 if x else 3, 1 if x else 0, 5.0 + k % 7 + (20.0 if k >= 200 and not x else 0.0)) for k in range(1200) for x in (k % 2,)]
    lines = [(k, 2 * p, s, n, q, 0.0, 0.0, "A", "F") for k, p, n, s, q in rows]
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    observed, p = catalog.queries()["permutation_test"](spark, str(tmp_path)).first()
    x, y = ([r[4] for r in rows if r[3] == side] for side in (1, 0))
    assert observed == round(statistics.median(y) - statistics.median(x), 6) > 10
    assert p == 1 / 200_001


def test_permutation_without_runs(spark):
    none, one = (spark.createDataFrame(v, "seconds double") for v in ([], [(1.0,), (None,)]))
    assert tuple(scaling.permutation_test(none, one, 9).first()) == (None, 0.1)
    assert tuple(scaling.permutation_test(one, one, 9).first()) == (0.0, 1.0)


def test_overlap(spark):
    rows = [("A", 0.0, 1.0), ("B", 0.5, 2.0), ("A", 1.0, 3.0), ("C", 2.0, 2.5), ("B", 2.2, 2.4)]
    t = spark.createDataFrame(rows, "task string, start double, stop double")
    assert tuple(scaling.timeline_overlap(t).first()) == (3, 2.2)
    assert tuple(scaling.timeline_overlap(t.limit(0)).first()) == (0, None)


def test_overlap_against_a_sweep(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("ABCDE"), float(a := rnd.randrange(60)), float(a + rnd.randrange(9))) for _ in range(300)]
    moves, live, most, at = sorted([(s, 1, t) for t, s, _ in rows] + [(e, -1, t) for t, _, e in rows]), dict.fromkeys("ABCDE", 0), 0, None
    for when, group in itertools.groupby(moves, lambda m: m[:2]):
        for _, change, task in group:
            live[task] += change
        now = sum(v > 0 for v in live.values())
        if now > most:
            most, at = now, when[0]
    t = spark.createDataFrame([*rows, ("F", 1.0, None), ("G", None, 2.0)], "task string, start double, stop double")
    assert tuple(scaling.timeline_overlap(t).first()) == (most, at)


def test_means_modes_and_machines(spark):
    kind = "processes int, threads int, seconds double, comm double"
    a = spark.createDataFrame([(1, 1, 4.0, 0.0), (1, 1, 5.0, 0.0), (2, 1, 2.0, 12.4), (1, 2, 3.0, 0.0), (2, 2, 1.0, 20.6), (1, 1, None, None)], kind)
    b = spark.createDataFrame([(1, 1, 6.0, 0.0), (2, 1, 6.0, 0.0), (4, 1, 3.0, 0.0)], kind)
    means = {(r["processes"], r["threads"]): (r["runs"], r["mean_seconds"]) for r in scaling.mean_runs(a).collect()}
    assert means == {(1, 1): (2, 4.5), (2, 1): (1, 2.0), (1, 2): (1, 3.0), (2, 2): (1, 1.0)}
    modes = [tuple(r) for r in scaling.combined_modes(scaling.grid_medians(a)).collect()]
    assert modes == [("sequential", 1, 1, 4.5, 1.0, 0.0), ("hybrid", 1, 2, 3.0, 1.5, 0.0), ("hybrid", 2, 1, 2.0, 2.25, 12.0), ("hybrid", 2, 2, 1.0, 4.5, 21.0)]
    both = {(r["series"], r["workers"]): (r["here"], r["there"], r["lead"]) for r in scaling.compare_machines(*map(scaling.grid_medians, (a, b))).collect()}
    assert both == {("processes", 1): (1.0, 1.0, 1.0), ("threads", 1): (1.0, 1.0, 1.0), ("processes", 2): (2.25, 1.0, 2.25), ("threads", 2): (1.5, None, None), ("processes", 4): (None, 2.0, None)}
    assert tuple(scaling.rank_totals(spark.createDataFrame([], "rank int, compute double, comm double, border long, ghosts long")).first()) == (0.0, 0.0, 0, 0)


def test_amdahl_of_perfect_speedup(spark):
    r = spark.createDataFrame([(1, 8.0), (2, 4.0), (4, 2.0)], "workers int, seconds double")
    assert {tuple(x) for x in scaling.amdahl_fit(r).collect()} == {(1, 1.0, 0.0, 1.0), (2, 2.0, 0.0, 2.0), (4, 4.0, 0.0, 4.0)}
