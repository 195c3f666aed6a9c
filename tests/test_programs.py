import pytest

from ripplegraph.__main__ import main


@pytest.mark.parametrize(("args", "rows"), [("simulate --people 300 --days 4", 5), ("response --people 300 --days 2 --network smallworld", 2), ("borders --people 400 --parts 3 --network smallworld-keyed", 6), ("tasks --people 300 --days 2", 4), ("schedule --people 200 --days 1 --network scalefree-keyed", 3)])
def test_programs(spark, tmp_path, args, rows):
    out = main([*args.split(), "--out", str(tmp_path / "out")])
    assert out.count() == rows
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == rows


def test_degrees_and_timings(spark, tmp_path):
    assert main("degrees --people 500".split()).agg({"people": "sum"}).first()[0] == 500
    (tmp_path / "t.csv").write_text("label,processes,threads,people,network,cores,machine,seconds,compute,comm,imbalance\na,1,1,10,s,4,m,2.0,1,0.5,1\na,2,1,10,s,4,m,1.0,1,0.5,1\n")
    got = {r["processes"]: r["speedup"] for r in main(["timings", "--file", str(tmp_path / "t.csv")]).collect()}
    assert got == {1: 1.0, 2: 2.0}


@pytest.mark.parametrize(
    ("args", "header"),
    [
        ("simulate --people 200 --days 2", "step,susceptible,exposed,infectious,recovered"),
        ("response --people 200 --days 1", "step,susceptible,exposed,infectious,recovered,newlyInfected,contactsTraced,clusters,largestCluster,vaccinatedThisStep"),
        ("tasks --people 300 --days 2", "task,threads,seconds,check"),
        ("degrees --people 300", "degree,howManyPeople"),
    ],
)
def test_published_headers(spark, tmp_path, args, header):
    main([*args.split(), "--out", str(tmp_path / "out")])
    assert [f.read_text().splitlines()[0] for f in (tmp_path / "out").glob("*.csv")] == [header]


def test_timeline(spark, tmp_path):
    main([*"schedule --people 200 --days 2 --network scalefree-keyed --timeline".split(), str(tmp_path / "t")])
    rows = spark.read.csv(str(tmp_path / "t"), header=True, inferSchema=True).collect()
    assert rows[0].asDict().keys() == {"rank", "task", "step", "start", "end"}
    assert sorted((r["task"], r["step"]) for r in rows) == [("A", 0), ("A", 1), ("B", 0), ("B", 1), ("C", 0), ("D", 0), ("D", 1)]
    assert all((r["rank"] == 0) == (r["task"] == "A") and r["start"] <= r["end"] for r in rows)


def test_report_keeps_the_order_of_the_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("label,processes,threads,people,network,cores,machine,seconds\na,1,1,20,z,4,m,2.0\na,1,1,10,s,4,m,2.0\nb,2,1,20,z,4,m,1.0\na,1,1,15,a,4,m,2.0\n")
    got = [(r["people"], r["network"], r["label"]) for r in main(["timings", "--file", str(tmp_path / "t.csv")]).collect()]
    assert got == [(20, "z", "a"), (20, "z", "b"), (10, "s", "a"), (15, "a", "a")]
