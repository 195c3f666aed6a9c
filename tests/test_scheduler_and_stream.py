import time

from ripplegraph.operators import graph, seir
from ripplegraph.plans import scheduler
from ripplegraph.sources import generators
from ripplegraph.streaming import daily


def test_jobs_survive_a_silent_and_a_failing_run(spark):
    n = 120
    people, adj = spark.range(n), graph.adjacency(generators.small_world(spark, n, 4, 0.2, 3)).persist()
    e = seir.Epidemic(beta=0.4, seed=3, days=3)
    state = seir.seed_infected(people, n, e)
    plain = scheduler.run_pipeline(people, adj, state, e, every=2).drop("start", "stop", "attempts").collect()
    broken = set()

    def fault(job):
        if job.task_id == 1 and job.task_id not in broken:
            broken.add(1)
            raise RuntimeError("lost")
        if job.task_id == 3 and job.task_id not in broken:
            broken.add(3)
            time.sleep(12)

    log = scheduler.run_pipeline(people, adj, state, e, every=2, timeout=8, fault=fault)
    assert sorted(map(tuple, log.drop("start", "stop", "attempts").collect())) == sorted(map(tuple, plain))
    assert {r["status"] for r in log.collect()} == {"COMPLETED"}
    assert {r["task_id"] for r in log.collect() if r["attempts"] > 1} >= {1, 3}
    assert [r["task"] for r in sorted(plain, key=lambda r: r["task_id"])] == ["B", "D", "C", "B", "D", "B", "D", "C"]


def test_a_late_run_is_cancelled(spark):
    runs = []

    def slow():
        runs.append(time.monotonic())
        if len(runs) == 1:  # by far more work than the deadline leaves
            spark.range(0, 1 << 40, 1, 4).selectExpr("sum(hash(id))").first()
        return len(runs), 0

    queue = scheduler.Queue(spark, workers=1, timeout=4)
    queue.add(scheduler.Job(0, "B", 0, slow))
    queue.drain()
    assert queue.jobs[0].values == (2, 0) and queue.jobs[0].attempts == 2
    until = time.monotonic() + 20
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.monotonic() < until:
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_stream_analyses_each_day_once(spark, tmp_path):
    n = 60
    adj = graph.adjacency(generators.small_world(spark, n, 4, 0.2, 3)).persist()
    e = seir.Epidemic(beta=0.5, seed=3, days=2)
    state = seir.seed_infected(spark.range(n), n, e)
    for day in range(2):
        state.selectExpr(f"{day}L AS day", "id", "st").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        state = seir.step(adj, state, e, day)
    for _ in range(2):  # the second run finds nothing new
        daily.follow(spark, adj, str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "checkpoint")).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log")).orderBy("step").collect()
    assert [r["step"] for r in log] == [0, 1]
    assert all(r["susceptible"] + r["exposed"] + r["infectious"] + r["recovered"] == n for r in log)
