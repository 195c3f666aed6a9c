"""Independent analyses of each day's state as concurrent Spark jobs, with deadlines, retry and back pressure.

The driver spreads the disease day by day and hands each day's stored state to jobs: B traces the contacts of the infectious,
D clusters them, C (every so many days) picks whom to vaccinate, which takes effect on the next day. A job that misses its
deadline has its Spark jobs cancelled and, as one that fails, goes back to the front of the queue; the first answer for a job
counts, later ones are dropped.
"""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ripplegraph.operators import centrality, clusters, tracing
from ripplegraph.operators.seir import Epidemic, step
from ripplegraph.runtime import materialize

WAITING, READY, IN_FLIGHT, COMPLETED = "WAITING", "READY", "IN-FLIGHT", "COMPLETED"
TIMELINE = "rank int, task string, step int, start double, stop double"
LOG = "task_id long, task string, step int, status string, attempts int, value1 long, value2 long, start double, stop double"


@dataclass
class Job:
    task_id: int
    task: str
    step: int
    run: Callable[[], tuple[int, int]]
    prerequisite: int | None = None
    status: str = WAITING
    attempts: int = 0
    worker: int = 0
    values: tuple[int, int] | None = None
    start: float = 0.0
    stop: float = 0.0
    deadline: float = field(default=float("inf"))


class Queue:
    """Runs jobs on `workers` driver threads. A job waits until its prerequisite is completed."""

    def __init__(self, spark: SparkSession, workers: int = 3, timeout: float = 600.0, most_attempts: int = 4, ahead: int = 3):
        self.pool, self.workers, self.timeout, self.most_attempts, self.ahead = ThreadPoolExecutor(workers * most_attempts), workers, timeout, most_attempts, ahead
        self.inherit, self.context, self.name = inheritable_thread_target(spark), spark.sparkContext, uuid.uuid4().hex
        self.jobs: dict[int, Job] = {}
        self.queue: deque[Job] = deque()
        self.flying: dict[Future, Job] = {}
        self.began = time.monotonic()

    def add(self, job: Job) -> None:
        self.jobs[job.task_id] = job
        self.queue.append(job)
        self.turn()
        while len(self.queue) > self.ahead * self.workers:  # back pressure
            self.turn(0.2)

    def turn(self, seconds: float = 0.0) -> None:
        """Assign what is ready, collect what is done, put back what is late."""
        for _ in range(len(self.queue)):
            job = self.queue.popleft()
            blocked = job.prerequisite is not None and self.jobs[job.prerequisite].status != COMPLETED
            if blocked or sum(j.status == IN_FLIGHT for j in self.jobs.values()) >= self.workers:
                job.status = WAITING if blocked else READY
                self.queue.append(job)
                continue
            job.attempts += 1
            if job.attempts > self.most_attempts:
                raise RuntimeError(f"job {job.task_id} failed {self.most_attempts} times")
            busy = {j.worker for j in self.jobs.values() if j.status == IN_FLIGHT}
            job.worker = next(w for w in range(1, self.workers + 1) if w not in busy)
            job.status, job.start, job.deadline = IN_FLIGHT, time.monotonic() - self.began, time.monotonic() + self.timeout
            self.flying[self.pool.submit(self.inherit(self._tagged(job)))] = job
        done, _ = wait(self.flying, seconds, FIRST_COMPLETED) if self.flying else ((), ())
        for f in done:
            job = self.flying.pop(f)
            if job.status == COMPLETED:
                continue  # a late answer
            if f.exception() is None:
                job.values, job.status, job.stop = f.result(), COMPLETED, time.monotonic() - self.began
            elif job.status == IN_FLIGHT:
                self._again(job)
        for job in self.jobs.values():
            if job.status == IN_FLIGHT and time.monotonic() > job.deadline:
                self.context.cancelJobsWithTag(self._tag(job))
                self._again(job)

    def _tag(self, job: Job) -> str:
        return f"{self.name}-{job.task_id}-{job.attempts}"

    def _tagged(self, job: Job) -> Callable[[], tuple[int, int]]:
        tag = self._tag(job)

        def run() -> tuple[int, int]:
            self.context.addJobTag(tag)
            try:
                return job.run()
            finally:
                self.context.removeJobTag(tag)

        return run

    def _again(self, job: Job) -> None:
        job.status = READY
        self.queue.appendleft(job)

    def drain(self, wanted: set[int] | None = None) -> None:
        while any(j.status != COMPLETED for i, j in self.jobs.items() if wanted is None or i in wanted):
            self.turn(0.2)


def timed_pipeline(people: DataFrame, adj: DataFrame, state: DataFrame, epidemic: Epidemic, every: int = 10, vaccines: int | None = None, depth: int = 2, rounds: int = 20, workers: int = 3, timeout: float = 600.0, fault: Callable[[Job], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """The log of all jobs, and the timeline with a row for each day's spread (rank 0) and for each completed job (its worker). B's values are source_count and contacts_traced, C's the number of targets and the first, D's clusters and
    largest. `fault` is called before each run of a job, so that tests can stall or break it."""
    spark, n = state.sparkSession, people.count()
    k = n // 100 if vaccines is None else vaccines
    adj = adj.repartition("src").sortWithinPartitions("src").persist()
    scores = centrality.pagerank(people, adj, rounds)
    queue, number, targets = Queue(spark, workers, timeout), 0, {}
    due: tuple[int, int] | None = None
    spine: list[tuple[int, str, int, float, float]] = []

    def job(task: str, day: int, run: Callable[[], tuple[int, int]]) -> None:
        nonlocal number
        made = Job(number, task, day, lambda: (0, 0))

        def guarded() -> tuple[int, int]:
            if fault:
                fault(made)
            return run()

        made.run = guarded
        number += 1
        queue.add(made)

    for day in range(epidemic.days):
        if due:
            queue.drain({due[0]})
            state, due = centrality.vaccinate(state, targets[due[1]]), None
        began = time.monotonic() - queue.began
        state = materialize(step(adj, state, epidemic, day), "scheduled-day")
        spine.append((0, "A", day, began, time.monotonic() - queue.began))

        def trace(now: DataFrame = state) -> tuple[int, int]:
            return tuple(tracing.trace(adj, tracing.infectious(now), depth).first())

        def cluster(now: DataFrame = state) -> tuple[int, int]:
            return tuple(clusters.cluster_summary(clusters.cluster_members(adj, now)).first())

        def target(now: DataFrame = state, day: int = day) -> tuple[int, int]:
            chosen = materialize(centrality.top_targets(scores, now, n, k), "scheduled-targets")
            targets[day] = chosen
            first = chosen.orderBy("rank").first()
            return chosen.count(), first["id"] if first else -1

        job("B", day, trace)
        job("D", day, cluster)
        if day % every == 0:
            job("C", day, target)
            due = (number - 1, day)
    queue.drain()
    queue.pool.shutdown(wait=False)
    adj.unpersist()
    rows = [(j.task_id, j.task, j.step, j.status, j.attempts, *j.values, j.start, j.stop) for j in queue.jobs.values()]
    lines = spine + [(j.worker, j.task, j.step, j.start, j.stop) for j in queue.jobs.values()]
    return spark.createDataFrame(rows, LOG), spark.createDataFrame(lines, TIMELINE)


def run_pipeline(people: DataFrame, adj: DataFrame, state: DataFrame, epidemic: Epidemic, **options: Any) -> DataFrame:
    """The log of timed_pipeline."""
    return timed_pipeline(people, adj, state, epidemic, **options)[0]
