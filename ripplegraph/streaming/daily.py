"""Daily analyses as a stream: each day's state lands as files, and every new day is traced and clustered once.

The log is written per day in overwrite mode, so a micro-batch that is repeated after a failure leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ripplegraph.operators import clusters, seir, tracing

STATE = "day long, id long, st int"


def follow(spark: SparkSession, adj: DataFrame, states: str, log: str, checkpoint: str, depth: int = 2) -> StreamingQuery:
    """Read parquet files of (day, id, st) as they land in `states`; for each day write one row of counts, tracing and clusters to
    log/day=<day>. A file holds whole days."""

    def analyse(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        for day in sorted(r["day"] for r in batch.select("day").distinct().collect()):  # days of one micro-batch
            now = batch.where(batch["day"] == day).select("id", "st")
            counts = seir.state_counts(now, day)
            traced = tracing.trace(adj, tracing.infectious(now), depth)
            found = clusters.cluster_summary(clusters.cluster_members(adj, now))
            counts.crossJoin(traced).crossJoin(found).coalesce(1).write.mode("overwrite").parquet(f"{log}/day={day}")  # one row each
        batch.unpersist()

    source = spark.readStream.schema(STATE).option("maxFilesPerTrigger", 1).parquet(states)
    return source.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
