"""Running sums over a whole table without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplegraph.runtime import materialize


def running_sum(rows: DataFrame, value: str, order: list[str], out: str = "upto", descending: bool = False) -> DataFrame:
    """rows with `out`, the sum of `value` over all rows up to and including each in the given order (rows that tie in all of `order` follow
    each other as they come). Rows are dealt into ordered ranges and stored; each range is summed on its own, and what came before it is
    added from the ranges' totals, which are as many as partitions."""
    spark = rows.sparkSession
    keys = [F.desc(c) if descending else F.asc(c) for c in order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.repartitionByRange(parts, *keys).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("__range").agg(F.sum(value).alias("__total"))
    before = totals.select("__range", F.coalesce(F.sum("__total").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each range
    mine = W.partitionBy("__range").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    summed = ranged.join(F.broadcast(before), "__range").withColumn(out, F.sum(value).over(mine) + F.col("__before"))
    return summed.select(*rows.columns, out)
