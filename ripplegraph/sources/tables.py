"""Readers and writers of the library's text and CSV tables. Columns that a file may lack get the stated defaults."""

from __future__ import annotations

import socket

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIMINGS = "label string, processes int, threads int, people int, network string, cores int, machine string, seconds double, compute_seconds double, comm_seconds double, imbalance double"
RUNS = "processes int, threads int, repeat int, seconds double, comm double"
CURVE = "step long, susceptible long, exposed long, infectious long, recovered long"
TIMELINE = "rank int, task string, step int, start double, stop double"
DEGREES = "degree long, people long"
WEAK = "workers int, people int, seconds double"
TASKS = "task string, threads int, seconds double, check long"
MEMORY = "people int, peak_kb long, seconds double"

#: The published files' columns, and ours by place.
HEADERS = {
    "curve": ("step,susceptible,exposed,infectious,recovered", "step,susceptible,exposed,infectious,recovered"),
    "response": (
        "step,susceptible,exposed,infectious,recovered,newlyInfected,contactsTraced,clusters,largestCluster,vaccinatedThisStep",
        "step,susceptible,exposed,infectious,recovered,newly_infected,contacts_traced,clusters,largest_cluster,vaccinated",
    ),
    "timeline": ("rank,task,step,start,end", "rank,task,step,start,stop"),
    "timings": (
        "label,processes,threads,numberOfNodes,networkType,cores,machine,seconds,computeSeconds,commSeconds,imbalance",
        "label,processes,threads,people,network,cores,machine,seconds,compute_seconds,comm_seconds,imbalance",
    ),
    "degrees": ("degree,howManyPeople", "degree,people"),
    "tasks": ("task,threads,seconds,check", "task,threads,seconds,answer"),
    "modes": ("mode,processes,threads,seconds,speedup,comm", "mode,processes,threads,seconds,speedup,comm"),
    "weak": ("workers,nodes,seconds", "workers,people,seconds"),
    "memory": ("people,peakMemoryKB,seconds", "people,peak_kb,seconds"),
}


def read_edges(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Edges from text lines of two ids apart by white space, and the number of people: the largest id and one more. Each file is read up
    to the first line that doesn't hold two whole numbers, as a sequential reader would; a missing file is an error."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.split(F.trim("value"), r"\s+").alias("v"))
    rows = lines.select("file", "at", F.expr("try_cast(get(v, 0) AS bigint)").alias("a"), F.expr("try_cast(get(v, 1) AS bigint)").alias("b"), (F.array_join("v", "") == "").alias("blank"))
    stop = rows.where("NOT blank AND (a IS NULL OR b IS NULL)").groupBy("file").agg(F.min("at").alias("stop"))  # a row for each damaged file
    edges = rows.join(F.broadcast(stop), "file", "left").where("NOT blank AND a IS NOT NULL AND b IS NOT NULL AND (stop IS NULL OR at < stop)").select("a", "b")
    most = edges.agg(F.greatest(F.max("a"), F.max("b"))).first()[0]
    return edges, 0 if most is None else most + 1


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True)


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """TIMINGS rows with seq, the order in the file; the last three columns may be missing and are then 0, 0 and 1."""
    rows = _csv(spark, path, TIMINGS).withColumns({"compute_seconds": F.coalesce("compute_seconds", F.lit(0.0)), "comm_seconds": F.coalesce("comm_seconds", F.lit(0.0)), "imbalance": F.coalesce("imbalance", F.lit(1.0))})
    return rows.withColumn("seq", F.monotonically_increasing_id())


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """RUNS rows; the first column's header may be `procs` or `processes`, as columns are taken by place."""
    return _csv(spark, path, RUNS)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header by one of the schemas above."""
    return _csv(spark, path, schema)


def write_table(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; one_file is for tables of bounded size (curves, histograms, reports)."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True)


def published(df: DataFrame, kind: str) -> DataFrame:
    """df's columns of a kind of file in its order and with its names; others are left out."""
    names, ours = (h.split(",") for h in HEADERS[kind])
    return df.select(*(F.col(o).alias(n) for n, o in zip(names, ours, strict=True)))


def hardware(spark: SparkSession) -> tuple[int, str]:
    """The cores that the session counts on, and the driver's host name."""
    return spark.sparkContext.defaultParallelism, socket.gethostname()


def append_timing(row: DataFrame, path: str) -> None:
    """Add timing rows to a folder of CSV files with the published headers; cores and machine are this session's where row lacks them."""
    for name, value in zip(("cores", "machine"), hardware(row.sparkSession), strict=True):
        if name not in row.columns:
            row = row.withColumn(name, F.lit(value))
    published(row, "timings").coalesce(1).write.mode("append").csv(path, header=True)
